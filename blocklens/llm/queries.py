"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pareto_mix import length_rate, pareto_mix

    return pareto_mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3.0, seed="mix", rate=length_rate)


#: {docs}: the table to mix; ends in a CTE ``mixed`` of the query's columns.
PARETO_SQL = r"""
d0 AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, substr(sha1(coalesce(text, '')), 1, 16) AS tie,
              row_number() OVER (PARTITION BY source, doc_id, sha1(coalesce(text, ''))) - 1 AS nth FROM {docs}),
d AS (SELECT doc_id, source, size, tie, nth, length(bin(size))::DOUBLE AS rate,
             (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|mix' || CASE WHEN nth > 0 THEN '|' || nth ELSE '' END), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM d0),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, source_size * 3.0::DOUBLE AS most,
              CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s0),
w AS (SELECT 0 AS n, source, source_size, w, most, FALSE AS stop, sum(source_size::DOUBLE) OVER () * w / sum(w) OVER () AS t FROM s1
      UNION ALL
      SELECT n + 1, source, source_size, w, most, stop OR t > most,
             CASE WHEN stop OR t > most THEN most
                  ELSE t + sum(CASE WHEN t > most THEN t - most ELSE 0 END) OVER () * w / sum(CASE WHEN stop OR t > most THEN 0 ELSE w END) OVER () END
      FROM w WHERE n < 40),
s4 AS (SELECT source, source_size, round(t, 6) AS target FROM w WHERE n = 40),
c1 AS (SELECT source, rate, sum(size)::BIGINT AS words FROM d GROUP BY 1, 2),
c2 AS (SELECT source, coalesce(sum(words) OVER (PARTITION BY source ORDER BY rate DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS above,
              sum(words * rate) OVER (PARTITION BY source ORDER BY rate DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM c1),
c3 AS (SELECT s4.source, max((target - 3.0::DOUBLE * above) / rest) AS factor FROM c2 JOIN s4 ON c2.source IS NOT DISTINCT FROM s4.source WHERE rest > 0 GROUP BY 1),
r0 AS (SELECT d.*, source_size, target, coalesce(factor * rate, 0) AS copies
       FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source LEFT JOIN c3 ON d.source IS NOT DISTINCT FROM c3.source),
r AS (SELECT * REPLACE (CASE WHEN copies >= 3.0::DOUBLE - 1e-9 THEN 3.0::DOUBLE ELSE copies END AS copies) FROM r0),
p AS (SELECT *, floor(copies) AS base, copies - floor(copies) AS p FROM r),
o AS (SELECT *, CASE WHEN p > 0 THEN (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)) END AS odds FROM p),
v AS (SELECT *, coalesce(odds / (odds + 1.0::DOUBLE), 1) AS v, target - sum(base * size) OVER (PARTITION BY source) AS open_words FROM o),
k AS (SELECT *, sum(CASE WHEN base < 3 AND copies > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY v, doc_id NULLS FIRST, tie, nth) AS through FROM v),
mixed AS (SELECT doc_id, size, source_size, target,
       (size * (base + CASE WHEN base < 3 AND copies > 0 AND (through <= open_words OR (through - size < open_words AND through - open_words <= open_words - (through - size))) THEN 1 ELSE 0 END))::BIGINT AS taken FROM k)"""

OP1_SQL = "WITH RECURSIVE " + PARETO_SQL.format(docs="documents") + " SELECT * FROM mixed"


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, sample, score_texts

    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, fit(sample(docs, table(spark, sf_dir, "labels"))))


def op3_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .piece_bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), remembered=1 << 20)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    docs = table(spark, sf_dir, "documents")
    hundred = F.floor(F.col("doc_id") / 100).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), hundred, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan(docs.select("doc_id", path.alias("path"), "text"), key_cols=("doc_id",))


def _op4_sql() -> str:
    from .license_scan import PARAGRAPHS, TEMPLATES

    rows = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate([*TEMPLATES, *PARAGRAPHS]))
    return _OP4_SQL.replace("{templates}", rows)


#: Every line, sentence and paragraph of every file against every template, without filters.
_OP4_SQL = r"""
WITH t AS (SELECT * FROM (VALUES {templates}) x(i, name, body)),
tt AS (SELECT i, term, count(*) AS n FROM (SELECT i, unnest(regexp_extract_all(lower(body), '[a-z0-9]+(?:[.][0-9]+)*')) AS term FROM t) GROUP BY 1, 2),
d AS (SELECT doc_id, concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), (floor(doc_id / 100))::BIGINT::VARCHAR, doc_id::VARCHAR || '.txt') AS path, coalesce(text, '') AS text,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
f AS (SELECT term, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(body, '[a-z0-9]+(?:[.][0-9]+)*')) AS term FROM d) GROUP BY 1),
total AS (SELECT count(*) AS n FROM d),
idf AS (SELECT term, round(ln((total.n + 1)::DOUBLE / (coalesce(f.n, 0) + 1)) + 1, 6) AS w FROM (SELECT term FROM f UNION SELECT term FROM tt) u LEFT JOIN f USING (term) CROSS JOIN total),
tv AS (SELECT i, term, tt.n * w AS w FROM tt JOIN idf USING (term)),
tn AS (SELECT i, sqrt(sum(w * w)) AS norm FROM tv GROUP BY 1),
l0 AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS k FROM d),
l1 AS (SELECT *, sum(CASE WHEN regexp_matches(line, '[a-z0-9]') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS par FROM l0),
s0 AS (SELECT doc_id, FALSE AS joined, unnest(regexp_split_to_array(regexp_replace(body, '([.!?;])[ \t\r]+', '\1' || chr(10), 'g'), '\n+')) AS seg FROM d
       UNION ALL SELECT doc_id, TRUE, string_agg(line, chr(10) ORDER BY k) FROM l1 GROUP BY doc_id, par),
s1 AS MATERIALIZED (SELECT doc_id, joined, row_number() OVER () AS sid, regexp_extract_all(seg, '[a-z0-9]+(?:[.][0-9]+)*') AS terms FROM s0),
s3 AS (SELECT sid, term, n * w AS w FROM (SELECT sid, term, count(*) AS n FROM (SELECT sid, unnest(terms) AS term FROM s1) GROUP BY 1, 2) JOIN idf USING (term)),
sn AS (SELECT sid, sqrt(sum(w * w)) AS norm FROM s3 GROUP BY 1),
c AS (SELECT sid, i, round(sum(s3.w * tv.w) / max(sn.norm) / max(tn.norm), 6) AS score FROM s3 JOIN tv USING (term) JOIN sn USING (sid) JOIN tn USING (i) GROUP BY 1, 2),
b AS (SELECT doc_id, joined, len(terms) AS n, score, i, row_number() OVER (PARTITION BY sid ORDER BY score DESC, i) AS r FROM c JOIN s1 USING (sid) WHERE score >= 0.75),
o AS (SELECT doc_id, arg_min(i, (-score, i)) AS i, max(score) AS score, greatest(coalesce(sum(n) FILTER (joined), 0), coalesce(sum(n) FILTER (NOT joined), 0)) AS n FROM b WHERE r = 1 GROUP BY 1),
g AS (SELECT doc_id, nullif(regexp_extract(text, 'SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+()-]+(?:[ \t]+(?:OR|AND|WITH)[ \t]+[A-Za-z0-9.+()-]+)*)', 1), '') AS tag,
             len(regexp_extract_all(lower(regexp_extract(text, 'SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+()-]+(?:[ \t]+(?:OR|AND|WITH)[ \t]+[A-Za-z0-9.+()-]+)*)', 0)), '[a-z0-9]+(?:[.][0-9]+)*')) AS tagged FROM d),
own AS (SELECT d.doc_id, path, coalesce(tag, name) AS own_license, CASE WHEN tag IS NOT NULL THEN 1.0 ELSE score END AS score,
               (tag IS NOT NULL OR name IS NOT NULL) AND 2 * greatest(coalesce(o.n, 0), tagged) >= len(regexp_extract_all(d.body, '[a-z0-9]+(?:[.][0-9]+)*')) AS is_license_file,
               regexp_replace(path, '/?[^/]*$', '') AS dir FROM d JOIN g USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN t USING (i)),
speaks AS (SELECT dir, arg_min(own_license, path) AS given FROM own WHERE is_license_file GROUP BY 1),
near AS (SELECT own.doc_id, speaks.dir AS from_dir, given, row_number() OVER (PARTITION BY own.doc_id ORDER BY length(speaks.dir) DESC) AS r
         FROM own JOIN speaks ON own.dir = speaks.dir OR starts_with(own.dir, speaks.dir || '/') OR speaks.dir = '' WHERE own_license IS NULL)
SELECT own.doc_id, path, own_license, score, is_license_file, coalesce(own_license, given) AS license,
       CASE WHEN own_license IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS how, from_dir
FROM own LEFT JOIN near ON near.doc_id = own.doc_id AND r = 1
"""


def op5_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivot_topk import pivot_topk

    return pivot_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
FROM t
"""

def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kd_shards import kd_shards

    return kd_shards(table(spark, sf_dir, "documents"), shards=24)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import chat_digest, chat_examples

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_digest(chat_examples(turns.unionByName(probe)))


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) AS tc,
         4 + length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) + 2 + 8 AS hc
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT *, sum(tc + hc) OVER (PARTITION BY conv_id ORDER BY i) AS through FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(through) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"), n=5, threshold=(4, 5))


#: {docs}: the table to join; ends in a CTE ``joined`` of the query's columns.
NGRAM_SQL = r"""
jw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
js AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
              ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM jw),
je AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM js),
jl AS (SELECT a.doc_id AS a, b.doc_id AS b FROM je a JOIN je b ON a.g = b.g AND a.doc_id <> b.doc_id
       GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
jr AS (SELECT a AS node, a AS seen FROM jl UNION SELECT jr.node, jl.b FROM jr JOIN jl ON jl.a = jr.seen),
joined AS (SELECT js.doc_id, len(s)::BIGINT AS n_shingles, coalesce(c.least, js.doc_id) AS component_id, coalesce(k.n_links, 0)::BIGINT AS n_links
           FROM js LEFT JOIN (SELECT node, min(seen) AS least FROM jr GROUP BY 1) c ON c.node = js.doc_id
           LEFT JOIN (SELECT a, count(*) AS n_links FROM jl GROUP BY 1) k ON k.a = js.doc_id)"""

OP10_SQL = "WITH RECURSIVE " + NGRAM_SQL.format(docs="documents") + " SELECT * FROM joined"

QUERIES = {
    "op4_license_scan": op4_license_scan,
    "op5_pivot_topk": op5_pivot_topk,
    "op2_toxicity": op2_toxicity,
    "op10_ngram_join": op10_ngram_join,
    "op1_pareto_mix": op1_pareto_mix,
    "op3_piece_bpe": op3_piece_bpe,
    "op6_token_counts": op6_token_counts,
    "op8_kd_shards": op8_kd_shards,
    "op9_chat_format": op9_chat_format,
    "op7_exact_dedup": op7_exact_dedup,
}

ORACLE_SQL = {
    "op4_license_scan": _op4_sql(),
    "op5_pivot_topk": OP5_SQL,
    "op10_ngram_join": OP10_SQL,
    "op1_pareto_mix": OP1_SQL,
    "op9_chat_format": OP9_SQL,
    "op7_exact_dedup": OP7_SQL,
}
