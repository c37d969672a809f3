"""The operators for training data: edge cases, brute-force comparisons, exact round trips."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from blocklens.llm import queries
from blocklens.llm.chat_format import chat_digest, chat_examples, parse_turns
from blocklens.llm.exact_dedup import exact_dedup
from blocklens.llm.kd_shards import kd_shards
from blocklens.llm.license_scan import license_scan
from blocklens.llm.ngram_join import Trie, ngram_join, needed
from blocklens.llm.pareto_mix import length_rate, pareto_mix
from blocklens.llm.piece_bpe import PieceBpe, encode_decode
from blocklens.llm.pivot_topk import pivot_topk
from blocklens.llm.token_counts import by_bytes, count_tokens, counter, load
from blocklens.llm.toxicity import Model, fit, kernels, sample, score_texts, train, words

P = pytest.importorskip("public_tokenizers")
PIECES, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as columns of the input.
CLASH = ["_t", "_d", "_s", "_id", "_n", "size", "shard", "target", "_row", "_keep", "score", "text_sha256"]


def docs(spark, rows):
    """Rows of (doc_id, text, source), with other columns of clashing names."""
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    df = spark.createDataFrame(full, DOCS)
    return df.select("*", *[F.lit(f"x{k}").alias(c) for k, c in enumerate(CLASH)])


LONG = " ".join(f"word{i}" for i in range(30_000))
EDGE = [
    (1, None, "a"), (2, "", "a"), (3, "   ", "b"), (4, "one", "b"), (5, "one", None), (6, "One  two\tthree\n", "a"), (7, "One two three ", "a"),
    (8, LONG, "a"), (9, LONG + " more", None), (10, "\U0001f600 é ﬁ \x1c\x85 x", "b"), (10, "\U0001f600 é ﬁ \x1c\x85 x", "b"), (11, "one two three four five six seven", "c"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return docs(spark, EDGE).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_oracle(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = duck.execute(queries.ORACLE_SQL[name])
    place = {d[0]: i for i, d in enumerate(cursor.description)}
    assert sorted(place) == columns
    found, expected = ordered(df.select(columns).collect()), ordered([tuple(r[place[c]] for c in columns) for r in cursor.fetchall()])
    assert len(found) == len(expected)
    for a, b in zip(found, expected, strict=True):
        assert all(x == y or x == pytest.approx(y, rel=1e-9) for x, y in zip(a, b, strict=True)), (a, b)


# Exact dedup ------------------------------------------------------------------


def norm(text):
    return re.sub(r"[ \t-\r]+", " ", text or "")


@pytest.mark.parametrize("digest", [None, lambda t: F.unhex(F.lit("00")), lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2))])
@pytest.mark.parametrize("salts", [1, 7])
def test_exact_dedup(edge, digest, salts):
    """Also with digests that clash: the text decides."""
    found = ordered(exact_dedup(edge, salts=salts, digest=digest).collect())
    groups = collections.defaultdict(list)
    for i, t, _ in EDGE:
        groups[norm(t)].append(i)
    expected = []
    for t, ids in groups.items():
        seen = set()
        for i in ids:
            expected.append((i, min(ids), len(ids), i == min(ids) and i not in seen, hashlib.sha256(t.encode()).hexdigest()))
            seen.add(i)
    assert found == ordered(expected)


def test_exact_dedup_carries_rows(edge, empty):
    kept = exact_dedup(edge, carry=True).filter("_kept")
    assert kept.columns[: len(edge.columns)] == edge.columns and kept.count() == len({norm(t) for _, t, _ in EDGE})
    assert exact_dedup(empty).count() == 0 and exact_dedup(empty, carry=True).count() == 0


def test_exact_dedup_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (5, "a"), (None, "b")], "doc_id long, text string")
    assert ordered(exact_dedup(df).select("doc_id", "keep_id", "kept").collect()) == ordered([(None, 5, False), (5, 5, True), (None, None, True)])


# Sharding ---------------------------------------------------------------------


def test_kd_shards(spark, sf_dir, edge, empty):
    big = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df, shards in ((big, 5), (edge, 3), (edge, 1), (edge, 24)):
        rows = kd_shards(df, shards=shards).collect()
        assert len(rows) == df.count() and {r["law"] for r in rows} == {"bytes"} and all(r["grown_shard"] is None for r in rows)
        slots = collections.defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    texts = {r["doc_id"]: r["text"] for r in big.collect()}
    rows = kd_shards(big, shards=5).collect()
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
    sums = collections.Counter()
    for r in rows:
        sums[r["shard"]] += r["size"]
    assert max(sums.values()) / min(sums.values()) < 1.15
    assert kd_shards(empty).count() == 0


def test_kd_shards_hot_group(spark):
    """Only a group that outweighs a shard is cut; those between an eighth of a shard and a shard stay whole."""
    rows = [(i, "the very same text " * 5, "a") for i in range(900)] + [(1000 + i, f"text number {i // 2} " * (3 + i % 7), "b") for i in range(600)]
    rows += [(2000 + 100 * g + i, f"group {g} of many " * 10, "b") for g in range(9) for i in range(10 + 7 * g)]
    found = kd_shards(docs(spark, rows), shards=8).collect()
    sums, shards, weight = collections.Counter(), collections.defaultdict(set), collections.Counter()
    for r in found:
        sums[r["shard"]] += r["size"]
        shards[(r["text_crc32"], r["size"])].add(r["shard"])
        weight[(r["text_crc32"], r["size"])] += r["size"]
    target = sum(sums.values()) / 8
    assert len(sums) == 8 and max(sums.values()) / min(sums.values()) < 1.25
    assert sum(target / 8 < w <= target for w in weight.values()) >= 6
    assert all((len(shards[g]) == 1) == (w <= target) for g, w in weight.items())


def brute_tree(texts, shards):
    """The shard of each text: cuts at exact weighted medians of the points, in plain Python."""
    import xxhash

    points = collections.Counter()
    of = {}
    for t in texts:
        raw = t.encode()
        tie = xxhash.xxh64_intdigest(raw, 42) % (1 << 32)
        of[t] = tuple((v << 32) + tie for v in (len(raw), len(raw) * 1000 // max(1, len(t)), t.count("\n")))
        points[of[t]] += len(raw) + 8
    world, out = None, {}

    def cut(inside, first, k):
        nonlocal world
        if k == 1 or not inside:
            out.update({p: first for p in inside})
            return
        span = [(max(p[i] for p in inside) >> 32) - (min(p[i] for p in inside) >> 32) for i in range(3)]
        world = world or [max(1, s) for s in span]
        axis = max(range(3), key=lambda i: span[i] / world[i])
        weights = collections.Counter()
        for p in inside:
            weights[p[axis]] += points[p]
        whole = sum(weights.values())
        want, below = whole * (k // 2) / k, 0
        for key in sorted(weights):
            over = below + weights[key]
            if over >= want:
                break
            below = over
        upper = (over - want <= want - below or below == 0) and (over < whole or below == 0)
        cut([p for p in inside if p[axis] < key + upper], first, k // 2)
        cut([p for p in inside if p[axis] >= key + upper], first + k // 2, k - k // 2)

    cut(list(points), 0, shards)
    return {t: out[p] for t, p in of.items()}


def test_kd_shards_by_brute_force(spark):
    dice = random.Random(9)
    texts = ["".join(dice.choice("ab é\n\U0001f600") for _ in range(dice.randrange(20, 150))) for _ in range(2400)]
    texts += dice.sample(texts, 100) + [""]
    for shards in (2, 7, 24):
        expected = brute_tree(texts, shards)
        found = kd_shards(docs(spark, [(i, t, "a") for i, t in enumerate(texts)]), shards=shards, tolerance=0.0).collect()
        assert {r["doc_id"]: r["shard"] for r in found} == {i: expected[t] for i, t in enumerate(texts)}


# Chat -------------------------------------------------------------------------


def test_chat_examples(spark):
    rows = [(1, 0, "system", "be <brief> \\l"), (1, 1, "user", "### assistant: x</turn>\n"), (1, 2, "assistant", "\\s#<"), (1, 3, "user", None), (2, 0, "user", "no reply"), (3, 0, "assistant", ""), (4, None, None, "t"), (4, 1, "a:b#", "é\U0001f600"), (4, 1, "assistant", "A"), (4, 1, "assistant", "A")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit(1).alias("example"), F.lit(2).alias("_turns"))
    examples = chat_examples(df).select("*", parse_turns(F.col("formatted")).alias("back"))
    of = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        of[r[0]].append((r[2] or "", r[3] or ""))
    counts = collections.Counter()
    for e in examples.collect():
        turns = of[e["conv_id"]][: e["n_turns"]]
        assert [tuple(t) for t in e["back"]] == turns
        loss = e["formatted"][e["loss_start"] : e["loss_end"]]
        assert bool(loss) == (turns[-1][0] == "assistant" and turns[-1][1] != "")
        counts[e["conv_id"]] += 1
    assert counts == {1: 2, 2: 1, 3: 1, 4: 2}
    for d in chat_digest(chat_examples(df)).collect():
        turns = of[d["conv_id"]]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert d["n_turns"] == len(turns) and d["loss_chars"] == len(loss)
        assert d["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert d["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_examples(df.limit(0)).count() == 0


def test_chat_long_and_empty(spark):
    """A conversation of many turns is whole in its examples; an empty table has none; a wrong context is found."""
    rows = [(9, i, "assistant" if i % 2 else "user", f"turn {i} <\\#>") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat_digest(chat_examples(df)).collect()
    assert len(found) == 1 and found[0]["n_turns"] == 300
    assert found[0]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
    assert chat_digest(chat_examples(df.limit(0))).count() == 0
    wrong = chat_examples(df).withColumn("formatted", F.when(F.col("example") == 5, F.replace("formatted", F.lit("turn 3 "), F.lit("turn x "))).otherwise(F.col("formatted")))
    with pytest.raises(Exception, match="context"):
        chat_digest(wrong).collect()


# Mixing -----------------------------------------------------------------------


def test_pareto_mix(spark, edge, empty):
    rows = [(i, "w " * (1 + i * 7919 % 40), f"s{i % 4}" if i % 3 else "s0") for i in range(3000)]
    found = pareto_mix(docs(spark, rows)).collect()
    assert len(found) == 3000
    taken, target, size = collections.Counter(), {}, collections.Counter()
    source = {i: s for i, _, s in rows}
    for r in found:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        size[s] += r["size"]
        target[s] = r["target"]
        assert r["taken"] <= 3 * r["size"] and r["size"] == 1 + r["doc_id"] * 7919 % 40
    assert sum(target.values()) == pytest.approx(sum(size.values()), rel=1e-6)
    for s in size:
        assert abs(taken[s] - target[s]) <= 40 and target[s] <= 3 * size[s] + 1e-3
    assert ordered(found) == ordered(pareto_mix(docs(spark, rows)).collect())
    assert pareto_mix(empty).count() == 0
    few = pareto_mix(edge).collect()
    assert len(few) == len(EDGE) and {r["size"] for r in few if r["doc_id"] in (1, 2, 3)} == {0}
    assert sum(r["taken"] for r in pareto_mix(docs(spark, [(1, None, None), (2, "", "a")])).collect()) == 0


def test_pareto_rates(spark):
    """Higher rates are sampled more often."""
    rows = spark.createDataFrame([(i, "a b c d", "s0" if i < 2000 else "s1", 3.0 if i % 2 else 1.0) for i in range(8000)], "doc_id long, text string, source string, rate double")
    found = pareto_mix(rows, weights=(1, 3), rate="rate").filter("doc_id < 2000").collect()
    often = sum(r["taken"] for r in found if r["doc_id"] % 2)
    seldom = sum(r["taken"] for r in found if not r["doc_id"] % 2)
    assert often > 1.5 * seldom and abs(often + seldom - found[0]["target"]) <= 4


def test_pareto_repeated_rows(spark):
    """Rows alike in everything are drawn one by one, also where they are a third of a source."""
    rows = [(7, "a b c d e f g h i j", "s0")] * 300 + [(i, "w " * (1 + i % 9), "s0") for i in range(100, 700)] + [(i, "x y z", "s1") for i in range(1000, 2500)]
    frame = docs(spark, rows)
    found = pareto_mix(frame.repartition(7), weights=(5, 12)).collect()
    taken = sum(r["taken"] for r in found if r["doc_id"] < 1000)
    target = next(r["target"] for r in found if r["doc_id"] == 7)
    same = collections.Counter(r["taken"] for r in found if r["doc_id"] == 7)
    assert abs(taken - target) <= 10 and len(same) == 2 and sum(same.values()) == 300
    assert ordered(found) == ordered(pareto_mix(frame.repartition(3), weights=(5, 12)).collect())


def test_pareto_unequal_and_capped(spark):
    """Unequal rates keep to the targets, also where some documents reach the cap."""
    rows = [(i, "w " * (1 + i * 31 % 700), f"s{i % 3}") for i in range(3000)]
    for weights in ((5, 2, 1), (1, 1, 30), (8, 1, 1)):
        found = pareto_mix(docs(spark, rows), weights=weights, rate=length_rate).collect()
        taken, target, size = collections.Counter(), {}, collections.Counter()
        for r in found:
            s = r["doc_id"] % 3
            taken[s], target[s], size[s] = taken[s] + r["taken"], r["target"], size[s] + r["size"]
            assert r["taken"] <= 3 * r["size"]
        assert all(abs(taken[s] - target[s]) <= 700 for s in size)
        copies = lambda low, high: [r["taken"] / r["size"] for r in found if low <= r["size"] < high and target[r["doc_id"] % 3] < 2.5 * size[r["doc_id"] % 3]]  # noqa: E731, B023
        assert sum(copies(512, 800)) / len(copies(512, 800)) > 1.5 * sum(copies(1, 16)) / len(copies(1, 16))


# Tokenisers ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return PieceBpe(open(PIECES, "rb").read())


def test_piece_bpe_on_noise(pieces):
    dice = random.Random(3)
    letters = "abcdefgh  \n\t▁éñß中文\U0001f600.,;'\"<>/\\0123²½ǆ́x"
    for k in range(400):
        text = "".join(dice.choice(letters) for _ in range(dice.randrange(0, 60)))
        ids = list(memoryview(pieces.encode(text)).cast("I"))
        assert ids == pieces.library.encode(text, add_bos=True, add_eos=True)
        assert pieces.decode(ids) == pieces.library.decode(ids)


def test_piece_bpe_agendas(pieces):
    """Scanned and heaped agendas join alike, whatever the length; long chunks equal the library's."""
    dice = random.Random(5)
    for length in [1, 2, 3, 31, 32, 33, 34, 200, 5000] + [dice.randrange(1, 80) for _ in range(300)]:
        chunk = "".join(dice.choice(dice.choice(["aab", "thergnilos", "é中ß😀", "....--"])) for _ in range(length))
        assert pieces._join_short(chunk) == pieces._join_long(chunk)
        text = "".join(c for c in chunk if c.isalpha())
        assert list(memoryview(pieces.encode(text)).cast("I")) == pieces.library.encode(text, add_bos=True, add_eos=True)


def test_encode_decode(edge, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = collections.Counter(map(tuple, encode_decode(edge, PIECES).collect()))
    expected = collections.Counter()
    for i, t, _ in EDGE:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        expected[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())] += 1
    assert found == expected
    kept = encode_decode(edge, PIECES, keep_ids=True).filter("doc_id = 4").first()
    assert kept["ids"] == sp.encode("one", add_bos=True, add_eos=True) and kept["decoded"] == "one"
    assert encode_decode(empty, PIECES).count() == 0


def test_tokenisers_on_all_documents(spark, sf_dir):
    """Every document of the smallest data set, against the libraries on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "") for r in frame.select("doc_id", "text").collect()]
    sp, whole = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(WORDS)
    ids = sp.encode([t for _, t in rows], add_bos=True, add_eos=True)
    expected = [(i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(x).encode()).hexdigest()) for (i, _), x in zip(rows, ids, strict=True)]
    assert ordered(encode_decode(frame, PIECES).collect()) == ordered(expected)
    counts = [len(whole.encode(t, add_special_tokens=False)) for _, t in rows]
    assert ordered(count_tokens(frame, WORDS).collect()) == ordered((i, len(t.encode()), n, n > 2048) for (i, t), n in zip(rows, counts, strict=True))


def test_token_counts(edge, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    rows = EDGE + [(20, "a<|endoftext|>b <|startoftext|> ΟΔΟΣ can't e ́ x y", "a")]
    df = edge.select("doc_id", "text").union(edge.sparkSession.createDataFrame([rows[-1][:2]], "doc_id long, text string"))
    for split in (True, False):
        found = collections.Counter(map(tuple, count_tokens(df, WORDS, limit=10, split=split).collect()))
        assert found == collections.Counter((i, len((t or "").encode()), n, n > 10) for i, t, _ in rows for n in [len(whole.encode(t or "", add_special_tokens=False))])
    assert count_tokens(empty, WORDS).count() == 0
    assert counter(*load(PIECES))(["", "one two"])[0] == 0
    assert list(by_bytes(["ab", "é", "x" * 9, "y"], 4)) == [["ab", "é"], ["x" * 9], ["y"]]


# Search -------------------------------------------------------------------------


def test_pivot_topk_by_brute_force(spark):
    dice = np.random.default_rng(5)
    vectors = dice.normal(size=(1500, 8)).round(3) * 0.2
    vectors[700:1200] = vectors[0]  # one vector holds a third of all rows
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    rows += [(2000, None), (2050, [float("nan")] * 8), (2051, [None] * 8), (2052, [float("inf")] * 8), (2100, [0.5, -0.5]), (2150, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("id"), F.lit(2).alias("v"))
    found = collections.defaultdict(list)
    for r in pivot_topk(df, F.col("vec_id") % 50 == 0, k=5).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    fine = {i: np.array([int(np.floor(256.0 * np.float64(np.float32(x)))) for x in [*v, *[0.0] * (8 - len(v))]]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    assert set(found) == {i for i in fine if i % 50 == 0}
    ids = np.array(sorted(fine))
    matrix = np.stack([fine[i] for i in ids])
    for q, got in found.items():
        scores = matrix @ fine[q]
        best = sorted((-int(s), int(i)) for s, i in zip(scores, ids, strict=True) if i != q)[:5]
        assert sorted(got) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_pivot_topk_small(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (50, [3.0, 1.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert pivot_topk(df, F.col("vec_id") % 50 == 0).count() == 4
    assert pivot_topk(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    huge = spark.createDataFrame([(0, [3e30, 1.0]), (1, [3e30, 1.0])], "vec_id long, embedding array<float>")
    assert pivot_topk(huge, F.col("vec_id") == 0).first()["score"] == (1 << 63) - 1


def test_pivot_topk_repeated_query(spark):
    """A query row that comes twice asks once, with all its neighbours; of two vectors the least one asks."""
    dice = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(dice.normal(size=(300, 4)).round(2))]
    once = pivot_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 50)
    twice = pivot_topk(spark.createDataFrame([*rows, rows[50], rows[50]], "vec_id long, embedding array<double>"), F.col("vec_id") == 50)
    assert ordered(twice.collect()) == ordered(once.collect()) and twice.count() == 5
    other = pivot_topk(spark.createDataFrame([*rows, (50, rows[7][1])], "vec_id long, embedding array<double>"), F.col("vec_id") == 50).collect()
    scores = lambda q: sorted((-int(np.floor(256 * np.array(v)) @ np.floor(256 * np.array(rows[q][1]))), i) for i, v in rows if i != 50)[:5]
    assert sorted((-r["score"], r["vec_id"]) for r in other) in (scores(50), scores(7))


# Near duplicates ------------------------------------------------------------------


def brute_links(texts):
    sets = {}
    for i, t in texts:
        w = [x for x in re.split(r"[ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = list(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, links


def expected_join(texts):
    sets, links = brute_links(texts)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    count = collections.Counter()
    for a, b in links:
        count[a] += 1
        count[b] += 1
        ra, rb = sorted((root(a), root(b)))
        up[rb] = ra
    return ordered((i, len(s), root(i), count[i]) for i, s in sets.items())


def near_texts(seed, families, members, spread):
    dice = random.Random(seed)
    rows, n = [], 0
    for f in range(families):
        base = [f"w{dice.randrange(4000)}" for _ in range(dice.randrange(6, 160))]
        for _ in range(members):
            copy = list(base)
            for _ in range(dice.randrange(0, spread)):
                copy[dice.randrange(len(copy))] = f"e{dice.randrange(10**6)}"
            rows.append((n, " ".join(copy)))
            n += 1
    return rows


@pytest.mark.parametrize("families, members, spread", [(60, 4, 4), (2, 60, 5), (40, 1, 1)])
def test_ngram_join_by_brute_force(spark, families, members, spread):
    rows = near_texts(families, families, members, spread) + [(10_001, None), (10_002, ""), (10_003, "a b"), (10_004, "A  b"), (10_005, "a b c d e"), (10_006, " \n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(0).alias("node"), F.lit(0).alias("_n"))
    assert ordered(ngram_join(df).collect()) == expected_join(rows)


def test_ngram_join_large_groups(spark, monkeypatch):
    """With small bounds, clusters, blocks and pairs all take part."""
    from blocklens.llm import ngram_join as module

    for name, value in (("_SMALL", 3), ("_BLOCK", 5), ("_PART_BYTES", 2000), ("_SLICE_CHARS", 500)):
        monkeypatch.setattr(module, name, value)
    rows = near_texts(7, 3, 45, 6) + [(i + 1000, t) for i, t in near_texts(8, 25, 3, 3)]
    assert ordered(ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == expected_join(rows)


def test_ngram_join_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "x")], "doc_id long, text string")
    assert ordered(ngram_join(df).collect()) == ordered([(1, 2, 1, 2), (1, 2, 1, 2), (2, 2, 1, 2), (3, 1, 3, 0)])
    assert ngram_join(df.limit(0)).count() == 0


def test_ngram_join_null_ids(spark, monkeypatch):
    """A row without an id links its neighbours, whole or pair by pair."""
    from blocklens.llm import ngram_join as module

    words = [f"w{i}" for i in range(60)]
    a, b, c = (" ".join(words[k : k + 50]) for k in (0, 4, 8))
    df = spark.createDataFrame([(1, a), (None, b), (3, c), (None, None)], "doc_id long, text string")
    expected = ordered([(1, 46, 1, 1), (None, 46, 1, 2), (3, 46, 1, 1), (None, 0, None, 0)])
    assert ordered(ngram_join(df).collect()) == expected
    monkeypatch.setattr(module, "_SMALL", 1)
    assert ordered(ngram_join(df).collect()) == expected


def test_ngram_join_edge_rows(spark, edge):
    """Nulls, very long texts, repeated rows and clashing column names."""
    found = collections.Counter(map(tuple, ngram_join(edge).collect()))
    distinct = {(i, t) for i, t, _ in EDGE}
    expected = collections.Counter({r: sum(i == r[0] for i, _, _ in EDGE) for r in expected_join(sorted(distinct, key=repr))})
    twice = next(r for r in expected if r[0] == 10)
    expected[(*twice[:3], 1)] = expected.pop(twice)  # the repeated row links with its copy
    assert found == expected


def test_ngram_join_stays_by_row(spark):
    """Of a group one row stays; a row that only shares its id with a near copy stays, too."""
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words[:50]), " ".join(words[2:52])
    df = spark.createDataFrame([(1, a), (7, b), (7, "quite another text"), (None, a.upper()), (9, None), (9, None)], "doc_id long, text string")
    found = ngram_join(df, stays=True).collect()
    assert ordered((r["doc_id"], r["n_shingles"], r["stays"]) for r in found) == ordered([(1, 46, True), (7, 46, False), (7, 1, True), (None, 46, False), (9, 0, True), (9, 0, True)])


def test_trie_walk():
    dice = random.Random(1)
    for _ in range(60):
        pool = sorted(dice.sample(range(10**6), 60))
        sets = [np.array(sorted(dice.sample(pool, dice.randrange(1, 60))), np.uint64) for _ in range(25)]
        sets += [sets[0], sets[3][:-1]] if len(sets[3]) > 1 else [sets[0]]
        trie = Trie(sets)
        for t in ((4, 5), (1, 2), (1, 1)):
            for x in sets:
                found = sorted(trie.walk(x, t).tolist())
                assert found == [i for i, s in enumerate(sets) if len(np.intersect1d(x, s)) >= needed(len(x), len(s), t)]


# Licences ---------------------------------------------------------------------------


def test_license_scan(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        ("a/LICENSE", f"some notes here and there\n{mit}\n" + "body of the licence goes on and on " * 30), ("a/b/x.py", "print(1)"), ("a/b/c/y.py", f"# {gpl}\n" + "code " * 40),
        ("a/b/c/COPYING", gpl), ("a/b/c/z.py", "more"), ("other/w.py", None), ("root.txt", ""), ("a/b/c/z.py", "more"), (None, mit),
    ]
    df = spark.createDataFrame(rows, "path string, text string").select("*", F.lit(1).alias("score"), F.lit(1).alias("_dir"))
    found = {(r["path"], r["how"]): r for r in license_scan(df).collect()}
    assert license_scan(df).count() == len(rows)
    assert found[("a/b/x.py", "inherited")]["license"] == "MIT" and found[("a/b/x.py", "inherited")]["from_dir"] == "a"
    assert found[("a/b/c/y.py", "own")]["license"] == "GPL-3.0" and not found[("a/b/c/y.py", "own")]["is_license_file"]
    assert found[("a/b/c/z.py", "inherited")]["license"] == "GPL-3.0" and found[("a/b/c/z.py", "inherited")]["from_dir"] == "a/b/c"
    assert found[("", "own")]["is_license_file"] and found[("root.txt", "inherited")]["license"] == "MIT" and found[("other/w.py", "inherited")]["from_dir"] == ""
    assert license_scan(df.limit(0)).count() == 0


def test_license_scan_counts_all_terms(spark):
    """Ordinary words after a notice weigh by the files that hold them, rare words in full."""
    notices = ["Licensed under the Apache License, Version 2.0, for that.", "Released under the MIT License for that.", "Released under the MIT License qwertz zuiop asdfg hjkl yxcv."]
    rows = [(f"d{i}/x.txt", t) for i, t in enumerate(notices)] + [(f"e/{i}.txt", f"and that is for word{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "path string, text string")
    found = {r["path"]: r for r in license_scan(df).collect()}
    assert [found[f"d{i}/x.txt"]["own_license"] for i in range(3)] == ["Apache-2.0", "MIT", None]
    idf = lambda n: round(math.log((len(rows) + 1) / (n + 1)) + 1, 6)
    held = {"released": 2, "under": 3, "the": 3, "mit": 2, "license": 3, "for": 402, "that": 402}
    known, whole = (sum(idf(held[t]) ** 2 for t in some) for some in (["released", "under", "the", "mit", "license"], held))
    assert found["d1/x.txt"]["score"] == pytest.approx(math.sqrt(known / whole), abs=2e-6)


def test_license_scan_headers(spark):
    """Wrapped headers and the starts of licence files are compared with their lines joined."""
    gpl = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n *\n * more of the code\n"
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"
    texts = {
        "GPL-3.0": "/*\n" + gpl, "ISC": f"Copyright 2020\n\n{isc}\nand so on", "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
        "MIT": "Licensed under the MIT License.", "Apache-2.0": "  Apache License\n  Version 2.0, January 2004\n  http://www.apache.org/licenses/\n\nTERMS AND CONDITIONS", "MIT OR EPL-2.0": "# SPDX-License-Identifier: MIT OR EPL-2.0\ncode",
        "AGPL-3.0": gpl.replace("General", "Affero General"), "Unlicense": "This is free and unencumbered software released into the public domain.", "none": "any to of the and software",
    }
    df = spark.createDataFrame([(f"{i}/x.c", t, name) for i, (name, t) in enumerate(texts.items())], "path string, text string, name string")
    found = {r["name"]: r["own_license"] or "none" for r in license_scan(df, key_cols=("name",)).collect()}
    assert found == {name: name for name in texts}


def test_license_scan_long_texts_and_ties(spark):
    """A notice deep inside a very long paragraph line is found; of equal cosines the earlier template wins."""
    mit = "Released under the MIT License."
    rows = [("a/long.txt", "lorem ipsum dolor " * 60_000 + "\n" + mit + "\n" + "sit amet " * 20_000), ("a/twice.txt", f"{mit}\n{mit}"), ("a/twice.txt", f"{mit}\n{mit}"), ("b/x.txt", None)]
    df = spark.createDataFrame(rows, "path string, text string")
    templates = [("First", mit), ("Second", mit)]
    found = ordered((r["path"], r["own_license"], r["is_license_file"]) for r in license_scan(df, templates=templates).collect())
    assert found == ordered([("a/long.txt", "First", False), ("a/twice.txt", "First", True), ("a/twice.txt", "First", True), ("b/x.txt", None, False)])


# Toxicity ---------------------------------------------------------------------------


def toxic_texts(seed, count):
    dice = random.Random(seed)
    parts = ["ba", "do", "ki", "lu", "me", "ra", "so", "ti", "ven", "zor"]
    word = lambda: "".join(dice.choice(parts) for _ in range(dice.randrange(1, 4)))
    rows = []
    for i in range(count):
        text = [word() for _ in range(dice.randrange(5, 60))]
        if y := int(dice.random() < 0.3):
            for _ in range(3):
                text.insert(dice.randrange(len(text)), dice.choice(["grumpus", "nitwitty", "foulbeast"]))
        rows.append((i, " ".join(text), y))
    return rows


def test_toxicity(spark, edge, empty):
    rows = toxic_texts(1, 900)
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(i, None) for i in range(5)], "doc_id long, toxic int")
    model = fit(sample(df, labels))
    found = {r["doc_id"]: r for r in score_texts(df, model).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for i, r in found.items())
    held = [(y, found[i]["predicted"]) for i, _, y in rows if found[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert not {r["_id"] for r in sample(df, labels).collect()} & {i for i, r in found.items() if r["held_out"]}
    for text in ("ba do ki grumpus", "ba do GRUMPUS!!", "ba g.rumpus", "ba g r u m p u s do", "nit-witty", "ki foul_beast"):
        assert score_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()["predicted"] == 1, text
    rest = score_texts(edge, model).collect()
    assert len(rest) == len(EDGE) and all(r["predicted"] == 0 for r in rest if r["doc_id"] in (1, 2, 3))
    assert score_texts(empty, model).count() == 0
    carried = score_texts(edge, model, carry=True)
    assert carried.columns == [*edge.columns, "_score", "_predicted"]


def test_toxicity_without_labels():
    assert train([], []).probability(None) == 0.0 and train(["a b"], [1]).probability(5.0) == 1.0
    assert isinstance(train(["a b", "c d"], [1, 0]), Model)
    assert words("I d i o t, x") == ["idiotx"] and len(words("z" * 100)) == 8 and words("...") == []


def test_kernel_by_brute_force():
    """The gapped-subsequence kernel, written out over all places of all subsequences."""
    import itertools

    def features(s):
        s, out, norm = f"\x02{s}\x03", collections.Counter(), 0.0
        for size in (3, 4):
            for at in itertools.combinations(range(len(s)), size):
                span = at[-1] - at[0]
                if span < 7:
                    value = 0.7 ** (span - size + 1)
                    out["".join(s[i] for i in at)] += value
                    norm += value * value
        return {k: v / math.sqrt(norm) for k, v in out.items()}

    strings = ["idiot", "i.d.i.o.t", "idjot", "table", "tableau", "grumpus", "a", "\u00e9t\u00e9"]
    found = kernels(strings, strings)
    for i, a in enumerate(map(features, strings)):
        for j, b in enumerate(map(features, strings)):
            assert found[i][j] == pytest.approx(sum(v * b.get(k, 0.0) for k, v in a.items()), abs=0.02)  # features are hashed to 2^20
    assert found[0][1] > 3 * found[0][3]


def test_toxicity_balanced_and_few_labels(spark):
    """Without a word that stands out the best ones begin; repeated rows have one score."""
    rows = [r for r in toxic_texts(3, 400) if r[2]][:40] + [r for r in toxic_texts(5, 400) if not r[2]][:40]
    model = train([t for _, t, _ in rows], [y for _, _, y in rows])
    assert model.table is not None
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(rows)] * 2, "doc_id long, text string")
    found = score_texts(df, model).collect()
    assert sum((r["predicted"] == 1) == bool(rows[r["doc_id"]][2]) for r in found) >= 0.9 * len(found)
    assert len({(r["doc_id"], r["score"]) for r in found}) == len(rows)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert sample(df, labels).count() == 0 and fit(sample(df, labels)).probability(None) == 0.0


def test_sample_is_bounded_by_ids(spark):
    df = spark.createDataFrame([(3, "b")] * 50 + [(3, "a")] * 50 + [(4, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (4, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    assert {tuple(r) for r in sample(df, labels).collect()} <= {(3, "a", 1), (4, "c", 0)} and sample(df, labels).count() <= 2
