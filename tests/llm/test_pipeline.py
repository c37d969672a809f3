"""The pipeline's stages on a fixture, each against a plain version."""

import collections

import pytest
from pyspark.sql import functions as F
from test_llm import brute_links, norm, toxic_texts

pipeline = pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic texts, copies and near copies, and labels of some of them."""
    top = tmp_path_factory.mktemp("corpus")
    rows = toxic_texts(4, 700)
    texts = {i: t for i, t, _ in rows}
    for k in range(60):
        texts[1000 + k] = texts[k].replace(" ", "  ")  # copies but for white space
        texts[2000 + k] = texts[100 + k] + " bado"  # near copies where the text is long
    texts[3000], texts[3001] = None, ""
    docs = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top), docs, {i: y for i, _, y in rows}


def test_stages(spark, folder):
    top, rows, labels = folder
    docs = spark.read.parquet(f"{top}/documents.parquet")
    by_id = {r[0]: r[1] for r in rows}
    stages = dict(pipeline.STAGES)
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mix", "encode"]

    clean = stages["toxicity"](spark, docs, top).cache()
    kept = {r["doc_id"] for r in clean.collect()}
    wrong = sum((i in kept) == bool(y) for i, y in labels.items())
    assert clean.columns == pipeline.COLUMNS and wrong <= 0.03 * len(labels) and {3000, 3001} <= kept

    single = stages["exact dedup"](spark, clean, top).cache()
    first = {}
    for i in sorted(kept):
        first.setdefault(norm(by_id[i]), i)
    assert {r["doc_id"] for r in single.collect()} == set(first.values()) and single.columns == pipeline.COLUMNS

    apart = stages["near dedup"](spark, single, top).cache()
    texts = [(i, by_id[i]) for i in sorted(first.values())]
    _, links = brute_links(texts)
    up = {i: i for i, _ in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    assert {r["doc_id"] for r in apart.collect()} == {i for i in up if root(i) == i} and len(links) > 5

    mixed = stages["mix"](spark, apart, top).cache()
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == pipeline.COLUMNS and max(copies.values()) <= 3
    size = lambda i: len((by_id[i] or "").split())
    total = sum(size(r["doc_id"]) for r in apart.collect())
    assert abs(sum(size(i) * n for i, n in copies.items()) - total) <= 4 * 60

    encoded = stages["encode"](spark, mixed, top)
    assert collections.Counter(r["doc_id"] for r in encoded.collect()) == copies


def test_run(spark, folder):
    out = pipeline.run(spark, folder[0])
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100
    assert pipeline.ORACLE_SQL is None
    assert out.agg(F.min("n_tokens")).first()[0] >= 2


def test_edge_tables(spark, tmp_path):
    """Empty tables, no labels, a repeated id with another text, ties, nulls and clashing names."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _t string, _row string, size long, stays string"
    words = " ".join(f"w{i}" for i in range(50))
    rows = [(1, words, "en", "a"), (2, words + " more", "en", "a"), (2, "another text of its own", "en", "b"), (3, None, None, None), (None, "no id here", "en", "a"), (1, words, "en", "a"), (5, "tie one", "en", "b"), (6, "tie two", "en", "b")]
    for name, some in (("empty", []), ("small", rows)):
        spark.createDataFrame([(*r, None, "x", "y", 7, "z") for r in some], kinds).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 0, 1)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    stages = dict(pipeline.STAGES)
    docs = spark.read.parquet(f"{tmp_path}/small/documents.parquet")
    clean = stages["toxicity"](spark, docs, f"{tmp_path}/small")
    assert clean.columns == pipeline.COLUMNS and clean.count() == len(rows)
    single = stages["exact dedup"](spark, clean, f"{tmp_path}/small")
    assert single.count() == len(rows) - 1
    apart = stages["near dedup"](spark, single, f"{tmp_path}/small")
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:4]) for r in apart.collect()) == [(0, "no i"), (1, "w0 w"), (2, "anot"), (3, ""), (5, "tie "), (6, "tie ")]
    assert pipeline.run(spark, f"{tmp_path}/small").count() >= 1
