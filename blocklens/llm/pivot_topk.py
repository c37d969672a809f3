"""Exact top-k inner products over a pivot-distance index.

Largest inner product is nearest neighbour once every vector gets one more
coordinate that brings it to the largest norm (and queries get zero there):
``|q - x|^2 = |q|^2 + M - 2 q.x``.  The index keys each vector by its nearest
pivot and its distance to that pivot; sorted by this key and cut into blocks,
each block is an annulus around its pivot.

A query starts in the block that holds its own row, which gives a first k-th
score and so a radius ``r``.  Then annuli around further pivots are expanded,
nearest pivots first; a block is visited only while ``|d(q, p) - d(x, p)| <= r``
can hold for one of its distances, and the radius shrinks after each round.
No vector outside these bounds can score as high as the k-th, so the result is
exact.  Pivots are centres of a bounded sample; every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, shuffle_partitions

_BLOCK, _SAMPLE, _CALL = 512, 4096, 2048
_ROUNDS = (2, 8, 1 << 30)  # pivots of a query, by distance, that are open after each round
_EXACT = 1 << 53


def quantised(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` per component, x as double; null if the vector takes no part."""
    fine = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("double")))


def _centres(rows: np.ndarray, count: int) -> np.ndarray:
    """Centres of the sample by a few rounds of k-means from evenly spread rows."""
    if len(rows) <= count:
        return rows
    centre = rows[np.linspace(0, len(rows) - 1, count).astype(int)]
    for _ in range(5):
        near = ((rows**2).sum(1)[:, None] - 2 * rows @ centre.T + (centre**2).sum(1)).argmin(1)
        for k in range(count):
            if (near == k).any():
                centre[k] = rows[near == k].mean(0)
    return centre


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of lists as one matrix, shorter ones padded with zeros."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat[offsets[0] : offsets[-1]]
    return out


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond 2^53 in Python integers, held at the ends of 64 bits."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    if most < _EXACT:
        return (queries @ rows.T).astype(np.int64)
    exact = np.frompyfunc(int, 1, 1)
    found = exact(queries).dot(exact(rows).T)
    return np.clip(found, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int, least: int | None) -> list[tuple[int, int]]:
    keep = ids != own
    if least is not None:
        keep &= scores >= least
    scores, ids = scores[keep], ids[keep]
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[scores >= edge], ids[scores >= edge]
    by = np.lexsort((ids, -scores))[:k]
    return list(zip(ids[by].tolist(), scores[by].tolist(), strict=True))


def pivot_topk(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, pivots: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest integer inner products.

    Candidates are all rows with another id (all, if there are fewer than
    ``k``), ties go to the smaller id.  Vectors that are null or hold null or
    non-finite components, and rows without an id, take no part; shorter
    vectors count as padded with zeros.  Repeated rows are candidates each;
    of query rows with one id, the one with the least vector asks.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "pivot-topk")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), quantised(F.col(f"`{vector_col}`"), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = scratch.save(rows.filter("v IS NOT NULL AND id IS NOT NULL"), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    count, width, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not count:
        return empty
    width = max(1, width)
    picked = rows.orderBy(F.xxhash64("id")).limit(_SAMPLE).select("v").toArrow()  # bounded
    sample = _matrix(picked["v"].combine_chunks(), width)
    sample = np.hstack((sample, np.sqrt(np.maximum(0, most - (sample**2).sum(1)))[:, None]))
    centre = _centres(sample, pivots or min(1024, max(16, round(count**0.5 / 4))))
    sent = spark.sparkContext.broadcast(centre)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = sent.value
        for batch in batches:
            v = _matrix(batch.column(1), width)
            up = np.hstack((v, np.sqrt(np.maximum(0, most - (v**2).sum(1)))[:, None]))
            gap = np.sqrt(np.maximum(0, (up**2).sum(1)[:, None] - 2 * up @ centre.T + (centre**2).sum(1)))
            pivot = gap.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(pivot, pa.int32()), pa.array(gap[np.arange(len(v)), pivot])], names=["id", "v", "q", "p", "d"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list = []

        def block(ids, v, q, p, d):
            nonlocal number
            number += 1
            seeds = []
            if q.any():
                products = _products(v[q], v)
                seeds = [(int(own), v[i].tobytes(), _best(s, ids, own, k, None)) for own, i, s in zip(ids[q], np.flatnonzero(q), products, strict=True)]
            return pa.RecordBatch.from_pylist([{"block": number, "p": int(p[0]), "lo": float(d[0]), "hi": float(d[-1]), "ids": ids.tobytes(), "rows": v.tobytes(), "seeds": [{"id": a, "v": b, "best": [{"id": i, "score": s} for i, s in c]} for a, b, c in seeds]}], schema=block_schema)

        def blocks(rest: bool):
            nonlocal held
            if not held:
                return
            ids, v, q, p, d = (np.concatenate(x) for x in zip(*held, strict=True))
            turn = np.flatnonzero(np.diff(p)) + 1
            held, start = [], 0
            for end in [*turn.tolist(), len(ids)]:
                while start < end and (rest or end < len(ids) or end - start >= _BLOCK):
                    stop = min(end, start + _BLOCK)
                    yield block(ids[start:stop], v[start:stop], q[start:stop], p[start:stop], d[start:stop])
                    start = stop
            if start < len(ids):
                held = [(ids[start:], v[start:], q[start:], p[start:], d[start:])]

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                held.append((part.column(0).to_numpy(), _matrix(part.column(1), width), part.column(2).to_numpy(zero_copy_only=False).astype(bool), part.column(3).to_numpy(), part.column(4).to_numpy()))
                yield from blocks(False)
        yield from blocks(True)

    best_type = pa.list_(pa.struct([("id", pa.int64()), ("score", pa.int64())]))
    block_schema = pa.schema([("block", pa.int64()), ("p", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("ids", pa.binary()), ("rows", pa.binary()), ("seeds", pa.list_(pa.struct([("id", pa.int64()), ("v", pa.binary()), ("best", best_type)])))])
    block_type = "block long, p int, lo double, hi double, ids binary, rows binary, seeds array<struct<id:long, v:binary, best:array<struct<id:long, score:long>>>>"
    keyed = rows.mapInArrow(key, "id long, v array<double>, q boolean, p int, d double")
    parts = max(1, min(shuffle_partitions(spark), -(-count // (4 * _BLOCK))), -(-count // 1_000_000))
    index = scratch.save(keyed.repartitionByRange(parts, "p", "d", "id").sortWithinPartitions("p", "d", "id").mapInArrow(cut, block_type), "index")

    seeds = index.select("block", F.explode("seeds").alias("s"))
    queries = seeds.select(F.col("s.id").alias("query"), F.col("s.v").alias("v"), F.col("block").alias("own"), F.col("s.best").alias("best"))
    # each id asks once, with the seeds of one row
    queries = queries.groupBy("query").agg(F.min(F.struct("v", "own", "best")).alias("m")).select("query", "m.*")
    queries = scratch.save(queries, "queries")
    best = scratch.save(queries.select("query", F.explode("best").alias("b")).select("query", F.col("b.id").alias("id"), F.col("b.score").alias("score")), "best-0")
    shapes = scratch.save(index.select("block", "p", "lo", "hi"), "shapes")
    reach = np.full((2, len(centre)), np.inf)  # nearest and farthest vector of each pivot; at most 1024 rows
    reach[1] = -np.inf
    for r in shapes.groupBy("p").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
        reach[:, r["p"]] = r["lo"], r["hi"]
    for turn, upto in enumerate(_ROUNDS):
        from_ = _ROUNDS[turn - 1] if turn else 0
        if from_ >= len(centre):
            break
        bound = best.groupBy("query").agg(F.count("*").alias("_n"), F.min("score").alias("_s")).select("query", F.when(F.col("_n") >= k, F.col("_s")).alias("bound"))
        open_q = queries.join(bound, "query", "left").select("query", "v", "own", "bound")

        def expand(batches: Iterator[pa.RecordBatch], from_=from_, upto=upto) -> Iterator[pa.RecordBatch]:
            centre = sent.value
            for batch in batches:
                out = {"query": [], "p": [], "lo": [], "hi": []}
                for row in batch.select(["query", "v", "bound"]).to_pylist():
                    q = np.append(np.frombuffer(row["v"]), 0.0)
                    gap = np.sqrt(np.maximum(0, ((centre - q) ** 2).sum(1)))
                    r = np.inf if row["bound"] is None else np.sqrt(max(0.0, (q**2).sum() + most - 2.0 * row["bound"]))
                    r += 1e-6 * (1 + r + gap.max()) if np.isfinite(r) else 0
                    turn = np.argsort(gap, kind="stable")[from_:upto]
                    for p in turn[(gap[turn] - r <= reach[1][turn]) & (gap[turn] + r >= reach[0][turn])].tolist():
                        out["query"].append(row["query"])
                        out["p"].append(p)
                        out["lo"].append(gap[p] - r)
                        out["hi"].append(gap[p] + r)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("query", pa.int64()), ("p", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64())]))

        rings = open_q.mapInArrow(expand, "query long, p int, lo double, hi double").alias("r")
        work = rings.join(shapes.alias("b"), (F.col("r.p") == F.col("b.p")) & (F.col("b.lo") <= F.col("r.hi")) & (F.col("b.hi") >= F.col("r.lo"))).select("query", "block")
        work = scratch.save(work.join(queries.select("query", "own"), "query").filter("block != own").drop("own"), f"work-{turn}")
        loads = work.groupBy("block").agg(F.ceil(F.count("*") / F.lit(_CALL)).cast("int").alias("calls"))
        asked = work.join(open_q.select("query", "v", "bound"), "query").join(loads, "block").withColumn("call", F.pmod(F.xxhash64("query"), F.col("calls")).cast("int")).select("block", "call", "query", "v", "bound")
        held = index.select("block", "ids", "rows").join(loads, "block").withColumn("call", F.explode(F.sequence(F.lit(0), F.col("calls") - 1))).select("block", "call", "ids", "rows")

        def score(block: pa.Table, asking: pa.Table) -> pa.Table:
            out = {"query": [], "id": [], "score": []}
            if block.num_rows and asking.num_rows:
                ids = np.frombuffer(block["ids"][0].as_py(), np.int64)
                v = np.frombuffer(block["rows"][0].as_py()).reshape(len(ids), -1)
                rows = asking.to_pylist()
                products = _products(np.stack([np.frombuffer(r["v"]) for r in rows]), v)
                for row, scores in zip(rows, products, strict=True):
                    for i, s in _best(scores, ids, row["query"], k, row["bound"]):
                        out["query"].append(row["query"])
                        out["id"].append(i)
                        out["score"].append(s)
            return pa.table(out, schema=pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.int64())]))

        fresh = held.groupBy("block", "call").cogroup(asked.groupBy("block", "call")).applyInArrow(score, "query long, id long, score long")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        best = scratch.save(best.union(fresh).withColumn("rank", place).filter(F.col("rank") <= k).drop("rank"), f"best-{turn + 1}")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return best.select(F.col("query").alias("query_id"), place.cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
