"""Blocks of payloads: splitting, byte histograms, entropy, offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_blocks(payloads: DataFrame, block_size: int, keys: list[str], payload: str = "payload") -> DataFrame:
    """``keys, block_idx, raw_off, raw_len, data``: slices of ``block_size`` bytes, the last one shorter.

    Empty and null payloads have no blocks.
    """
    size = F.octet_length(payload).cast("long")
    rows = payloads.select(*keys, F.col(payload).alias("_p"), size.alias("_n")).filter("_n > 0")
    last = F.call_function("div", F.col("_n") - 1, F.lit(block_size))
    rows = rows.withColumn("block_idx", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    offset = F.col("block_idx").cast("long") * block_size
    return rows.select(*keys, "block_idx", offset.alias("raw_off"), F.least(F.lit(block_size), F.col("_n") - offset).cast("long").alias("raw_len"), F.substring("_p", (offset + 1).cast("int"), F.lit(block_size)).alias("data"))


def block_ranges(entries: DataFrame, block_size: int, keys: list[str], size: str = "size") -> DataFrame:
    """As ``split_blocks``, from sizes alone."""
    rows = entries.select(*keys, F.col(size).cast("long").alias("_n")).filter("_n > 0")
    last = F.call_function("div", F.col("_n") - 1, F.lit(block_size))
    rows = rows.withColumn("block_idx", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    offset = F.col("block_idx").cast("long") * block_size
    return rows.select(*keys, "block_idx", offset.alias("raw_off"), F.least(F.lit(block_size), F.col("_n") - offset).cast("long").alias("raw_len"))


def _counts(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """256 counts for each binary value of an array, and the lengths."""
    if isinstance(data, pa.ChunkedArray):
        data = data.combine_chunks()
    kind = np.int64 if pa.types.is_large_binary(data.type) else np.int32
    offsets = np.frombuffer(data.buffers()[1], kind)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    lengths = np.diff(offsets)
    if data.null_count:
        lengths = np.where(data.is_null().to_numpy(zero_copy_only=False), 0, lengths)
    out = np.zeros((len(data), 256), np.int64)
    if lengths.sum():
        values = np.frombuffer(data.buffers()[2], np.uint8)
        for k, (start, n) in enumerate(zip(offsets[:-1].tolist(), lengths.tolist(), strict=True)):
            if n:
                out[k] = np.bincount(values[start : start + n], minlength=256)
    return out, lengths


def entropy_of(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Shannon entropy in bits per byte, 0 for no bytes, within 0..8."""
    n = np.maximum(lengths, 1).astype(float)
    part = (counts * np.log2(np.maximum(counts, 1))).sum(1) / n
    return np.where(lengths > 0, np.clip(np.log2(n) - part, 0.0, 8.0), 0.0)


def byte_histogram(blocks: DataFrame, keys: list[str], data: str = "data") -> DataFrame:
    """``keys, byte, n``: bins with bytes, counted in one pass over each batch."""
    kinds = [f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in keys]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, _ = _counts(batch.column(len(keys)))
            row, byte = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(row)) for i in range(len(keys))], pa.array(byte.astype(np.int32)), pa.array(counts[row, byte])], names=[*keys, "byte", "n"])

    return blocks.select(*keys, data).mapInArrow(count, ", ".join([*kinds, "byte int", "n long"]))


def total_histogram(blocks: DataFrame, data: str = "data") -> DataFrame:
    """``byte, n`` over all blocks; a batch sends at most 256 rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _counts(batch.column(0))[0].sum(0)
            byte = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(byte.astype(np.int32)), pa.array(counts[byte])], names=["byte", "n"])

    return blocks.select(data).mapInArrow(count, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))


def byte_histogram_plan(blocks: DataFrame, keys: list[str], data: str = "data") -> DataFrame:
    """The same as ``byte_histogram`` by expressions alone, a row per byte: for comparison."""
    pairs = F.explode(F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0)))
    rows = blocks.select(*keys, pairs.alias("_h"))
    return rows.groupBy(*keys, F.conv("_h", 16, 10).cast("int").alias("byte")).agg(F.count("*").alias("n"))


def entropy_plan(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, byte_count, entropy`` from a histogram, by expressions alone."""
    n = F.sum("n")
    bits = F.log2(n) - F.sum(F.col("n") * F.log2("n")) / n
    return histogram.filter("n > 0").groupBy(*keys).agg(n.cast("long").alias("byte_count"), F.greatest(F.lit(0.0), F.least(F.lit(8.0), bits)).alias("entropy"))


def block_entropy(blocks: DataFrame, keys: list[str], data: str = "data", min_probe_bytes: int = 0) -> DataFrame:
    """``keys, byte_count, entropy``; blocks of less than ``min_probe_bytes`` are not probed and count as 0."""
    kinds = [f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in keys]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, lengths = _counts(batch.column(len(keys)))
            bits = np.where(lengths >= min_probe_bytes, entropy_of(counts, lengths), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(lengths), pa.array(bits)], names=[*keys, "byte_count", "entropy"])

    return blocks.select(*keys, data).mapInArrow(probe, ", ".join([*kinds, "byte_count long", "entropy double"]))


def mean_entropy(probed: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, mean_entropy``: entropies weighted by bytes, 0 where there are none."""
    weighted = F.sum(F.col("entropy") * F.col("byte_count")) / F.nullif(F.sum("byte_count"), F.lit(0))
    return probed.groupBy(*keys).agg(F.coalesce(weighted, F.lit(0.0)).alias("mean_entropy"))


def block_offsets(entries: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, block_idx, comp_off, comp_len, raw_off, raw_len`` of entries with block lengths.

    Frames follow each other from ``data_offset`` on; each holds ``block_size``
    bytes, the last one what is left.
    """
    rows = entries.select(*keys, "data_offset", "block_size", "uncompressed_size", F.posexplode("block_lengths").alias("block_idx", "comp_len"))
    before = Window.partitionBy(*keys).orderBy("block_idx").rowsBetween(Window.unboundedPreceding, -1)
    raw = F.col("block_idx").cast("long") * F.col("block_size")
    return rows.select(*keys, "block_idx", (F.col("data_offset") + F.coalesce(F.sum("comp_len").over(before), F.lit(0))).alias("comp_off"), "comp_len", raw.alias("raw_off"), F.least("block_size", F.col("uncompressed_size") - raw).alias("raw_len"))


def runs(entries: DataFrame, large: int, keys: list[str], order: str = "entry_idx", size: str = "size") -> DataFrame:
    """``..., run``: entries of ``large`` bytes or more stand alone, small neighbours share a run (per ``keys``)."""
    is_large = F.col(size) >= large
    seat = Window.partitionBy(*keys).orderBy(order)
    start = is_large | F.coalesce(F.lag(is_large).over(seat), F.lit(True))
    return entries.withColumn("_s", start.cast("long")).withColumn("run", F.sum("_s").over(seat) - 1).drop("_s")
