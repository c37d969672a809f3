"""Whole runs: pack and unpack block archives, zip and unzip ZIP files."""

from __future__ import annotations

import functools
import json
import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.checksum import fold_crc32
from ..operators import blocks as B
from ..operators import codecs as C
from ..operators import entries as E
from ..operators import frames as Z
from ..sources import register, tree
from ..sources.formats import DEFAULT_BLOCK
from ..sources.placed import extract_blocks, extract_zip, work_folder, write_archive

#: Parts of a scratch tree that are packed one after another.
_WAVES = 4


def probed_blocks(payloads: DataFrame, keys: list[str], block_size: int) -> DataFrame:
    """Blocks with ``data, byte_count, entropy`` of whole payloads."""
    return B.block_entropy(B.split_blocks(payloads, block_size, keys).withColumn("_d", F.col("data")), [*keys, "block_idx", "raw_off", "raw_len", "_d"]).withColumnRenamed("_d", "data")


def packed_blocks(spark: SparkSession, root: str, level: int = 3, block_size: int = DEFAULT_BLOCK, exclude_hidden: bool = False, probe: bool = True, min_probe_bytes: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries, compressed blocks and skips of a tree."""
    entries, skips = tree.walk(spark, root, exclude_hidden)
    return entries, _compressed(entries, level, block_size, probe, min_probe_bytes), skips


def _compressed(entries: DataFrame, level: int, block_size: int, probe: bool, min_probe_bytes: int = 0) -> DataFrame:
    data = tree.contents(entries, block_size)
    if probe:
        data = B.block_entropy(data.withColumn("_d", F.col("data")), ["entry_idx", "block_idx", "raw_off", "raw_len", "_d"], min_probe_bytes=min_probe_bytes).withColumnRenamed("_d", "data")
    else:
        data = data.withColumn("entropy", F.lit(0.0))
    return C.compress_blocks(data, level, probe)


def _waves(entries: DataFrame, scratch: bool) -> Iterator[tuple[int, DataFrame]]:
    """All entries at once; of a scratch tree a quarter at a time, whose files go once the caller is through with them."""
    if not scratch:
        yield 0, entries
        return
    for k in range(_WAVES):
        part = entries.filter(F.col("entry_idx") % _WAVES == k)
        yield k, part
        tree.discard(part)


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def pack(spark: SparkSession, root: str, target: str, level: int = 3, block_size: int = DEFAULT_BLOCK, exclude_hidden: bool = False, probe: bool = True, overwrite: bool = False, scratch: bool = False) -> dict:
    """Writes a block archive; returns its statistics.

    The files of a ``scratch`` tree are removed while it is packed, also if
    packing fails later: tree, packed blocks and archive need not fit the disk
    at once.
    """
    register(spark)
    began = time.time()
    if os.path.exists(target) and not overwrite:
        raise FileExistsError(f"{target} exists")
    E.preflight(target, None, directory=True)
    with work_folder(spark, target) as save:
        entries = save(tree.walk(spark, root, exclude_hidden)[0], "entries-walked")
        columns = ["entry_idx", "block_idx", "raw_off", "raw_len", "crc32", "comp_len", F.col("frame").alias("body")]
        blocks = _union([save(_compressed(part, level, block_size, probe).select(columns), f"blocks-{k}") for k, part in _waves(entries, scratch)])
        rows = entries.join(fold_crc32(blocks, ["entry_idx"]).drop("size"), "entry_idx", "left")
        size = F.when(F.col("is_directory"), 0).otherwise(block_size).cast("long")
        rows = rows.select("entry_idx", "name", "is_directory", "unix_mode", "mtime", F.lit("zstd").alias("method"), size.alias("block_size"), F.col("size").alias("uncompressed_size"), F.coalesce("crc32", F.lit(0)).alias("crc32"))
        rows = save(rows, "walked")
        write_archive(rows, blocks.select("entry_idx", "block_idx", "body"), target, False, overwrite, save)
        found = blocks.agg(F.sum("raw_len"), F.sum("comp_len")).first()
        count = rows.count()
    return {"entries": count, "bytes_in": found[0] or 0, "bytes_out": found[1] or 0, "elapsed": time.time() - began}


def _payloads(spark: SparkSession, kind: str, archive: str, names: list[str] | None) -> DataFrame:
    """Payload rows of an archive; with ``names``, the reader leaves out all other entries in any session."""
    rows = spark.read.format(kind).option("payload", True)
    return (rows if names is None else rows.option("names", json.dumps(sorted(set(names))))).load(archive)


def unpacked(spark: SparkSession, archive: str, names: list[str] | None = None, check: bool = True) -> DataFrame:
    """``entry_idx, name, content, is_directory, unix_mode, mtime`` of a block archive's entries, checked.

    A file's content is one cell here; ``unpack`` writes entries of any size block by block.
    """
    register(spark)
    entries = spark.read.format("blockarchive").load(archive)
    frames = _payloads(spark, "blockarchive", archive, names)
    if names is not None:
        entries = E.filter_entries(entries, names)
    entries = E.safe_entries(entries)
    keys = ["archive", "entry_idx"]
    raw = C.decode_blocks(frames, [*keys, "block_idx", "raw_off"])
    files = raw.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block_idx", "raw"))).alias("_b")).select(*keys, F.aggregate("_b", F.lit(b""), lambda s, b: F.concat(s, b.raw)).alias("content"))
    out = entries.join(files, keys, "left").withColumn("content", F.when(~F.col("is_directory"), F.coalesce("content", F.lit(b""))))
    if check:
        good = F.col("is_directory") | ((F.octet_length("content") == F.col("uncompressed_size")) & (F.crc32("content") == F.col("crc32")))
        out = out.filter(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("integrity: "), F.col("name"))).cast("boolean")))
    return out.select("entry_idx", "name", "content", "is_directory", "unix_mode", "mtime")


def unpack(spark: SparkSession, archive: str, target: str, names: list[str] | None = None, check: bool = True) -> dict:
    """Extracts a block archive; each block is decoded and written on its own, whatever the entry's size."""
    register(spark)
    began = time.time()
    entries = spark.read.format("blockarchive").load(archive)
    frames = _payloads(spark, "blockarchive", archive, names)
    if names is not None:
        entries = E.filter_entries(entries, names)
    os.makedirs(target, exist_ok=True)
    with work_folder(spark, os.path.join(target, ".unpack")) as save:
        entries = save(E.safe_entries(entries), "entries")
        E.preflight(target, entries.agg(F.sum("uncompressed_size")).first()[0] or 0)
        raw = C.decode_blocks(frames, ["archive", "entry_idx", "name", "raw_off"])
        found = extract_blocks(entries, raw, target, check, save).agg(F.count("*"), F.sum("size")).first()
    return {"entries": found[0], "bytes_out": found[1] or 0, "elapsed": time.time() - began}


def literal_report(spark: SparkSession, archive: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Inner-block and frame distributions and the gate of an archive; every frame counts once."""
    register(spark)
    frames = spark.read.format("blockarchive").option("payload", True).load(archive)
    classified = Z.classify(frames, ["archive", "entry_idx", "block_idx"])
    inner = Z.inner_buckets(classified)
    return inner, Z.frame_buckets(classified), Z.gate(inner)


def zip_tree(spark: SparkSession, root: str, target: str, level: int = 6, exclude_hidden: bool = False, probe: bool = True, overwrite: bool = False, chunk: int = 8 << 20, probe_block: int = 1 << 20, scratch: bool = False) -> dict:
    """Writes a ZIP file; entries above ``chunk`` bytes are deflated chunk by chunk, as one stream.

    Entries whose mean entropy says that they will not shrink are stored, and
    so are those that did not.  ``scratch`` as in ``pack``.
    """
    register(spark)
    began = time.time()
    if os.path.exists(target) and not overwrite:
        raise FileExistsError(f"{target} exists")
    E.preflight(target, None, directory=True)
    with work_folder(spark, target) as save:
        entries = save(tree.walk(spark, root, exclude_hidden)[0], "walked")
        columns = ["entry_idx", "block_idx", "raw_off", "raw_len", "crc32", "body"]
        parts, smaller = [], []
        for k, wave in _waves(entries, scratch):
            tried = wave.filter("NOT is_directory AND size > 0") if level > 0 else wave.limit(0)
            if probe and level > 0:
                pieces = B.split_blocks(tree.contents(tried, max(chunk, probe_block) // probe_block * probe_block).withColumnRenamed("block_idx", "chunk"), probe_block, ["entry_idx", "chunk"], "data")
                means = B.mean_entropy(B.block_entropy(pieces, ["entry_idx", "chunk", "block_idx"]), ["entry_idx"])
                tried = tried.join(means, "entry_idx").filter(~S.incompressible(F.col("mean_entropy"), 7.5)).drop("mean_entropy")
            chunks = tree.contents(tried, chunk).join(tried.select("entry_idx", "size"), "entry_idx").withColumn("crc32", F.crc32("data"))
            packed = save(chunks.withColumn("body", C.deflate_part(F.col("data"), F.col("raw_off") + F.col("raw_len") == F.col("size"), level)).select(columns), f"packed-{k}")
            sums = packed.groupBy("entry_idx").agg(F.sum(F.octet_length("body")).alias("_out"), F.sum("raw_len").alias("_in"))
            shrunk = save(sums.filter("_out < _in").select("entry_idx"), f"shrunk-{k}")
            plain = tree.contents(wave.join(shrunk, "entry_idx", "left_anti"), chunk).withColumn("crc32", F.crc32("data")).withColumnRenamed("data", "body")
            parts += [packed.join(shrunk, "entry_idx", "left_semi").select(columns), save(plain.select(columns), f"stored-{k}")]
            smaller.append(shrunk)
        blocks, shrunk = _union(parts), _union(smaller)
        method = F.when(F.col("_s").isNotNull(), "deflate").otherwise("stored")
        rows = entries.join(fold_crc32(blocks, ["entry_idx"]).drop("size"), "entry_idx", "left").join(shrunk.withColumn("_s", F.lit(1)), "entry_idx", "left")
        rows = rows.select("entry_idx", "name", "is_directory", "unix_mode", "mtime", method.alias("method"), F.lit(0).cast("long").alias("block_size"), F.col("size").alias("uncompressed_size"), F.coalesce("crc32", F.lit(0)).alias("crc32"))
        rows = save(rows, "rows")
        write_archive(rows, blocks.select("entry_idx", "block_idx", "body"), target, True, overwrite, save)
        count, size = rows.agg(F.count("*"), F.sum("uncompressed_size")).first()
        out = blocks.agg(F.sum(F.octet_length("body"))).first()[0]
    return {"entries": count, "bytes_in": size or 0, "bytes_out": out or 0, "elapsed": time.time() - began}


def unzipped(spark: SparkSession, archive: str, names: list[str] | None = None, check: bool = True) -> DataFrame:
    register(spark)
    entries = spark.read.format("ziparchive").load(archive)
    bodies = _payloads(spark, "ziparchive", archive, names)
    if names is not None:
        entries = E.filter_entries(entries, names)
    entries = E.safe_entries(entries)
    keys = ["archive", "entry_idx"]
    stored = bodies.filter("method = 'stored'").select(*keys, F.col("body").alias("content"))
    packed = bodies.filter("method = 'deflate'").select(*keys, C.inflate(F.col("body"), F.col("uncompressed_size")).alias("content"))
    out = entries.join(stored.unionByName(packed), keys, "left").withColumn("content", F.when(~F.col("is_directory"), F.coalesce("content", F.lit(b""))))
    if check:
        good = F.col("is_directory") | ((F.octet_length("content") == F.col("uncompressed_size")) & (F.crc32("content") == F.col("crc32")))
        out = out.filter(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("integrity: "), F.col("name"))).cast("boolean")))
    return out.select("entry_idx", "name", "content", "is_directory", "unix_mode", "mtime")


def unzip(spark: SparkSession, archive: str, target: str, names: list[str] | None = None, check: bool = True) -> dict:
    """Extracts a ZIP file; each entry is unpacked as a stream, whatever its size."""
    register(spark)
    began = time.time()
    entries = spark.read.format("ziparchive").load(archive)
    if names is not None:
        entries = E.filter_entries(entries, names)
    os.makedirs(target, exist_ok=True)
    with work_folder(spark, os.path.join(target, ".unzip")) as save:
        entries = save(E.safe_entries(entries), "entries")
        E.preflight(target, entries.agg(F.sum("uncompressed_size")).first()[0] or 0)
        found = extract_zip(entries, target, check, save).agg(F.count("*"), F.sum("size")).first()
    return {"entries": found[0], "bytes_out": found[1] or 0, "elapsed": time.time() - began}
