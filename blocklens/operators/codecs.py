"""Block codecs as Arrow functions: Zstandard frames and raw DEFLATE."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CodecError, IntegrityError, UnsupportedError
from ..functions.checksum import crc32_of_blocks
from ..functions.scalar import block_level, incompressible
from .frames import decode_raw

#: Largest declared size of a block, and of an entry that is deflated whole.
BLOCK_CAP, ENTRY_CAP = 256 << 20, 1 << 30


def zstd_encode(data: bytes, level: int) -> bytes:
    """One complete frame; nothing for nothing."""
    import zstandard

    return zstandard.ZstdCompressor(level=max(1, min(22, level))).compress(data) if data else b""


def zstd_decode(frame: bytes, capacity: int) -> bytes:
    """A frame's bytes, at most ``capacity``."""
    import zstandard

    if not frame:
        return b""
    if capacity > BLOCK_CAP:
        raise CodecError(f"declared block size {capacity} is above the cap of {BLOCK_CAP}")
    try:
        declared = zstandard.frame_content_size(frame)
        if declared > capacity:
            raise CodecError(f"frame declares {declared} bytes, {capacity} fit")
        return zstandard.ZstdDecompressor().decompress(frame, max_output_size=max(1, capacity))
    except zstandard.ZstdError as error:
        raise CodecError(str(error)) from error


def deflate_encode(data: bytes, level: int) -> bytes:
    """Raw DEFLATE of a whole entry; levels above 9 count as 9."""
    if len(data) > ENTRY_CAP:
        raise UnsupportedError(f"an entry of {len(data)} bytes is too large to be deflated whole")
    packer = zlib.compressobj(max(0, min(9, level)), zlib.DEFLATED, -15)
    return packer.compress(data) + packer.flush()


def deflate_chunk(data: bytes, level: int, last: bool) -> bytes:
    """One chunk; chunks put together in order are one DEFLATE stream."""
    packer = zlib.compressobj(max(0, min(9, level)), zlib.DEFLATED, -15)
    return packer.compress(data) + packer.flush(zlib.Z_FINISH if last else zlib.Z_SYNC_FLUSH)


def deflate_decode(data: bytes, expected: int) -> bytes:
    """Exactly ``expected`` bytes, or an error that says what is wrong."""
    reader = zlib.decompressobj(-15)
    try:
        out = reader.decompress(data, expected + 1)
    except zlib.error as error:
        raise CodecError(f"bad DEFLATE data: {error}") from error
    if len(out) > expected:
        raise CodecError(f"more than the expected {expected} bytes")
    if not reader.eof:
        raise CodecError("the DEFLATE stream is cut off")
    if len(out) < expected:
        raise CodecError(f"{len(out)} bytes, {expected} expected")
    return out


def _binary(function: Callable, kind: str = "binary"):
    """A pandas function over binary columns that keeps nulls."""

    @F.pandas_udf(kind)
    def run(data: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else function(d, int(o)) for d, o in zip(data, other, strict=True)], dtype=object)

    return run


def zstd_compress(data: Column, level: Column) -> Column:
    return _binary(zstd_encode)(data, level)


def zstd_decompress(data: Column, capacity: Column) -> Column:
    return _binary(zstd_decode)(data, capacity)


def deflate(data: Column, level: Column) -> Column:
    return _binary(deflate_encode)(data, level)


def inflate(data: Column, expected: Column) -> Column:
    return _binary(deflate_decode)(data, expected)


def compress_blocks(blocks: DataFrame, level: int = 3, downgrade: bool = True, threshold: float = 7.5) -> DataFrame:
    """Adds ``level, frame, comp_len, crc32, disposition`` to blocks with ``data`` and ``entropy``."""
    used = block_level(F.lit(level), F.col("entropy"), downgrade, threshold)
    rows = blocks.withColumn("level", used).withColumn("crc32", F.crc32("data"))
    rows = rows.withColumn("frame", zstd_compress(F.col("data"), F.col("level"))).withColumn("comp_len", F.octet_length("frame").cast("long"))
    return rows.withColumn("disposition", F.when((F.lit(level) > 1) & (F.col("level") == 1), "stored").otherwise("compressed"))


def compress_entries(payloads: DataFrame, level: int = 6, threshold: float = 7.5, payload: str = "payload", entropy: str = "mean_entropy") -> DataFrame:
    """Adds ``method, body, comp_len, crc32`` to whole ZIP entries with a mean entropy.

    Incompressible entries are split off first, so the codec sees only those
    that it may shrink; entries that do not shrink are stored after all.
    """
    size = F.octet_length(payload)
    rows = payloads.withColumn("crc32", F.crc32(payload))
    skip = (F.lit(level) == 0) | (size == 0) | incompressible(F.coalesce(F.col(entropy), F.lit(0.0)), threshold)
    stored = rows.filter(skip).withColumn("method", F.lit("stored")).withColumn("body", F.col(payload))
    tried = rows.filter(~skip).withColumn("_b", deflate(F.col(payload), F.lit(level)))
    shrunk = F.octet_length("_b") < size
    tried = tried.withColumn("method", F.when(shrunk, "deflate").otherwise("stored")).withColumn("body", F.when(shrunk, F.col("_b")).otherwise(F.col(payload))).drop("_b")
    return stored.unionByName(tried).withColumn("comp_len", F.octet_length("body").cast("long"))


def deflate_part(data: Column, last: Column, level: int) -> Column:
    """One chunk of an entry; chunks put together in order are one DEFLATE stream."""

    @F.pandas_udf("binary")
    def pack(data: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([deflate_chunk(d, level, bool(x)) for d, x in zip(data, last, strict=True)], dtype=object)

    return pack(data, last)


def deflate_in_chunks(payloads: DataFrame, keys: list[str], chunk: int = 1 << 20, level: int = 6, payload: str = "payload") -> DataFrame:
    """``keys, body``: chunks deflated apart and put together in order (one stream)."""
    from .blocks import split_blocks

    chunks = split_blocks(payloads, chunk, keys, payload)
    sizes = payloads.select(*keys, F.octet_length(payload).alias("_size"))

    last = F.col("raw_off") + F.col("raw_len") == F.col("_size")
    packed = chunks.join(sizes, keys).select(*keys, "block_idx", deflate_part(F.col("data"), last, level).alias("part"))
    # a body is one cell in any case, so its parts may meet in a row
    joined = packed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block_idx", "part"))).alias("_parts"))
    glue = F.aggregate("_parts", F.lit(b""), lambda s, p: F.concat(s, p.part))
    empty = deflate_chunk(b"", level, True)
    return payloads.select(*keys).join(joined.select(*keys, glue.alias("body")), keys, "left").select(*keys, F.coalesce("body", F.lit(empty)).alias("body"))


Decoder = Callable[[bytes, int], bytes]


def raw_or_zstd(frame: bytes, capacity: int) -> bytes:
    """Frames of raw and RLE blocks are copied out, others are decoded."""
    state, out = decode_raw(frame, capacity)
    return out if state == "decoded" else zstd_decode(frame, capacity)


def decode_blocks(blocks: DataFrame, keys: list[str], data: str = "data", size: str = "raw_len", decoders: tuple[Decoder, ...] = (raw_or_zstd, zstd_decode)) -> DataFrame:
    """``keys, raw, decoder``: each block by the first decoder that gives its declared size.

    If none does, the last decoder's error ends the task (which Spark retries).
    """
    kinds = [f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, used = [], []
            for frame, expected in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True):
                for n, decoder in enumerate(decoders):
                    try:
                        raw = decoder(frame or b"", expected)
                        if len(raw) != expected:
                            raise IntegrityError(f"a block of {expected} bytes came out as {len(raw)}")
                    except Exception:
                        if n + 1 == len(decoders):
                            raise
                    else:
                        out.append(raw)
                        used.append(n)
                        break
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(out, pa.binary()), pa.array(used, pa.int32())], names=[*keys, "raw", "decoder"])

    return blocks.select(*keys, data, F.col(size).cast("long")).mapInArrow(run, ", ".join([*kinds, "raw binary", "decoder int"]))


def verify(decoded: DataFrame, entries: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """``keys, size, crc32, ok``: sizes and checksums of decoded entries against what is recorded.

    ``decoded`` has ``keys, raw_off, raw``; an entry without blocks has size 0
    and checksum 0.  ``strict`` raises at the first entry that differs.
    """
    sizes = entries.select(*keys, F.col("uncompressed_size").alias("_size"), F.col("crc32").alias("_crc"))
    rows = decoded.join(sizes, keys)
    length = F.octet_length("raw").cast("long")
    found = rows.groupBy(*keys).agg(F.sum(length).alias("size"), crc32_of_blocks(F.crc32("raw"), F.greatest(F.lit(0), F.col("_size") - F.col("raw_off") - length)).alias("crc32"))
    out = sizes.join(found, keys, "left").withColumns({"size": F.coalesce("size", F.lit(0)), "crc32": F.coalesce("crc32", F.lit(0))})
    good = (F.col("size") == F.col("_size")) & (F.col("crc32") == F.col("_crc"))
    if strict:
        good = F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("integrity: entry "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))).cast("boolean"))
    return out.select(*keys, "size", "crc32", good.alias("ok"))


def verify_content(contents: DataFrame, content: str = "content", expected_crc: str = "crc32", expected_size: str = "uncompressed_size") -> DataFrame:
    """Adds ``ok`` to freshly read contents: the checksum (0 for nothing) and the size agree."""
    body = F.coalesce(F.col(content), F.lit(b""))
    return contents.withColumn("ok", (F.crc32(body) == F.col(expected_crc)) & (F.octet_length(body) == F.col(expected_size)))
