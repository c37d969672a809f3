"""Zstandard frames (RFC 8878): raw and RLE decoding, literal sections."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import BUCKETS

MAGIC = b"\x28\xb5\x2f\xfd"
RAW, RLE, COMPRESSED = 0, 1, 2


def header_size(frame: bytes) -> int | None:
    """Bytes of magic and frame header; None if malformed."""
    if len(frame) < 5 or frame[:4] != MAGIC:
        return None
    descriptor = frame[4]
    single = descriptor >> 5 & 1
    if descriptor & 0x08:  # reserved bit
        return None
    dictionary = (0, 1, 2, 4)[descriptor & 3]
    content = (1 if single else 0, 2, 4, 8)[descriptor >> 6]
    size = 5 + (0 if single else 1) + dictionary + content
    return size if size <= len(frame) else None


def blocks_of(frame: bytes) -> Iterator[tuple[int, int, int, bool] | None]:
    """``(type, declared size, offset of its content, last)`` per inner block; ends with None if malformed."""
    at = header_size(frame)
    while at is not None:
        if at + 3 > len(frame):
            break
        head = int.from_bytes(frame[at : at + 3], "little")
        last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
        at += 3
        held = 1 if kind == RLE else size
        if kind == 3:
            break
        yield kind, size, at, last
        if at + held > len(frame):
            break
        if last:
            return
        at += held
    yield None


def literals(frame: bytes, at: int, end: int) -> tuple[str, int] | None:
    """Bucket and regenerated bytes of the literals section at ``at``; None if it is cut off."""
    end = min(end, len(frame))
    if at >= end:
        return None
    kind, form = frame[at] & 3, frame[at] >> 2 & 3
    if kind < 2:  # raw and RLE: the size takes 5, 12 or 20 bits
        width, bits = {0: (1, 5), 2: (1, 5), 1: (2, 12), 3: (3, 20)}[form]
        shift = 8 * width - bits
    else:  # both sizes take 10, 10, 14 or 18 bits each
        width, bits = {0: (3, 10), 1: (3, 10), 2: (4, 14), 3: (5, 18)}[form]
        shift = 4
    if at + width > end:
        return None
    size = int.from_bytes(frame[at : at + width], "little") >> shift & (1 << bits) - 1
    if kind == 0:
        return "rawLiterals", size
    if kind == 1:
        return ("rleLiterals", size) if at + width + 1 <= end else None
    if kind == 3:
        return "treeless", size
    return ("compressed1Stream" if form == 0 else "compressed4Stream"), size


def classify_frame(frame: bytes) -> tuple[list[tuple[str, int]], bool]:
    """Literal buckets of a frame's inner blocks with their bytes, and whether all of it was parsed.

    Raw and RLE blocks have no literals section and count their whole size.  A
    malformed literals header counts as raw literals of no bytes and makes the
    frame not fully parsed.
    """
    found, whole = [], True
    for block in blocks_of(frame):
        if block is None:
            return found, False
        kind, size, at, _ = block
        if kind != COMPRESSED:
            found.append(("noLiterals", size))
            continue
        section = literals(frame, at, at + size)
        found.append(section or ("rawLiterals", 0))
        whole = whole and section is not None
    return found, whole


def dominant(found: list[tuple[str, int]]) -> str:
    """The bucket with most bytes; of equals the one declared first."""
    sums = dict.fromkeys(BUCKETS, 0)
    for bucket, size in found:
        sums[bucket] += size
    return max(BUCKETS, key=lambda b: sums[b])


def decode_raw(frame: bytes, capacity: int) -> tuple[str, bytes | None]:
    """``decoded`` with the bytes, ``needsFullDecoder``, or ``parseError``, for frames of raw and RLE blocks."""
    out = bytearray()
    for block in blocks_of(frame):
        if block is None:
            return "parseError", None
        kind, size, at, _ = block
        if kind == COMPRESSED:
            return "needsFullDecoder", None
        held = frame[at : at + size] if kind == RAW else frame[at : at + 1] * size
        if (kind == RAW and len(held) < size) or (kind == RLE and at >= len(frame)) or len(out) + size > capacity:
            return "parseError", None
        out += held
    return "decoded", bytes(out)


FRAME = "blocks array<struct<bucket:string, regenerated_bytes:long>>, dominant string, fully_parsed boolean, raw_state string"


def classify(frames: DataFrame, keys: list[str], data: str = "data", capacity: int = 1 << 28) -> DataFrame:
    """``keys, blocks, dominant, fully_parsed, raw_state``, a row per frame, each frame once."""
    kinds = [f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys]
    inner = pa.list_(pa.struct([("bucket", pa.string()), ("regenerated_bytes", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [classify_frame(x or b"") for x in batch.column(len(keys)).to_pylist()]
            states = [decode_raw(x or b"", capacity)[0] for x in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keys)], pa.array([[{"bucket": b, "regenerated_bytes": n} for b, n in f] for f, _ in found], inner), pa.array([dominant(f) for f, _ in found]), pa.array([w for _, w in found]), pa.array(states)],
                names=[*keys, "blocks", "dominant", "fully_parsed", "raw_state"],
            )

    return frames.select(*keys, data).mapInArrow(run, ", ".join([*kinds, FRAME]))


def bucket_counts(rows: DataFrame, bucket: str = "bucket", size: str = "regenerated_bytes") -> DataFrame:
    """``ordinal, bucket, n, regenerated_bytes`` with all six buckets, zero where nothing fell in."""
    domain = rows.sparkSession.createDataFrame(list(enumerate(BUCKETS)), "ordinal int, bucket string")
    sums = rows.groupBy(F.col(bucket).alias("bucket")).agg(F.count("*").alias("n"), F.sum(size).alias("regenerated_bytes"))
    return domain.join(sums, "bucket", "left").select("ordinal", "bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("regenerated_bytes", F.lit(0)).cast("long").alias("regenerated_bytes"))


def inner_buckets(classified: DataFrame) -> DataFrame:
    """Counts over all inner blocks."""
    return bucket_counts(classified.select(F.explode("blocks").alias("_b")).select("_b.*"))


def frame_buckets(classified: DataFrame) -> DataFrame:
    """Counts over frames by their dominant bucket, with all their bytes."""
    size = F.aggregate("blocks", F.lit(0).cast("long"), lambda s, b: s + b.regenerated_bytes)
    return bucket_counts(classified.select(F.col("dominant").alias("bucket"), size.alias("regenerated_bytes")))


def dominant_bucket(rows: DataFrame, keys: list[str], bucket: str = "bucket", size: str = "regenerated_bytes") -> DataFrame:
    """``keys, dominant``: the bucket with most bytes, of equals the one declared first."""
    order = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col(bucket))
    sums = rows.groupBy(*keys, bucket).agg(F.sum(size).alias("_n"), F.max(order).alias("_o"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), "_o"))
    return sums.withColumn("_r", place).filter("_r = 1").select(*keys, F.col(bucket).alias("dominant"))


def gate(counts: DataFrame, percent: float = 70.0) -> DataFrame:
    """``literal_share, total_share, gate``: share of four-stream bytes, in percent, and PASS or FAIL."""
    of = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("regenerated_bytes"))), F.lit(0))
    four, bearing, whole = of(F.col("bucket") == "compressed4Stream"), of(F.col("bucket") != "noLiterals"), of(F.lit(True))
    share = lambda a, b: F.when(b > 0, a / b * 100).otherwise(F.lit(0.0))
    out = counts.agg(share(four, bearing).alias("literal_share"), share(four, whole).alias("total_share"))
    return out.withColumn("gate", _passed(F.col("literal_share"), percent))


def _passed(share: Column, percent: float) -> Column:
    return F.when(share >= percent, "PASS").otherwise("FAIL")
