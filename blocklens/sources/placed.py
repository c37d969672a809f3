"""Archives and files written in place, by all tasks at once.

Every piece of a file (heads, frames, directory records) gets its offset from
sums over metadata alone; then each task writes its own pieces at their
offsets.  No byte goes through the driver, a piece written twice after a lost
executor is the same, and a file appears under its name only when all of it is
there.  Paths lie on a file system that all executors share.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import IntegrityError
from . import formats as f

_ROW_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "16"}
#: Bytes of a ZIP entry that are unpacked at a time.
_STREAM = 4 << 20


@contextmanager
def work_folder(spark: SparkSession, beside: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A function that writes a table once and reads it back; the tables lie beside ``beside`` and go at the end."""
    folder = f"{os.path.abspath(beside)}.work-{uuid.uuid4().hex}"

    def save(df: DataFrame, name: str) -> DataFrame:
        # the reader's batches end with row groups, so cells of many megabytes never meet in one
        df.write.options(**_ROW_GROUPS).parquet(f"file://{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"file://{folder}/{name}")

    try:
        yield save
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def place(rows: DataFrame, start: int, save, name: str) -> tuple[DataFrame, int]:
    """``rows`` (``entry_idx, length`` and more) with ``at``, their offsets in the order of ``entry_idx``; the end.

    Offsets are summed inside ranges of entries; the driver adds up one number a range.
    """
    ranged = save(rows.repartitionByRange("entry_idx").withColumn("_range", F.spark_partition_id()), name)
    sums = ranged.groupBy("_range").agg(F.sum("length").alias("n")).orderBy("_range").collect()
    before = [(r["_range"], start + sum(x["n"] for x in sums[:i])) for i, r in enumerate(sums)]
    table = rows.sparkSession.createDataFrame(before, "_r int, _before long")
    inside = F.sum("length").over(Window.partitionBy("_range").orderBy("entry_idx")) - F.col("length")
    out = ranged.join(F.broadcast(table), F.col("_range") == F.col("_r")).withColumn("at", F.col("_before") + inside)
    return out.drop("_range", "_r", "_before"), start + sum(r["n"] for r in sums)


def put(pieces: DataFrame, path: str) -> int:
    """Writes ``at, data`` rows into ``path``; the number of bytes written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, done = os.open(path, os.O_WRONLY), 0
        try:
            for batch in batches:
                for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    view = memoryview(data)
                    while view:
                        held = os.pwrite(file, view, at)
                        view, at, done = view[held:], at + held, done + held
        finally:
            os.close(file)
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    return pieces.select("at", "data").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def _built(entries: DataFrame, build: Callable[[f.Entry], bytes]) -> DataFrame:
    """``entry_idx, packed, head``: what ``build`` makes of each entry."""
    columns = ["entry_idx", "name", "is_directory", "unix_mode", "seconds", "method", "block_size", "uncompressed_size", "packed", "crc32", "block_lengths", "at"]
    entries = entries if "at" in entries.columns else entries.withColumn("at", F.lit(0).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [build(f.Entry(*list(row.values())[1:])) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(8), pa.array(heads, pa.binary())], names=["entry_idx", "packed", "head"])

    return entries.select(columns).mapInArrow(run, "entry_idx long, packed long, head binary")


def write_archive(entries: DataFrame, blocks: DataFrame, target: str, zipped: bool, overwrite: bool, save) -> None:
    """An archive of ``entries`` and the packed ``blocks`` (``entry_idx, block_idx, body``) of its files."""
    if os.path.exists(target) and not overwrite:
        raise FileExistsError(f"{target} exists")
    lengths = blocks.select("entry_idx", "block_idx", F.octet_length("body").cast("long").alias("n"))
    of = lengths.groupBy("entry_idx").agg(F.sort_array(F.collect_list(F.struct("block_idx", "n"))).alias("_l"), F.sum("n").alias("packed"))
    entries = entries.join(of, "entry_idx", "left").withColumn("block_lengths", F.coalesce(F.transform("_l", lambda x: x.n), F.array().cast("array<long>")))
    entries = entries.withColumn("packed", F.coalesce("packed", F.lit(0)).cast("long")).withColumn("seconds", F.greatest(F.lit(0), F.coalesce(F.unix_seconds("mtime"), F.lit(0))))
    entries = save(entries.drop("_l"), "entries")
    heads = _built(entries, f.zip_local if zipped else f.block_entry_head).withColumn("length", F.octet_length("head") + F.col("packed"))
    heads, end = place(heads, 0 if zipped else len(f.block_header()), save, "heads")
    order = Window.partitionBy("entry_idx").orderBy("block_idx")
    offsets = lengths.withColumn("_in", F.sum("n").over(order) - F.col("n")).select("entry_idx", "block_idx", "_in")
    bodies = offsets.join(heads.select("entry_idx", (F.col("at") + F.octet_length("head")).alias("_from")), "entry_idx")
    pieces = blocks.join(bodies, ["entry_idx", "block_idx"]).select((F.col("_from") + F.col("_in")).alias("at"), F.col("body").alias("data"))

    whole = f"{target}.whole-{uuid.uuid4().hex}"
    try:
        count = entries.count()
        if zipped:
            records = _built(entries.join(heads.select("entry_idx", "at"), "entry_idx"), f.zip_central).withColumn("length", F.octet_length("head").cast("long"))
            records, close = place(records, end, save, "records")
            first, last = b"", f.zip_end(count, end, close - end)
        else:
            first, last, close = f.block_header(), f.block_footer(count), end
        with open(whole, "wb") as file:
            file.write(first)
            file.truncate(close)
            file.seek(close)
            file.write(last)
        done = put(heads.select("at", F.col("head").alias("data")), whole) + put(pieces, whole)
        if zipped:
            done += put(records.select("at", F.col("head").alias("data")), whole)
        if done != close - len(first):
            raise IntegrityError(f"{done} bytes written of {close - len(first)}")
        os.replace(whole, target)
    finally:
        if os.path.exists(whole):
            os.remove(whole)


def _part(target: str, archive: str, idx: int, name: str, run: str) -> str:
    import zlib

    return os.path.join(target, name.rstrip("/")) + f".part-{run}-{zlib.crc32(archive.encode()):x}-{idx}"


def extract_blocks(entries: DataFrame, decoded: DataFrame, target: str, check: bool, save) -> DataFrame:
    """Writes blocks (``archive, entry_idx, name, raw_off, raw``) into their files; ``name, size`` of all entries.

    Blocks of one file may come from any number of tasks.  Files get their
    names after all checksums agree.
    """
    from ..functions.checksum import fold_crc32

    run = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            lengths, sums = [], []
            for archive, idx, name, at, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                path = _part(target, archive, idx, name, run)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                file = os.open(path, os.O_WRONLY | os.O_CREAT, 0o644)
                try:
                    view, place = memoryview(raw), at
                    while view:
                        held = os.pwrite(file, view, place)
                        view, place = view[held:], place + held
                finally:
                    os.close(file)
                lengths.append(len(raw))
                sums.append(zlib.crc32(raw))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in (0, 1, 3)], pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], names=["archive", "entry_idx", "raw_off", "raw_len", "crc32"])

    keys = ["archive", "entry_idx"]
    try:
        written = save(decoded.select(*keys, "name", "raw_off", "raw").mapInArrow(write, "archive string, entry_idx long, raw_off long, raw_len long, crc32 long"), "written")
        if check:
            found = fold_crc32(written, keys).select(*keys, F.col("crc32").alias("_crc"), F.col("size").alias("_size"))
            files = entries.filter("NOT is_directory").join(found, keys, "left")
            bad = files.filter((F.coalesce("_size", F.lit(0)) != F.col("uncompressed_size")) | (F.coalesce("_crc", F.lit(0)) != F.col("crc32"))).select("name").limit(1).collect()
            if bad:
                raise IntegrityError(f"integrity: {bad[0][0]}")
    except Exception:
        _finish(entries, target, run, keep=False).count()
        raise
    return save(_finish(entries, target, run, keep=True), "done")


def _finish(entries: DataFrame, target: str, run: str, keep: bool) -> DataFrame:
    """Parts get their names, modes and times (or go)."""

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                path, part = os.path.join(target, row["name"]), _part(target, row["archive"], row["entry_idx"], row["name"], run)
                if not keep:
                    if os.path.exists(part):
                        os.remove(part)
                    continue
                if row["is_directory"]:
                    os.makedirs(path, exist_ok=True)
                elif os.path.exists(part) or not os.path.exists(path) or not row["uncompressed_size"]:  # else an earlier try of this task has named it
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    open(part, "ab").close()  # files without bytes have no part yet
                    if row["unix_mode"]:
                        os.chmod(part, row["unix_mode"] & 0o777)
                    if row["mtime"] is not None:
                        os.utime(part, (row["mtime"].timestamp(),) * 2)
                    os.replace(part, path)
                out.append((row["name"], 0 if row["is_directory"] else row["uncompressed_size"]))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64())], names=["name", "size"])

    return entries.select("archive", "entry_idx", "name", "is_directory", "unix_mode", "mtime", "uncompressed_size").mapInArrow(end, "name string, size long")


def extract_zip(entries: DataFrame, target: str, check: bool, save) -> DataFrame:
    """Unpacks each ZIP entry as a stream, straight from the archive into its file; ``name, size``."""
    run = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not row["is_directory"]:
                    path = _part(target, row["archive"], row["entry_idx"], row["name"], run)
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    with open(row["archive"], "rb") as source, open(path, "wb") as out:
                        _stream(source, out, row, check)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    columns = ["archive", "entry_idx", "name", "is_directory", "method", "uncompressed_size", "compressed_size", "crc32", "data_offset"]
    try:
        entries.select(columns).repartition("archive", "entry_idx").mapInArrow(write, "n long").agg(F.sum("n")).first()
    except Exception:
        _finish(entries, target, run, keep=False).count()
        raise
    return save(_finish(entries, target, run, keep=True), "done")


def _stream(source, out, row: dict, check: bool) -> None:
    import zlib

    from ..errors import CodecError

    e = f.Entry(row["name"], compressed_size=row["compressed_size"], data_offset=row["data_offset"])
    at, left = f.zip_payload(source, e)
    source.seek(at)
    reader = zlib.decompressobj(-15) if row["method"] == "deflate" else None
    size, sum_, wanted = 0, 0, row["uncompressed_size"]

    def take(data: bytes) -> None:
        nonlocal size, sum_
        size, sum_ = size + len(data), zlib.crc32(data, sum_)
        if size > wanted:
            raise CodecError(f"{row['name']!r}: more than the expected {wanted} bytes")
        out.write(data)

    try:
        while left:
            data = source.read(min(left, _STREAM))
            if not data:
                raise CodecError(f"the payload of {row['name']!r} is cut off")
            left -= len(data)
            while reader and data:
                take(reader.decompress(data, _STREAM))
                data = reader.unconsumed_tail
            if not reader:
                take(data)
        if reader:
            take(reader.flush())
            if not reader.eof:
                raise CodecError(f"the DEFLATE stream of {row['name']!r} is cut off")
    except zlib.error as error:
        raise CodecError(f"bad DEFLATE data in {row['name']!r}: {error}") from error
    if check and (size != wanted or sum_ != row["crc32"]):
        raise IntegrityError(f"integrity: {row['name']}")
