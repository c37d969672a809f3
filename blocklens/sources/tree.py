"""Data source ``filetree``: a directory tree as entry rows, with what was skipped."""

from __future__ import annotations

import datetime
import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_SCHEMA = "path string, name string, is_directory boolean, size long, mtime timestamp, unix_mode int, reason string, rel string, items long"


@dataclass
class _Branch(InputPartition):
    #: folder to walk, or one item of the root (None: the root's own row)
    rel: str | None


class _Walk(DataSourceReader):
    """The root's row is one partition and every item in it another."""

    def __init__(self, options: dict):
        self.root = os.path.realpath(options["path"])
        self.hidden = str(options.get("excludeHidden", "false")).lower() == "true"
        if not os.path.lexists(self.root):
            raise FileNotFoundError(options["path"])

    def partitions(self):
        if not os.path.isdir(self.root):
            return [_Branch(None)]
        return [_Branch(None), *(_Branch(n) for n in sorted(os.listdir(self.root)))]

    def _entry(self, path: str, rel: str, info: os.stat_result) -> tuple:
        base = os.path.basename(self.root)
        folder = stat.S_ISDIR(info.st_mode)
        name = base + (f"/{rel}" if rel else "") + ("/" if folder else "")
        when = datetime.datetime.fromtimestamp(info.st_mtime, datetime.timezone.utc)
        return path, name, folder, 0 if folder else info.st_size, when, stat.S_IMODE(info.st_mode), None, None, None

    @staticmethod
    def _skip(rel: str, reason: str, size: int, items: int) -> tuple:
        return None, None, None, size, None, None, reason, rel, items

    def _below(self, path: str) -> tuple[int, int]:
        """Bytes of files and number of all items at and below a pruned path."""
        info = os.lstat(path)
        if not stat.S_ISDIR(info.st_mode):
            return info.st_size if stat.S_ISREG(info.st_mode) else 0, 1
        size, items = 0, 1
        for folder, names, files in os.walk(path):
            items += len(names) + len(files)
            for n in files:
                found = os.lstat(os.path.join(folder, n))
                size += found.st_size if stat.S_ISREG(found.st_mode) else 0
        return size, items

    def _walk(self, rel: str) -> Iterator[tuple]:
        path = os.path.join(self.root, rel)
        info = os.lstat(path)
        if stat.S_ISLNK(info.st_mode):  # links are never followed
            yield self._skip(rel, "symlink", info.st_size, 1)
            return
        if self.hidden and os.path.basename(rel).startswith("."):
            yield self._skip(rel, "hidden", *self._below(path))
            return
        if not (stat.S_ISDIR(info.st_mode) or stat.S_ISREG(info.st_mode)):
            return
        yield self._entry(path, rel, info)
        if stat.S_ISDIR(info.st_mode):
            for n in sorted(os.listdir(path)):
                yield from self._walk(f"{rel}/{n}")

    def read(self, partition):
        if partition.rel is None:
            yield self._entry(self.root, "", os.stat(self.root))
        else:
            yield from self._walk(partition.rel)


class FileTree(DataSource):
    @classmethod
    def name(cls):
        return "filetree"

    def schema(self):
        return _SCHEMA

    def reader(self, schema):
        return _Walk(self.options)


def walk(spark: SparkSession, path: str, exclude_hidden: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entries (ordered by name, numbered by ``entry_idx``) and skips of a tree on a shared file system."""
    rows = spark.read.format("filetree").option("excludeHidden", str(exclude_hidden).lower()).load(path)
    entries = rows.filter("reason IS NULL")
    # names decide the order, so archives of equal trees are equal; they are numbered inside the buckets of
    # their first bytes, after the entries of the buckets before
    name = F.encode("name", "UTF-8")
    bucket = F.substring(name, 1, len(os.path.basename(os.path.realpath(path)).encode()) + 4)
    entries = entries.withColumn("_bucket", bucket)
    counts = entries.groupBy(F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    counts = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    entries = entries.join(counts, F.col("_bucket") == F.col("_b"))
    number = F.col("_before") + F.row_number().over(Window.partitionBy("_bucket").orderBy(name)) - 1
    entries = entries.select(number.cast("long").alias("entry_idx"), "path", "name", "is_directory", "size", "mtime", "unix_mode")
    return entries, rows.filter("reason IS NOT NULL").select("rel", "reason", F.col("size").alias("bytes"), "items")


def total_bytes(entries: DataFrame) -> DataFrame:
    return entries.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def contents(entries: DataFrame, block_size: int | None = None) -> DataFrame:
    """File entries with ``payload``, or with ``block_size`` a row per block: ``block_idx, raw_off, raw_len, data``.

    Files are opened where the rows are, on a file system that all executors
    share, and blocks are read one at a time, so no file has to fit in a cell.
    """
    files = entries.filter("NOT is_directory").select("entry_idx", "path", "size")
    if block_size is None:

        def read(batches):
            import pyarrow as pa

            for batch in batches:
                for k in range(batch.num_rows):
                    with open(batch.column(1)[k].as_py(), "rb") as file:
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([file.read()], pa.binary())], names=["entry_idx", "payload"])

        return files.mapInArrow(read, "entry_idx long, payload binary")

    from ..operators.blocks import block_ranges

    # a given number, as ranges are so short that adaptive plans would put the reading of them all into a few tasks
    tasks = 2 * entries.sparkSession.sparkContext.defaultParallelism
    ranges = block_ranges(files, block_size, ["entry_idx", "path"]).repartition(tasks, "entry_idx", "block_idx")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                path, off, length = (row.column(i)[0].as_py() for i in (1, 3, 4))
                with open(path, "rb") as file:
                    file.seek(off)
                    yield pa.RecordBatch.from_arrays([row.column(0), *row.columns[2:], pa.array([file.read(length)], pa.binary())], names=["entry_idx", "block_idx", "raw_off", "raw_len", "data"])

    return ranges.mapInArrow(cut, "entry_idx long, block_idx int, raw_off long, raw_len long, data binary")


def discard(entries: DataFrame) -> None:
    """Removes the files of a scratch tree; its folders stay."""

    def drop(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                if os.path.lexists(path):  # else an earlier try of this task has removed it
                    os.remove(path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    entries.filter("NOT is_directory").select("path").mapInArrow(drop, "n long").agg(F.sum("n")).first()
