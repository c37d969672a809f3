"""Archive entries: filter by name, listing, totals, parent directories, extraction."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DiskSpaceError, FormatError, MissingEntriesError
from ..functions import scalar as S


def missing_entries(entries: DataFrame, names: Iterable[str]) -> DataFrame:
    """``name`` of those asked for that no entry has."""
    asked = entries.sparkSession.createDataFrame([(n,) for n in sorted(set(names))], "name string")
    return asked.join(entries.select("name"), "name", "left_anti")


def filter_entries(entries: DataFrame, names: Iterable[str]) -> DataFrame:
    """Entries with exactly these names; an empty list and names that are missing are errors."""
    names = sorted(set(names))
    if not names:
        raise MissingEntriesError("no entry names given")
    gone = [r[0] for r in missing_entries(entries, names).orderBy("name").collect()]  # at most the names given
    if gone:
        raise MissingEntriesError("no such entries: " + ", ".join(gone))
    return entries.filter(F.col("name").isin(names))


def safe_entries(entries: DataFrame, strict: bool = True) -> DataFrame:
    """Entries whose names stay inside the target; unsafe ones raise, or go."""
    safe = S.safe_path(F.col("name"))
    if not strict:
        return entries.filter(safe)
    return entries.filter(F.when(safe, True).otherwise(F.raise_error(F.concat(F.lit("unsafe entry name: "), F.coalesce("name", F.lit("null")))).cast("boolean")))


def listing(entries: DataFrame, keys: list[str] = ()) -> DataFrame:
    """``keys, entry_idx, size, modified, name`` in UTC; directory names end in a slash."""
    return entries.select(*keys, "entry_idx", F.col("uncompressed_size").alias("size"), F.date_format("mtime", "yyyy-MM-dd HH:mm:ss").alias("modified"), S.entry_name(F.col("name"), F.col("is_directory")).alias("name"))


def totals(entries: DataFrame, size: str = "uncompressed_size", keys: list[str] = ()) -> DataFrame:
    """``entries, bytes``."""
    return entries.groupBy(*keys).agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def parent_dirs(entries: DataFrame, name: str = "name") -> DataFrame:
    """``dir``: the different directories that the entries need."""
    return entries.select(S.parent_dir(F.col(name)).alias("dir")).filter("dir <> ''").distinct()


def extract(contents: DataFrame, target: str, total_bytes: int | None = None) -> DataFrame:
    """Writes ``name, content, is_directory, unix_mode, mtime`` below ``target``, a folder that all executors share.

    Returns ``name, size`` of what was written.  Files appear under their name
    only when they are whole.
    """
    safe = safe_entries(contents)
    os.makedirs(target, exist_ok=True)
    if total_bytes is not None:
        preflight(target, total_bytes)
    kinds = "name string, size long"

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                path = os.path.join(target, row["name"])
                if row["is_directory"]:
                    os.makedirs(path, exist_ok=True)
                    out.append((row["name"], 0))
                    continue
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.part-{os.getpid()}"
                with open(part, "wb") as file:
                    file.write(row["content"] or b"")
                if row["unix_mode"]:
                    os.chmod(part, row["unix_mode"] & 0o777)
                if row["mtime"] is not None:
                    os.utime(part, (row["mtime"].timestamp(),) * 2)
                os.replace(part, path)
                out.append((row["name"], len(row["content"] or b"")))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64())], names=["name", "size"])

    return safe.select("name", "content", "is_directory", "unix_mode", "mtime").mapInArrow(write, kinds)


def preflight(target: str, needed: int | None, directory: bool = False, reserve: int = 1 << 30) -> None:
    """Raises if ``target``'s disk cannot hold ``needed`` bytes and a reserve (a directory: the reserve alone)."""
    place = os.path.abspath(target)
    while not os.path.exists(place):
        place = os.path.dirname(place)
    try:
        free = shutil.disk_usage(place).free
    except OSError:
        return  # unknown: not checked
    wanted = reserve if directory or needed is None else needed + reserve
    if free < wanted:
        raise DiskSpaceError(f"{wanted} bytes needed at {place}, {free} free")


def require(condition: bool, message: str) -> None:
    if not condition:
        raise FormatError(message)
