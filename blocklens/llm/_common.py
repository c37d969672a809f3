"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as every word rule of this subpackage reads it.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD_RUN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) is a
    folder of our own made, and then it is set as the context's checkpoint
    folder; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if (own := context._jsc.sc().getCheckpointDir()).isDefined():
        return own.get()
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="blocklens-"))
    return context._jsc.sc().getCheckpointDir().get()


class Memory(dict):
    """What a Python worker remembers: two generations, so what is used often stays.

    A missing key is looked for in the older generation and else computed.
    When ``limit`` keys are in, the older generation goes.  A worker serves one
    kind of memory at a time: ``claim`` empties the others.
    """

    _all: list[Memory] = []

    def __init__(self, compute, limit: int, kind: str):
        self.compute, self.limit, self.older, self.kind = compute, limit, {}, kind
        Memory._all.append(self)

    @staticmethod
    def claim(kind: str) -> None:
        others = [memory for memory in Memory._all if memory.kind != kind and (memory or memory.older)]
        for memory in others:
            memory.clear()
            memory.older = {}
        if others:
            give_back()

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.compute(key)
        self[key] = found
        return found

    def settle(self) -> None:
        """Call between batches."""
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()

    def unknown(self, keys) -> list:
        """Keys in neither generation; those of the older one move up."""
        fresh = []
        for key in keys:
            if key not in self:
                found = self.older.get(key)
                if found is None:
                    fresh.append(key)
                else:
                    self[key] = found
        return fresh


class Scratch:
    """Intermediate tables of one run, in a folder of their own under the shared one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_root(spark)}/blocklens-{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back: cuts lineage and survives lost executors."""
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def give_back() -> None:
    """Returns memory that a Python worker no longer uses to the system, as workers outlive their tasks."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in record batches of at most a few megabytes, whatever their length.

    The Parquet reader's batches, which hold as many whole texts, are smaller,
    too.  The settings are the session's, as a lazy result runs after its
    operator has returned; smaller values that the session has already stay.
    """
    for name, most in (("execution.arrow.maxRecordsPerBatch", 2000), ("execution.arrow.maxBytesPerBatch", 4 << 20), ("parquet.columnarReaderBatchSize", 512)):
        now = spark.conf.get(f"spark.sql.{name}").removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.{name}", str(most))


def text_parts(batch, column: int, limit: int):
    """``(first row, rows, texts)`` of consecutive parts of a batch of at most ``limit`` UTF-8 bytes (or one row)."""
    import numpy
    import pyarrow.compute

    ends = numpy.cumsum(pyarrow.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        count = max(1, int(numpy.searchsorted(ends, before + limit, "right")) - at)
        yield at, count, batch.column(column).slice(at, count).to_pylist()
        at += count


def tidy(function):
    """A mapInArrow function that gives memory back at its end."""

    def run(batches):
        yield from function(batches)
        give_back()

    return run


def tidy_group(function):
    """The same for an applyInArrow function."""

    def run(table):
        out = function(table)
        give_back()
        return out

    return run


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_in(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RUN)), F.lit(0)).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")
