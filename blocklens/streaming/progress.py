"""Progress as JSON lines, and streams over them and over files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..schemas import PROGRESS


def encode_progress(rows: DataFrame) -> Column:
    """JSON line of ``phase, processed, total, bytes_per_second, eta_seconds, done``; no ETA where it is not finite."""
    eta = F.col("eta_seconds")
    finite = eta.isNotNull() & ~F.isnan(eta) & (F.abs(eta) != float("inf"))
    text = F.when(finite, F.format_string("%.3f", eta)).otherwise("null")
    return F.format_string('{"phase":"%s","processed":%d,"total":%d,"bytesPerSecond":%.0f,"etaSeconds":%s,"done":%s}', "phase", "processed", "total", F.col("bytes_per_second").cast("double"), text, F.col("done").cast("string"))


def parse_progress(lines: DataFrame, value: str = "value") -> DataFrame:
    """``progress fields..., is_progress, value``: lines that are no progress object are kept as text.  Works on streams too."""
    parsed = F.from_json(F.col(value), PROGRESS)
    rows = lines.withColumn("_p", F.when(F.trim(value).startswith("{"), parsed))
    good = F.coalesce(F.col("_p.phase").isNotNull() & F.col("_p.processed").isNotNull(), F.lit(False))
    return rows.select(*[F.when(good, F.col(f"_p.{name}")).alias(name) for name in ("phase", "processed", "total", "bytesPerSecond", "etaSeconds", "done")], good.alias("is_progress"), F.col(value).alias("value"))


def last_lines(parsed: DataFrame, order: str, keep: int = 50, keys: list[str] = ()) -> DataFrame:
    """The last ``keep`` lines (per ``keys``) that are no progress."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))) if keys else None
    rows = parsed.filter(~F.col("is_progress"))
    return rows.withColumn("_r", place).filter(F.col("_r") <= keep).drop("_r") if keys else rows.orderBy(F.desc(order)).limit(keep)


def progress_stream(spark: SparkSession, path: str) -> DataFrame:
    """Progress lines of growing text files as a stream, with the latest state per phase."""
    return parse_progress(spark.readStream.text(path))


def latest_by_phase(parsed: DataFrame) -> DataFrame:
    """``phase, processed, total, fraction, done`` (update mode on streams): progress only grows."""
    rows = parsed.filter("is_progress").groupBy("phase").agg(F.max("processed").alias("processed"), F.max("total").alias("total"), F.bool_or("done").alias("done"))
    return rows.withColumn("fraction", S.progress_fraction(F.col("processed"), F.col("total")))


def histogram_stream(spark: SparkSession, path: str) -> DataFrame:
    """``byte, n`` over files that arrive in a folder: counts are sums, so no state of our own is needed."""
    from ..operators.blocks import byte_histogram

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(path)
    return byte_histogram(files.select("path", F.col("content").alias("data")), ["path"]).groupBy("byte").agg(F.sum("n").alias("n"))


def stage_stream(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Event-time totals per stage: ``stage, start, n, seconds``, closed once the watermark has passed."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), F.col("event_type").alias("stage"))
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("seconds")).select("stage", F.col("window.start").alias("start"), "n", "seconds")


def run_once(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now and returns its result (mode ``append``: of all its batches), written in ``folder``."""
    spark, last = stream.sparkSession, [0]

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch-{number}")
        last[0] = number

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/batch-*" if mode == "append" else f"{folder}/batch-{last[0]}")
