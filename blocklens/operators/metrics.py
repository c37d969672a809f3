"""Aggregates over samples, entries, stages and skips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

#: Stages measured in wall time at the driver of a pack run; all others are summed worker time.
WALL_STAGES = ["entropy.probe", "parallel.compress", "archive.write"]


def _ratio(a, b, otherwise: float):
    return F.when(b > 0, a / b).otherwise(F.lit(otherwise))


def heatmap_samples(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Samples of a ZIP run: ``keys, entropy, original_bytes, stored_bytes, disposition``.

    ``blocks`` has, per probed block, ``entropy, byte_count`` and its entry's
    ``method, level, entry_bytes, stored_bytes``.  Stored bytes are shared out
    by size; entries of level 0 or without bytes give no sample.
    """
    rows = blocks.filter((F.col("level") != 0) & (F.col("entry_bytes") > 0))
    return rows.select(*keys, "entropy", F.col("byte_count").alias("original_bytes"), S.attributed_bytes(F.col("byte_count"), F.col("stored_bytes"), F.col("entry_bytes")).alias("stored_bytes"), S.disposition_zip(F.col("method"), F.col("entropy")).alias("disposition"))


def coarse_samples(entries: DataFrame) -> DataFrame:
    """Entries that were not probed: one sample each, entropy 0; empty ones give none."""
    rows = entries.filter(F.col("entry_bytes") > 0)
    return rows.select(F.lit(0.0).alias("entropy"), F.col("entry_bytes").alias("original_bytes"), "stored_bytes", F.when(F.col("method") == "stored", "stored").otherwise("compressed").alias("disposition"))


def heatmap_summary(samples: DataFrame, keys: list[str] = ()) -> DataFrame:
    """``total_original, total_stored, compressed_blocks, stored_blocks, mean_entropy, overall_ratio``."""
    original, stored = F.coalesce(F.sum("original_bytes"), F.lit(0)), F.coalesce(F.sum("stored_bytes"), F.lit(0))
    weighted = F.sum(F.col("entropy") * F.col("original_bytes")) / F.nullif(F.sum("original_bytes"), F.lit(0))
    return samples.groupBy(*keys).agg(
        original.cast("long").alias("total_original"), stored.cast("long").alias("total_stored"),
        F.count_if(F.col("disposition") == "compressed").alias("compressed_blocks"), F.count_if(F.col("disposition") == "stored").alias("stored_blocks"),
        F.coalesce(weighted, F.lit(0.0)).alias("mean_entropy"), _ratio(stored, original, 1.0).alias("overall_ratio"),
    )


def compression_stats(entries: DataFrame, elapsed: float | None = None, bytes_in: str = "uncompressed_size", bytes_out: str = "compressed_size") -> DataFrame:
    """``entries, bytes_in, bytes_out, ratio, mb_per_s``: payloads only, headers do not count; 0 for no denominator."""
    a, b = F.coalesce(F.sum(bytes_in), F.lit(0)).cast("long"), F.coalesce(F.sum(bytes_out), F.lit(0)).cast("long")
    rate = F.lit(0.0) if not elapsed else a / F.lit(1e6) / F.lit(float(elapsed))
    return entries.agg(F.count("*").alias("entries"), a.alias("bytes_in"), b.alias("bytes_out"), _ratio(b, a, 0.0).alias("ratio"), rate.alias("mb_per_s"))


def extract_stats(contents: DataFrame, elapsed: float | None = None, size: str = "size") -> DataFrame:
    total = F.coalesce(F.sum(size), F.lit(0)).cast("long")
    rate = F.lit(0.0) if not elapsed else total / F.lit(1e6) / F.lit(float(elapsed))
    return contents.agg(F.count("*").alias("entries"), total.alias("bytes_out"), rate.alias("mb_per_s"))


def stage_table(stages: DataFrame, total_wall: float, batches: int = 0, wall_stages: list[str] | None = None) -> DataFrame:
    """``kind, stage, seconds, percent, ms_per_batch`` with a row for the time that no stage accounts for.

    Wall stages are shares of ``total_wall``; with ``wall_stages`` the others
    are shares of their own sum.
    """
    kind = F.lit("wall") if wall_stages is None else F.when(F.col("stage").isin(wall_stages), "wall").otherwise("cpu")
    sums = stages.groupBy("stage").agg(F.sum("seconds").alias("seconds")).withColumn("kind", kind)
    known = sums.filter("kind = 'wall'").agg(F.greatest(F.lit(0.0), F.lit(float(total_wall)) - F.coalesce(F.sum("seconds"), F.lit(0.0))).alias("seconds"))
    rest = known.select(F.lit("(unaccounted)").alias("stage"), "seconds", F.lit("wall").alias("kind"))
    rows = sums.unionByName(rest)
    whole = F.when(F.col("kind") == "wall", F.lit(max(float(total_wall), 1e-6))).otherwise(F.greatest(F.lit(1e-6), F.sum("seconds").over(Window.partitionBy("kind"))))
    per = F.when((F.lit(batches) > 0) & (F.col("stage") != "(unaccounted)"), F.col("seconds") * 1000 / F.lit(max(1, batches)))
    return rows.select("kind", "stage", "seconds", (F.col("seconds") / whole * 100).alias("percent"), per.alias("ms_per_batch"))


def skip_totals(skips: DataFrame) -> DataFrame:
    """``reason, entries, bytes, items``."""
    return skips.groupBy("reason").agg(F.count("*").alias("entries"), F.sum("bytes").cast("long").alias("bytes"), F.sum("items").cast("long").alias("items"))


def top_skips(skips: DataFrame, reason: str = "hidden", limit: int = 8) -> DataFrame:
    """The largest skipped items; of equals the smaller path first."""
    return skips.filter(F.col("reason") == reason).orderBy(F.desc("bytes"), "rel").limit(limit)


def progress_snapshot(ticks: DataFrame, total: int, elapsed: float, keys: list[str] = (), overdue: bool = False) -> DataFrame:
    """``processed, total, fraction, bytes_per_second, eta_seconds`` (``overdue``: below 0 past the total) from ticks with ``bytes``."""
    rows = ticks.groupBy(*keys).agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("processed"))
    whole, time = F.lit(total).cast("long"), F.lit(float(elapsed))
    return rows.withColumns({"total": whole, "fraction": S.progress_fraction(F.col("processed"), whole), "bytes_per_second": S.progress_rate(F.col("processed"), time), "eta_seconds": S.progress_eta(F.col("processed"), whole, time, overdue)})


def bench_row(runs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, wall, cpu, bytes_in, bytes_out, ratio_percent`` of corpus runs; ``n/a`` without input."""
    ratio = F.when(F.sum("bytes_in") > 0, F.format_string("%.3f", F.sum("bytes_out") / F.sum("bytes_in") * 100)).otherwise("n/a")
    return runs.groupBy(*keys).agg(F.sum("wall").alias("wall"), F.sum(F.col("user") + F.col("sys")).alias("cpu"), F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"), ratio.alias("ratio_percent"))
