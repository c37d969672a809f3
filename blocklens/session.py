"""A Spark session with the settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",  # entry-name filters reach the archive sources
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),  # blocks and chunks are large cells
}


def session(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("blocklens").config(map=SETTINGS | more)
    found = (builder.master(master) if master else builder).getOrCreate()
    from .sources import register

    register(found)
    return found
