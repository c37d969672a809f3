"""Tables as entries with payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_text(rows: DataFrame, src: str, key: str, name, text: str) -> DataFrame:
    """``src, entry_idx, name, payload``: the UTF-8 bytes of a text column."""
    return rows.select(F.lit(src).alias("src"), F.col(key).cast("long").alias("entry_idx"), name.alias("name"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("payload"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return from_text(_table(spark, sf_dir, "documents"), "documents", "doc_id", name, "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_text(_table(spark, sf_dir, "pages"), "pages", "page_id", F.format_string("pages/%d.html", "page_id"), "html")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_text(_table(spark, sf_dir, "benchmark"), "benchmark", "item_id", F.format_string("bench/%d.txt", "item_id"), "text")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns, joined by line feeds."""
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("_t"))
    text = turns.select("conv_id", F.array_join(F.transform("_t", lambda t: t.text), "\n").alias("text"))
    return from_text(text, "conversations", "conv_id", F.format_string("conv/%d.txt", "conv_id"), "text")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as packed little-endian 32-bit floats."""
    import pandas as pd

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        import numpy as np

        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    rows = _table(spark, sf_dir, "embeddings")
    return rows.select(F.lit("embeddings").alias("src"), F.col("vec_id").alias("entry_idx"), F.format_string("vec/%d", "vec_id").alias("name"), pack("embedding").alias("payload"))
