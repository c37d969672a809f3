"""Exact dedup by skew-safe combining (DataFrame functions only).

Rows are combined three times, and the whole normalised text is a grouping key
each time, so a digest only deals rows out and never decides equality:

1. inside each input partition (the map side of the first aggregation);
2. per ``(digest, salt)``, where the salt comes from the row's id, so a group of
   copies that holds a third of all rows is merged by many tasks;
3. over the salt winners of each text, at most ``salts`` rows a group.

Membership goes back to the rows by ``(digest, salt)``.  Should two different
texts ever share a digest, which the verdict table shows, those digests are
joined by their whole text instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACE_RUN, Scratch, shuffle_partitions


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None, digest=None, carry: bool = False) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Null and empty texts are one group.  The smallest id of a group stays (a
    null id only if the group has no other); of repeated rows that carry this
    same id exactly one is ``kept``.  An empty table gives an empty result.
    With ``carry`` the input's columns come first and the verdict's follow as
    ``_keep_id, _group_size, _kept``, whatever other columns are called.
    ``digest`` replaces SHA-256 as the dealing key (tests force collisions).
    """
    spark = docs.sparkSession
    salts = salts or max(16, shuffle_partitions(spark))
    digest = digest or (lambda t: F.unhex(F.sha2(t, 256)))
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_t"))
    rows = rows.select("_id", "_t", digest(F.col("_t")).alias("_d"), F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int").alias("_s"))

    salted = rows.groupBy("_d", "_s", "_t").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("_d", "_t")
    verdict = salted.select("_d", "_s", "_t", F.min("_first").over(whole).alias("_keep"), F.sum("_n").over(whole).alias("_size"))
    scratch = Scratch(spark, "exact-dedup")
    slim = verdict.select("_d", "_s", "_keep", "_size", F.xxhash64("_t").alias("_h"))
    slim = scratch.save(slim, "verdict")

    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")) if carry else docs
    source = (lambda c: F.col(f"_row.`{c}`")) if carry else (lambda c: F.col(f"`{c}`"))
    text = normalised(source(text_col))
    extra = ["_row"] if carry else []
    members = named.select(*extra, source(id_col).alias("_id"), text.alias("_t"))
    members = members.select(*extra, "_id", digest(F.col("_t")).alias("_d"), F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int").alias("_s"), F.sha2("_t", 256).alias("text_sha256"), "_t")
    clashes = slim.groupBy("_d", "_s").agg(F.count("*").alias("_v")).filter("_v > 1").limit(1).count()
    if clashes:  # different texts under one digest: the text itself decides
        joined = members.join(verdict, ["_d", "_s", "_t"])
    else:
        joined = members.drop("_t").join(slim.drop("_h"), ["_d", "_s"])
    same = Window.partitionBy("_d", "_s", "_id").orderBy("text_sha256")
    joined = joined.withColumn("_kept", F.col("_id").eqNullSafe(F.col("_keep")) & (F.row_number().over(same) == 1))
    if carry:
        return joined.select("_row.*", F.col("_keep").alias("_keep_id"), F.col("_size").alias("_group_size"), "_kept")
    return joined.select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"), "text_sha256")
