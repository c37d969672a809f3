"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words.  A document's expected copies are
proportional to its rate, with one factor a source such that they give the
target; where that is more than the cap they are the cap, and the others rise.
The whole part of that number is given with certainty; the fraction is its
inclusion probability ``p``.  Documents are then ranked within their source by

    (u / (1 - u)) / (p / (1 - p)),   u a uniform number hashed from the id
                                     (and the number of a repeated row),

and taken from the smallest up until the words that the certain copies left
open are filled.  The cut in this order is found by summed histogram bins, and
only the one bin that holds it is put in order, so no source is ever gathered:
the cut lies near odds of 1, where no bin holds more than its share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, words_in

#: Sources up to this many are broadcast to the documents (about 50 bytes each).
_BROADCAST_SOURCES = 50_000
_UNIT = float(1 << 52)
#: Rates are held between 2^-20 and 2^20 and keep five leading bits, so a source has at most 656 different ones.
_RATE = 20


def _bins(rows: int) -> int:
    return max(64, min(1 << 16, rows // 64))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources by code point, null last, weigh ``weights`` in turn and share the
    sum of all sizes.  Targets stop at ``cap`` times the source's size and the
    excess is shared again by weight; with sources in the order of
    ``size / weight`` the capped ones are a prefix, so this fixed point is
    found in one pass over the (few) sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1)
    out = sizes.withColumn("_w", weight).withColumn("_most", F.col("source_size") * F.lit(float(cap)))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("_most") / F.col("_w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(F.col("source_size").cast("double")).over(every)
    open_words = total - F.coalesce(F.sum("_most").over(before), F.lit(0.0))
    open_weight = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    # the levels rise over the capped sources and fall after them: the highest one holds
    level = F.max("_level").over(every)
    out = out.withColumn("_level", open_words / open_weight)
    share = F.least(F.col("_most"), level * F.col("_w"))
    return out.select("source", "source_size", F.round(share, 6).alias("target"))


def length_rate(size):
    """The bits of a document's number of words: 1 for up to one word, 10 for 512 to 1023."""
    return F.length(F.bin(size)).cast("double")


def _rate(given):
    rate = F.least(F.greatest(F.coalesce(given.cast("double"), F.lit(1.0)), F.lit(2.0**-_RATE)), F.lit(2.0**_RATE))
    step = F.pow(F.lit(2.0), F.floor(F.log2(rate)) - 4)
    return F.floor(rate / step) * step


def _numbered(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows without and with ``_row``, and ``_nth`` that tells rows alike in source, id and text apart; 0 for the others.

    Such rows are numbered within their part of the table, after those of the
    parts before, so a group that holds a third of all rows is never gathered.
    Only a table that has such rows is written with its texts.
    """
    like = ["_source", "_id", "_tie"]
    slim = scratch.save(rows.drop("_row"), "sizes")
    alike = scratch.save(slim.groupBy(*like).agg(F.count("*").alias("_n")).filter("_n > 1"), "alike")
    if not alike.limit(1).count():
        return tuple(x.withColumn("_nth", F.lit(0).cast("long")) for x in (slim, rows))
    parts = scratch.save((rows if "_row" in rows.columns else slim).withColumn("_part", F.spark_partition_id()), "parts")
    repeats = parts.select(*like, "_part").join(alike, [parts[c].eqNullSafe(alike[c]) for c in like], "left_semi").groupBy(*like, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*like).orderBy("_part")) - F.col("_n")
    repeats = repeats.select(*[F.col(c).alias(f"_r{c}") for c in like], F.col("_part").alias("_r_part"), before.alias("_before"))
    found = parts.join(repeats, [parts[c].eqNullSafe(F.col(f"_r{c}")) for c in like] + [F.col("_part") == F.col("_r_part")], "left")
    inside = F.row_number().over(Window.partitionBy(*like, "_part").orderBy(F.lit(0)))
    several = found.filter("_before IS NOT NULL").withColumn("_nth", F.col("_before") + inside - 1)
    out = found.filter("_before IS NULL").withColumn("_nth", F.lit(0).cast("long")).unionByName(several)
    out = scratch.save(out.drop(*[f"_r{c}" for c in like], "_r_part", "_before", "_part"), "numbered")
    return out.drop("_row"), out


def pareto_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, seed: str = "mix", rate=None, carry: bool = False) -> DataFrame:
    """``doc_id, size, source_size, target, taken``, a row per input row.

    ``size`` counts words (null text: 0) and ``taken`` the words the mix takes,
    a multiple of ``size`` of at most ``cap`` times.  A null source is a source
    of its own; null ids draw by their text alone.  Rows with the same id and
    different texts draw the same number and ties go by id, then text.  Rows
    alike in id and text are drawn one by one, each with a number of its own;
    which of them is which does not matter, so reruns agree.  Empty texts have
    size 0 and take nothing from a target.  ``rate`` gives the relative rate of
    documents within their source: the name of a column, or a function of the
    size (``length_rate``); null is 1.  An empty table gives an empty result.
    With ``carry`` the input's columns come first, whatever their names, and
    ``_taken_copies`` follows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pareto-mix")
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    of = lambda c: F.col(f"_row.`{c}`")
    size = words_in(of(text_col))
    given = F.lit(1.0) if rate is None else of(rate) if isinstance(rate, str) else rate(size)
    tie = F.substring(F.sha1(F.coalesce(of(text_col), F.lit(""))), 1, 16)
    rows = named.select(*(["_row"] if carry else []), of(id_col).alias("_id"), size.alias("_size"), of(source_col).alias("_source"), tie.alias("_tie"), _rate(given).alias("_rate"))
    slim, rows = _numbered(rows, scratch)
    nth = F.when(F.col("_nth") > 0, F.concat(F.lit("|"), F.col("_nth").cast("string"))).otherwise(F.lit(""))
    drawn = F.md5(F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit("|"), F.lit(seed), nth).cast("binary"))
    u = (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") + 0.5) / _UNIT
    slim, rows = slim.withColumn("_u", u), (rows if carry else slim).withColumn("_u", u)

    classes = scratch.save(slim.groupBy("_source", "_rate").agg(F.sum("_size").alias("_words"), F.count("*").alias("_rows")), "classes")
    sums = scratch.save(classes.groupBy("_source").agg(F.sum("_words").alias("source_size"), F.sum("_rows").alias("_rows")), "sources")
    goal = targets(sums.select(F.col("_source").alias("source"), "source_size"), weights, cap).select(F.col("source").alias("_s"), "source_size", "target")
    goal = scratch.save(goal.join(_factors(classes, goal, cap), F.col("_s").eqNullSafe(F.col("_f")), "left").drop("_f"), "targets")
    count = sums.agg(F.count("*"), F.max("_rows")).first()
    small = (lambda d: F.broadcast(d)) if count[0] <= _BROADCAST_SOURCES else (lambda d: d)
    bins = _bins(count[1] or 0)

    def ranked(frame: DataFrame) -> DataFrame:
        g = small(goal.withColumnRenamed("_s", "_g"))
        frame = frame.join(g, frame["_source"].eqNullSafe(F.col("_g"))).drop("_g")
        copies = F.coalesce(F.col("_factor") * F.col("_rate"), F.lit(0.0))
        copies = F.when(copies >= cap - 1e-9, F.lit(float(cap))).otherwise(copies)
        frame = frame.withColumn("_copies", copies).withColumn("_base", F.floor("_copies").cast("long"))
        p, u = F.col("_copies") - F.col("_base"), F.col("_u")
        odds = (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p))
        frame = frame.withColumn("_v", F.when(p > 0, odds / (odds + 1.0)).otherwise(F.lit(1.0)))
        return frame.withColumn("_bin", F.least(F.floor(F.col("_v") * bins), F.lit(bins - 1)).cast("int")).withColumn("_may", (F.col("_base") < F.lit(float(cap))) & (F.col("_copies") > 0))

    ready = ranked(slim)
    fixed = ready.groupBy("_source").agg((F.max("target") - F.sum(F.col("_base") * F.col("_size"))).alias("_open"))
    by_bin = ready.filter("_may").groupBy("_source", "_bin").agg(F.sum("_size").alias("_words"))
    through = F.sum("_words").over(Window.partitionBy("_source").orderBy("_bin"))
    reach = by_bin.withColumn("_through", through).withColumnRenamed("_source", "_s")
    reach = reach.join(fixed, F.col("_s").eqNullSafe(fixed["_source"])).filter(F.col("_through") >= F.col("_open"))
    edge = reach.groupBy("_s").agg(F.min(F.struct("_bin", "_through", "_words", "_open")).alias("e"))
    edge = scratch.save(edge.select("_s", F.col("e._bin").alias("_edge"), (F.col("e._through") - F.col("e._words")).alias("_before"), F.col("e._open").alias("_open")), "edges")
    inside = ready.filter("_may").join(small(edge), ready["_source"].eqNullSafe(F.col("_s")) & (F.col("_bin") == F.col("_edge")))
    key = F.struct("_v", "_id", "_tie", "_nth")
    inside = inside.select("_s", key.alias("_key"), F.col("_size").alias("_words"), "_before", "_open")
    at = F.col("_before") + F.sum("_words").over(Window.partitionBy("_s").orderBy("_key"))
    # the row that crosses the target is taken if that leaves the sum nearer to it
    over, short = F.col("_at") - F.col("_open"), F.col("_open") - (F.col("_at") - F.col("_words"))
    near = inside.withColumn("_at", at).filter((over <= 0) | ((short > 0) & (over <= short)))
    last = near.groupBy("_s").agg(F.max("_key").alias("_last"))
    cut = scratch.save(edge.select("_s", "_edge").withColumnRenamed("_s", "_c").join(last, F.col("_c").eqNullSafe(F.col("_s")), "left").select("_c", "_edge", "_last"), "cuts")

    out = ranked(rows)
    cut = small(cut)
    out = out.join(cut, out["_source"].eqNullSafe(F.col("_c")), "left")
    taken_in = F.col("_may") & (F.col("_edge").isNull() | (F.col("_bin") < F.col("_edge")) | ((F.col("_bin") == F.col("_edge")) & F.coalesce(key <= F.col("_last"), F.lit(False))))
    out = out.withColumn("_taken_copies", F.col("_base") + F.when(taken_in, F.lit(1)).otherwise(F.lit(0)))
    if carry:
        return out.select("_row.*", "_taken_copies")
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_taken_copies")).cast("long").alias("taken"))


def _factors(classes: DataFrame, goal: DataFrame, cap: float) -> DataFrame:
    """``_f, _factor``: copies per unit of rate such that a source's capped copies give its target.

    If the classes with the highest rates are taken as capped, the factor of the
    others follows from the words that are left; the true factor is the largest of these.
    """
    by_rate = Window.partitionBy("_source").orderBy(F.desc("_rate"))
    above = F.coalesce(F.sum("_words").over(by_rate.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("_words") * F.col("_rate")).over(by_rate.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    each = classes.withColumn("_above", above).withColumn("_rest", rest).filter("_rest > 0").join(goal.select("_s", "target"), F.col("_source").eqNullSafe(F.col("_s")))
    return each.groupBy(F.col("_source").alias("_f")).agg(F.max((F.col("target") - float(cap) * F.col("_above")) / F.col("_rest")).alias("_factor"))
