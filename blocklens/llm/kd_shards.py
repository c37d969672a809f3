"""Sharding by a k-d tree of weighted medians (DataFrame functions only).

Points are whole groups of equal texts with their bytes as weight.  A node that
holds ``k`` shards is cut along its widest dimension where ``floor(k/2)/k`` of
its bytes lie below, until each leaf is one shard of the target bytes.  All
nodes of a level are cut together: one pass sums weights by histogram bin, a
window over the bins finds the bin that holds the median, and the next pass
refines only that bin.  The driver sees one row per node and pass, at most
``shards`` rows.

Coordinates come from the text alone, so equal texts are one point and share a
shard.  No median can cut a point that is a good part of a shard, so groups
above an eighth of a shard, fewer than ``8 * shards``, are placed first, the
heaviest ones into the emptiest shards, and the tree deals the rest by the room
that is left.  A group stays whole unless it outweighs one whole shard; such a
group, of which there are fewer than ``shards``, is cut into pieces by id.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch

#: Low bits of a sort key, of the text's hash.
_TIE = 32
#: Groups above this part of a shard are placed before the tree; pieces a shard of a group that outweighs it.
_HEAVY, _PIECES = 8, 4
_BINS = 2048
_SLOT_ROWS = 50_000


def _case(node: Column, values: dict[int, object], otherwise) -> Column:
    """``values[node]`` as a CASE over the few nodes of a level."""
    return reduce(lambda c, kv: F.when(node == kv[0], F.lit(kv[1])).otherwise(c), values.items(), F.lit(otherwise))


def text_dimensions(text: Column) -> list[Column]:
    """The default metadata: bytes, bytes per 1000 characters, lines."""
    text = F.coalesce(text, F.lit(""))
    size = F.octet_length(text)
    return [size, (size * 1000 / F.greatest(F.char_length(text), F.lit(1))).cast("long"), F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))]


def kd_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", dimensions=text_dimensions, overhead: int = 8, tolerance: float = 0.002) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, a row per input row.

    ``size`` is the text's UTF-8 bytes (null: none) plus ``overhead``.  The law
    is ``bytes``: shard sizes near equal, up to the weight of one point and
    ``tolerance`` of a shard a cut.  Equal texts share a shard unless all of
    them together outweigh one (a 64-bit hash and the CRC32 tell texts apart).
    Slots run from 0 without gaps in each shard.  Null and empty texts are one
    group; repeated rows each get a slot, ties go by id; texts of any length
    are measured whole; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "kd-shards")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    dims = dimensions(F.col(f"`{text_col}`"))
    names = [f"k{i}" for i in range(len(dims))]
    limit = (1 << (63 - _TIE)) - 1
    rows = docs.select(
        F.col(f"`{id_col}`").alias("_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("_g"),
        *[F.least(F.greatest(d.cast("long"), F.lit(0)), F.lit(limit)).alias(f"_v{i}") for i, d in enumerate(dims)],
    )
    rows = scratch.save(rows, "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    target = max(1.0, total / shards)
    groups = rows.groupBy("_g", "text_crc32").agg(F.sum("size").alias("_w"))
    large = groups.filter(F.col("_w") > target / _HEAVY).collect()  # fewer than _HEAVY * shards, as their weights add up to the total
    placed_first, room = _place({(r["_g"], r["text_crc32"]): r["_w"] for r in large}, shards, target)
    if placed_first:
        rows = rows.join(F.broadcast(_table(spark, placed_first)), ["_g", "text_crc32"], "left")
        fixed = F.element_at("_at", (F.pmod(F.xxhash64("_id", F.lit(1)), F.size("_at")) + 1).cast("int"))
    else:
        fixed = F.lit(None).cast("int")
    tie = F.pmod(F.col("_g"), F.lit(1 << _TIE))
    keyed = rows.select("_id", "size", "text_crc32", fixed.alias("_fixed"), *[(F.shiftleft(f"_v{i}", _TIE) + tie).alias(n) for i, n in enumerate(names)])
    points = scratch.save(keyed.filter("_fixed IS NULL").groupBy(*names).agg(F.sum("size").alias("_w")), "points")
    node = _grow(points, names, room, target * tolerance)

    placed = scratch.save(keyed.select("_id", "size", "text_crc32", F.coalesce("_fixed", node).alias("shard")), "placed")
    buckets = max(1, math.ceil(placed.count() / shards / _SLOT_ROWS))
    placed = placed.withColumn("_b", F.pmod(F.xxhash64("_id"), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("shard", "_b").agg(F.count("*").alias("_n"))
    offsets = counts.select("shard", "_b", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_b")) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("shard", "_b").orderBy("_id", "text_crc32", "size")
    slotted = placed.withColumn("_at", F.row_number().over(inside)).join(offsets, ["shard", "_b"])
    return slotted.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") + F.col("_at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _place(groups: dict[tuple, int], shards: int, target: float) -> tuple[dict[tuple, list[int]], list[float]]:
    """The shards of each heavy group (one, or one a piece), and the room that is left in every shard."""
    loads, at = [0.0] * shards, {}
    pieces = []
    for key, weight in groups.items():
        count = 1 if weight <= target else math.ceil(weight / target * _PIECES)
        at[key] = [0] * count
        pieces += [(weight / count, key, i) for i in range(count)]
    for weight, key, i in sorted(pieces, key=lambda x: (-x[0], x[1], x[2])):
        shard = min(range(shards), key=lambda k: (loads[k], k))
        loads[shard] += weight
        at[key][i] = shard
    # what the rest can fill: all shards up to one level
    level, open_ = 0.0, max(0.0, target * shards - sum(loads))
    for k, load in enumerate(ordered := sorted(loads), 1):
        level = (open_ + sum(ordered[:k])) / k
        if k == shards or level <= ordered[k]:
            break
    return at, [max(0.0, level - load) for load in loads]


def _table(spark: SparkSession, at: dict[tuple, list[int]]) -> DataFrame:
    rows = [F.struct(F.lit(g).cast("long").alias("_g"), F.lit(c).cast("long").alias("text_crc32"), F.array(*[F.lit(s) for s in where]).alias("_at")) for (g, c), where in at.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _tree(cuts: dict[int, tuple[str, int]], leaf, i: int = 0) -> Column:
    """The tree as nested CASEs, each node once."""
    if i not in cuts:
        return F.lit(leaf(i))
    axis, cut = cuts[i]
    return F.when(F.col(axis) < cut, _tree(cuts, leaf, 2 * i + 1)).otherwise(_tree(cuts, leaf, 2 * i + 2))


def _grow(points: DataFrame, names: list[str], room: list[float], slack: float) -> Column:
    """The shard of a row with columns ``names``, as an expression; ``room`` is what each shard is to take."""
    share = {0: (0, len(room))}  # node: (its first shard, its shards); children of i are 2i+1 and 2i+2
    cuts: dict[int, tuple[str, int]] = {}
    level = [0] if len(room) > 1 else []
    world: dict[str, int] = {}
    while level:
        here = points.withColumn("_node", _tree(cuts, lambda i: i)).filter(F.col("_node").isin(level))
        spans = here.groupBy("_node").agg(F.sum("_w").alias("w"), *[F.min(n).alias(f"lo_{n}") for n in names], *[F.max(n).alias(f"hi_{n}") for n in names]).collect()
        search, found = {}, {}
        for s in spans:
            span = {n: (s[f"hi_{n}"] >> _TIE) - (s[f"lo_{n}"] >> _TIE) for n in names}
            world = world or {n: max(1, v) for n, v in span.items()}
            axis = max(names, key=lambda n: span[n] / world[n])
            first, k = share[s["_node"]]
            left, whole = sum(room[first : first + k // 2]), sum(room[first : first + k])
            if left <= 0 or left >= whole:  # one side is full already
                found[s["_node"]] = (axis, s[f"lo_{axis}"] if left <= 0 < whole else s[f"hi_{axis}"] + 1)
            else:
                search[s["_node"]] = {"axis": axis, "lo": s[f"lo_{axis}"], "hi": s[f"hi_{axis}"], "all": s["w"], "want": s["w"] * left / whole, "below": 0}
        found |= _weighted_cuts(here, search, slack)
        for i in found:
            first, k = share[i]
            share |= {2 * i + 1: (first, k // 2), 2 * i + 2: (first + k // 2, k - k // 2)}
        cuts |= found
        level = [c for i in found for c in (2 * i + 1, 2 * i + 2) if share[c][1] > 1]
    return _tree(cuts, lambda i: share[i][0])


def _weighted_cuts(here: DataFrame, search: dict[int, dict], slack: float) -> dict[int, tuple[str, int]]:
    """For each node the key of its axis below which about ``want`` bytes lie."""
    cuts, node = {}, F.col("_node")
    while search:
        of = lambda what, other: _case(node, {i: s[what] for i, s in search.items()}, other)  # noqa: E731, B023
        for s in search.values():
            s["wide"] = max(1, -(-(s["hi"] - s["lo"] + 1) // _BINS))
        key = reduce(lambda c, kv: F.when(node == kv[0], F.col(kv[1]["axis"])).otherwise(c), search.items(), F.lit(None).cast("long"))
        inside = here.filter(node.isin(list(search))).select("_node", "_w", key.alias("_k")).filter((F.col("_k") >= of("lo", 0)) & (F.col("_k") <= of("hi", 0)))
        sums = inside.groupBy("_node", F.call_function("div", F.col("_k") - of("lo", 0), of("wide", 1).cast("long")).alias("_bin")).agg(F.sum("_w").alias("_w"))
        through = F.sum("_w").over(Window.partitionBy("_node").orderBy("_bin")) + of("below", 0)
        hit = sums.withColumn("_through", through).filter(F.col("_through") >= of("want", 0.0)).groupBy("_node").agg(F.min(F.struct("_bin", "_through", "_w")).alias("m")).collect()
        for i, (at, over, w) in [(r["_node"], r["m"]) for r in hit]:
            s = search[i]
            start, before = s["lo"] + at * s["wide"], over - w
            if s["wide"] > 1 and min(s["want"] - before, over - s["want"]) > slack:
                s |= {"lo": start, "hi": start + s["wide"] - 1, "below": before}
                continue
            upper = over - s["want"] <= s["want"] - before  # the nearer edge, but rather no empty side
            upper = (upper or before == 0) and (over < s["all"] or before == 0)
            cuts[i] = (s["axis"], start + s["wide"] if upper else start)
            del search[i]
    return cuts
