"""N-gram Jaccard self-join by prefix trees.

A document's set holds the 57-bit hashes of its word n-grams; documents with
one and the same set are one node from the start (its id is a 64-bit digest of
the set).  A link needs ``t`` of both sets in common, so three exact filters
come before any comparison:

1. *Hash prefixes.*  Two linked sets share at least ``l`` of the n-grams among
   the first ``n - ceil(t * n) + l`` of each, in order of the hash.  A node goes
   on if so many n-grams of its prefix are in another node's prefix too.
2. *True frequencies.*  Only the nodes that went on are read again, and all of
   their n-grams counted.  A node stays if ``ceil(t * n)`` of its n-grams occur
   in another one; the others of its n-grams can match nothing and are only
   counted.  From here on the global order is rare n-grams first (frequency to
   a power of two, then hash).
3. *Rare prefixes.*  Linked sets share an n-gram among the first
   ``n - ceil(t * n) + 1`` of each in that order.  Nodes under an n-gram of few
   nodes (at most ``_SMALL``) are pairs, checked by length and position;
   nodes that share more frequent ones are clusters, dealt as pairs of blocks,
   so that the pairs within a large group are never written out.

The sets to compare are stored in a trie; a set walks down it once, all sets
below a node share the overlap found so far, and a subtree is left as soon as
the lengths that remain cannot reach the overlap it needs.  A task returns the
components of its links and the number of links of each node.  What is left are
connected components over these links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Memory, Scratch, small_batches, tidy, tidy_group
from .components import components

#: Nodes under one n-gram of a prefix that are compared as pairs; nodes in a block of a cluster.
_SMALL, _BLOCK = 8, 1024
#: n-grams of a task and of a block; nodes whose keys may be broadcast (24 bytes each).
_TASK_GRAMS, _BLOCK_GRAMS, _BROADCAST_ROWS = 500_000, 500_000, 1_000_000
#: A prefix by hash is longer by a tenth of the set, so that linked sets share as many n-grams of it.
_LONGER = 10
#: UTF-8 bytes of texts that a worker handles at a time.
_PART_BYTES = 3 << 20
#: Words a worker remembers, and characters whose words are in memory at a time.
_WORDS_KNOWN, _SLICE_CHARS = 1 << 17, 1_000_000
_BITS = 57  # of a hash; the six bits above take the frequency's power of two
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


#: The hashes of words that a worker remembers from task to task.
_HASHES: list[Memory] = []


class Grams:
    """n-gram hashes of texts: ASCII letters lower-cased, words cut at ASCII white space."""

    def __init__(self, n: int):
        import xxhash

        Memory.claim("words")
        if not _HASHES:
            _HASHES.append(Memory(xxhash.xxh3_64_intdigest, _WORDS_KNOWN, "words"))
        self.n, self.known = n, _HASHES[0]

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All 57-bit hashes in text order, and the border of each text in them."""
        hashes, sizes, part, held = [], [], [], 0
        for text in texts:  # the words of a few megabytes at a time
            part.append(text)
            held += len(text or "")
            if held > _SLICE_CHARS:
                self._some(part, hashes, sizes)
                part, held = [], 0
        self._some(part, hashes, sizes)
        return np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate(([0], np.cumsum(np.array(sizes, np.int64))))

    def _some(self, texts: list[str | None], hashes: list[np.ndarray], sizes: list[int]) -> None:
        self.known.settle()
        words = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]  # bytes: ASCII rules
        counts = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.uint64, int(counts.sum()))
        n, ends = self.n, np.cumsum(counts)
        full = np.zeros(max(0, len(flat) - n + 1), np.uint64)
        for k in range(n):
            full += flat[k : k + len(full)] * _ODD[k % 8] * np.uint64(2 * (k // 8) + 1)
        parts = []
        for start, count in zip((ends - counts).tolist(), counts.tolist(), strict=True):
            if count >= n:
                parts.append(full[start : start + count - n + 1])
            elif count:  # too short: the whole sequence is its one n-gram
                parts.append(np.array([(flat[start : start + count] * _ODD[np.arange(count) % 8]).sum(dtype=np.uint64) + np.uint64(count)], np.uint64))
            sizes.append(max(1, count - n + 1) if count else 0)
        if parts:
            hashes.append(_mixed(np.concatenate(parts)) >> np.uint64(64 - _BITS))


def needed(a, b, t):
    """Least overlap of sets of ``a`` and ``b`` n-grams whose Jaccard similarity is at least ``t[0] / t[1]``."""
    return -(-(t[0] * (a + b)) // (t[0] + t[1]))


class Trie:
    """Ordered sets as a radix trie in arrays: a node per branching, its n-grams as one segment.

    ``sizes`` count n-grams that the arrays leave out, too, as no other set has them.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int] | None = None):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sizes = np.array([len(s) for s in sets] if sizes is None else sizes, np.int64)
        parent, depth, segments, leaf = [-1], [0], [np.zeros(0, np.uint64)], {}
        path: list[tuple[int, int]] = [(0, 0)]  # open nodes from the root: (node, depth at its end)
        last: np.ndarray | None = None
        for i in order:
            s, shared = sets[i], 0
            if last is not None:
                m = min(len(s), len(last))
                differ = np.flatnonzero(s[:m] != last[:m])
                shared = int(differ[0]) if len(differ) else m
            while path[-1][1] > shared:
                node, end = path.pop()
                if path[-1][1] < shared:  # the border falls inside this node: split it
                    cut, above = shared - path[-1][1], len(parent)
                    parent.append(path[-1][0])
                    segments.append(segments[node][:cut])
                    depth.append(shared)
                    parent[node], segments[node] = above, segments[node][cut:]
                    path.append((above, shared))
            node = len(parent)
            parent.append(path[-1][0])
            segments.append(s[shared:])
            depth.append(len(s))
            path.append((node, len(s)))
            leaf[node] = i
            last = s
        self._level_order(parent, depth, segments, leaf)

    def _level_order(self, parent, depth, segments, leaf) -> None:
        children: list[list[int]] = [[] for _ in parent]
        for node, above in enumerate(parent):
            if above >= 0:
                children[above].append(node)
        order, level = [0], 0
        while level < len(order):
            order += children[order[level]]
            level += 1
        place = {node: k for k, node in enumerate(order)}
        self.first = np.zeros(len(order) + 1, np.int64)  # children of k are first[k] .. first[k + 1]
        self.first[0] = 1
        for k, node in enumerate(order):
            self.first[k + 1] = self.first[k] + len(children[node])
        self.leaf = np.array([leaf.get(node, -1) for node in order], np.int64)
        self.depth = np.array([depth[node] for node in order], np.int64)
        self.starts = np.cumsum([0] + [len(segments[node]) for node in order])
        self.grams = np.concatenate([segments[node] for node in order])
        self.short, self.long = np.full(len(order), 1 << 60, np.int64), np.zeros(len(order), np.int64)
        self.deep = self.depth.copy()
        for k in range(len(order) - 1, -1, -1):  # sizes and depths of the sets at or below a node
            if self.leaf[k] >= 0:
                n = self.sizes[self.leaf[k]]
                self.short[k], self.long[k] = min(self.short[k], n), max(self.long[k], n)
            if k:
                up = place[parent[order[k]]]
                self.short[up], self.long[up] = min(self.short[up], self.short[k]), max(self.long[up], self.long[k])
                self.deep[up] = max(self.deep[up], self.deep[k])

    def walk(self, x: np.ndarray, t: tuple[int, int], size: int | None = None) -> np.ndarray:
        """Indexes of the stored sets that ``x``, a set of ``size``, is linked with.  The walk goes down level by level."""
        found: list[np.ndarray] = []
        held = len(x)
        n = held if size is None else size
        nodes, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(nodes):
            ends = self.leaf[nodes] >= 0
            if ends.any():
                which = self.leaf[nodes[ends]]
                hit = overlap[ends] >= needed(n, self.sizes[which], t)
                found.append(which[hit])
            counts = self.first[nodes + 1] - self.first[nodes]
            if not counts.any():
                break
            below = np.repeat(self.first[nodes] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
            shared = np.repeat(overlap, counts)
            # sizes alone: no set below is near enough in length
            fits = (self.short[below] * t[1] <= n * t[1] * t[1] // t[0] + t[1]) & (self.long[below] * t[1] >= n * t[0])
            below, shared = below[fits], shared[fits]
            if not len(below):
                break
            lengths = self.starts[below + 1] - self.starts[below]
            total = int(lengths.sum())
            if total:
                at = np.repeat(self.starts[below] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(total)
                grams = self.grams[at]
                spot = np.searchsorted(x, grams)
                inside = x[np.minimum(spot, held - 1)] == grams
                through = np.concatenate(([0], np.cumsum(inside)))
                border = np.cumsum(lengths)
                shared = shared + through[border] - through[border - lengths]
                tail = np.where(lengths > 0, np.minimum(np.searchsorted(x, self.grams[np.maximum(self.starts[below + 1] - 1, 0)], "right"), held), 0)
            else:
                tail = np.zeros(len(below), np.int64)
            # what can still be added: n-grams of x after this node's last, and n-grams below it
            most = shared + np.minimum(held - tail, self.deep[below] - self.depth[below])
            alive = most >= needed(n, np.maximum(self.short[below], -(-(n * t[0]) // t[1])), t)
            nodes, overlap = below[alive], shared[alive]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


class _Links:
    """The links that one task finds: components by union-find, and the number of links of each node."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.count: dict[int, int] = {}

    def root(self, x: int) -> int:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def add(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        """Link two ``(node, copies)``; the smaller root stays."""
        low, high = sorted((self.root(a[0]), self.root(b[0])))
        self.up[high] = low
        self.count[a[0]] = self.count.get(a[0], 0) + b[1]
        self.count[b[0]] = self.count.get(b[0], 0) + a[1]

    def table(self) -> pa.Table:
        """``node, root, n``: a row per node that has links."""
        return pa.table([pa.array(list(self.count), pa.int64()), pa.array([self.root(x) for x in self.count], pa.int64()), pa.array(list(self.count.values()), pa.int64())], names=["node", "root", "n"])


_FOUND = "node long, root long, n long"


def _least(size: str, t: tuple[int, int]) -> str:
    """SQL of ``ceil(t * size)``, the least overlap with any linked set."""
    return f"(({t[0]} * {size} + {t[1] - 1}) div {t[1]})"


def ngram_join(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text", stays: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links``, a row per input row.

    Documents are linked when the Jaccard similarity of their sets is at least
    ``threshold``.  ``component_id`` is the smallest id reachable by links
    (null ids come after all others; rows with one take part like any other);
    ``n_links`` counts the other rows linked directly, copies included.  Null
    and wordless texts have an empty set, no links, and their own id.  Rows
    with the same id are separate rows; texts of any length are taken whole.
    An empty table gives an empty result, and other columns of any name play no
    part.  Ids are read as integers (``long``).  Links rest on 57-bit hashes of
    n-grams and 64-bit digests of sets.

    With ``stays`` also ``row_key`` (that of ``row_key()``) and ``stays``, true for
    the one row of each component that is left when near copies go: the one with
    the smallest id, of several the one with the smallest key.  This is decided
    by row: rows that only share an id with a near copy are left alone.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "ngram-join")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_t"))
    rows = rows.withColumn("_key", row_key("_id", "_t"))  # texts are fetched by it
    heads = scratch.save(_heads(rows, n, threshold), "heads")
    each = heads.filter("_digest IS NOT NULL")
    nodes = scratch.save(each.groupBy("_digest").agg(F.min("_id").alias("_first"), F.min("_key").alias("_text"), F.count("*").alias("_copies"), F.max("_n").alias("_size")), "nodes")
    likely = scratch.save(_likely(heads, nodes, threshold), "likely")
    sets = scratch.save(_sets(rows, heads, likely, n), "sets")
    core = scratch.save(_core(sets, nodes, threshold), "core")
    scratch.drop("sets")

    pairs, cluster = _candidates(core, threshold, scratch)
    found = scratch.save(_compare_pairs(pairs, core, threshold).union(_compare_clusters(cluster, core, threshold, scratch)), "found")
    scratch.drop("core")

    joined = components(found.filter("root <> node").select(F.col("root").alias("a"), F.col("node").alias("b")), scratch, "links")
    counts = found.groupBy(F.col("node").alias("_d")).agg(F.sum("n").alias("_links"))
    least = joined.join(nodes, F.col("node") == F.col("_digest")).groupBy("root").agg(F.min("_first").alias("_least"))
    label = joined.join(least, "root").select(F.col("node").alias("_d2"), "_least", "root")
    known = counts.join(label, F.col("_d") == F.col("_d2"))
    known = nodes.join(known, F.col("_digest") == F.col("_d"), "left").filter("_copies > 1 OR _d IS NOT NULL")
    known = known.select("_digest", F.coalesce("root", "_digest").alias("_group"), F.coalesce("_least", "_first").alias("_component"), (F.col("_copies") - 1 + F.coalesce("_links", F.lit(0))).alias("_linked"))
    out = heads.select("_id", "_n", "_digest", "_key").join(known, "_digest", "left")
    columns = [F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.coalesce("_component", "_id").alias("component_id"), F.coalesce("_linked", F.lit(0)).cast("long").alias("n_links")]
    if not stays:
        return out.select(columns)
    first = F.struct(F.col("_id").isNull().alias("x"), F.col("_id").alias("y"), F.col("_key").alias("z"))
    best = scratch.save(out.filter("_group IS NOT NULL").groupBy(F.col("_group").alias("_g")).agg(F.min(first).alias("_best")), "best")
    out = out.join(best, F.col("_group") == F.col("_g"), "left")
    return out.select(*columns, F.col("_key").alias("row_key"), F.coalesce(F.col("_best") == first, F.lit(True)).alias("stays"))


def row_key(id_: str, text: str):
    """A 64-bit key of a row: of its id and whole text."""
    return F.xxhash64(F.col(id_), F.col(text))


def _heads(rows: DataFrame, n: int, t: tuple[int, int]) -> DataFrame:
    """``_id, _key, _n, _digest`` of each row, and ``_part, _prefix`` of each different set in a part of the rows."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from blocklens.llm._common import text_parts

        grams, context = Grams(n), TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        for batch in batches:
            for at, count, part in text_parts(batch, 2, _PART_BYTES):
                number += 1
                yield one(batch.column(0).slice(at, count), batch.column(1).slice(at, count), part, grams, number)

    def one(ids: pa.Array, keys: pa.Array, texts: list[str], grams: Grams, number: int) -> pa.RecordBatch:
        hashes, borders = grams.of(texts)
        digests, sizes, prefixes, known = [], [], [], set()
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            own = np.unique(hashes[a:b])
            size = len(own)
            sizes.append(size)
            digests.append(_digest(own) if size else None)
            fresh = size and digests[-1] not in known  # copies in this part are one node
            known.add(digests[-1])
            least = -(-(t[0] * size) // t[1])
            prefixes.append(own[: size - least + min(least, 1 + size // _LONGER)].astype(np.int64) if fresh else None)
        ends = np.cumsum([0] + [0 if p is None else len(p) for p in prefixes])
        flat = np.concatenate([p for p in prefixes if p is not None] + [np.zeros(0, np.int64)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array([p is None for p in prefixes]))
        return pa.RecordBatch.from_arrays([ids, keys, pa.array(sizes, pa.int64()), pa.array(digests, pa.int64()), pa.array([number] * len(sizes), pa.int64()), lists], names=["_id", "_key", "_n", "_digest", "_part", "_prefix"])

    return rows.select("_id", "_key", F.coalesce("_t", F.lit("")).alias("_t")).mapInArrow(tidy(send), "_id long, _key long, _n long, _digest long, _part long, _prefix array<long>")


def _digest(grams: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).astype(np.int64))


def _likely(heads: DataFrame, nodes: DataFrame, t: tuple[int, int]) -> DataFrame:
    """``_want, _node``: key and id of the nodes that share enough n-grams of their prefix by hash with others."""
    posted = heads.filter("_prefix IS NOT NULL").select(F.explode("_prefix").alias("gram"), F.col("_digest").alias("node"), "_part")
    common = posted.groupBy("gram").agg(F.min("node").alias("_low"), F.max("node").alias("_high")).filter("_low <> _high").select("gram")
    # a node's copies in other parts are counted apart
    shared = posted.join(common, "gram").groupBy("node", "_part").agg(F.count("*").alias("_held")).groupBy("node").agg(F.max("_held").alias("_held"))
    least = _least("_size", t)  # a linked set has that size at least
    enough = F.expr(f"_held >= least({_least(least, t)}, 1 + {least} div {_LONGER})")
    return shared.join(nodes, F.col("node") == F.col("_digest")).filter(enough).select(F.col("_text").alias("_want"), F.col("node").alias("_node"))


def _sets(rows: DataFrame, heads: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``node, grams`` of the wanted nodes, each from one of its texts."""
    few = wanted.count() <= _BROADCAST_ROWS
    near = F.broadcast if few else (lambda df: df)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from blocklens.llm._common import text_parts

        grams = Grams(n)
        for batch in batches:
            for at, count, part in text_parts(batch, 0, _PART_BYTES):
                hashes, borders = grams.of(part)
                sets = [np.unique(hashes[a:b]) for a, b in zip(borders[:-1], borders[1:], strict=True)]
                node = batch.column(1).slice(at, count)
                # a text that clashes with the wanted one by its key is dropped
                right = pa.array([_digest(s) == k for s, k in zip(sets, node.to_pylist(), strict=True)])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(s) for s in sets]), pa.int32()), pa.array(np.concatenate(sets).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([node, lists], names=["node", "grams"]).filter(right)

    texts = rows.join(near(wanted), F.col("_key") == F.col("_want")).select(F.coalesce("_t", F.lit("")).alias("_t"), "_node")
    made = texts.mapInArrow(tidy(build), "node long, grams array<long>")
    repeated = heads.join(near(wanted), (F.col("_key") == F.col("_want")) & (F.col("_digest") == F.col("_node"))).groupBy("_node").count().filter("count > 1").limit(1).count()
    return made.dropDuplicates(["node"]) if repeated else made


def _core(sets: DataFrame, nodes: DataFrame, t: tuple[int, int]) -> DataFrame:
    """``node, size, copies, codes``: n-grams that other nodes have too, rare ones first, of nodes with enough of them."""
    grams = sets.select("node", F.explode("grams").alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("_often")).filter("_often > 1")
    code = F.shiftleft(F.floor(F.log2("_often")).cast("long"), _BITS).bitwiseOR(F.col("gram"))
    codes = grams.join(often, "gram").select("node", code.alias("code")).groupBy("node").agg(F.array_sort(F.collect_list("code")).alias("codes"))
    known = nodes.select(F.col("_digest").alias("node"), F.col("_size").alias("size"), F.col("_copies").alias("copies"))
    return codes.join(known, "node").filter(f"size(codes) >= {_least('size', t)}").select("node", "size", "copies", "codes")


def _candidates(core: DataFrame, t: tuple[int, int], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b`` to compare, and ``node, cluster`` of nodes under frequent n-grams; pairs within a cluster are left out."""
    prefix = F.slice("codes", F.lit(1), F.expr(f"size(codes) - cast({_least('size', t)} AS int) + 1"))
    posted = scratch.save(core.select("node", "size", F.size("codes").alias("held"), F.posexplode(prefix).alias("at", "gram")), "posted")
    lists = scratch.save(posted.groupBy("gram").agg(F.count("*").alias("many"), F.min("node").alias("hub")).filter("many > 1"), "lists")

    few = posted.join(lists.filter(f"many <= {_SMALL}").select("gram"), "gram")
    one, two = (few.select("gram", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "size", "held", "at")]) for k in ("a", "b"))
    # an n-gram at places i and j has at most so many common ones before and behind it
    most = F.least("at_a", "at_b") + 1 + F.least(F.col("held_a") - F.col("at_a"), F.col("held_b") - F.col("at_b")) - 1
    needs = F.expr(f"({t[0]} * (size_a + size_b) + {t[0] + t[1] - 1}) div {t[0] + t[1]}")
    sizes = (F.least("size_a", "size_b") * t[1]) >= (F.greatest("size_a", "size_b") * t[0])
    pairs = one.join(two, "gram").filter((F.col("node_a") < F.col("node_b")) & sizes & (most >= needs)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()

    stars = posted.join(lists.filter(f"many > {_SMALL}").select("gram", "hub"), "gram").filter("node <> hub")
    cluster = components(stars.select(F.col("hub").alias("a"), F.col("node").alias("b")), scratch, "clusters").withColumnRenamed("root", "cluster")
    ca, cb = cluster.select(F.col("node").alias("a"), F.col("cluster").alias("_ca")), cluster.select(F.col("node").alias("b"), F.col("cluster").alias("_cb"))
    pairs = pairs.join(ca, "a", "left").join(cb, "b", "left").filter(~F.coalesce(F.col("_ca") == F.col("_cb"), F.lit(False))).select("a", "b")
    return scratch.save(pairs, "pairs"), cluster


def _arrays(table: pa.Table) -> list[np.ndarray]:
    codes = table["codes"].combine_chunks()
    codes = codes if isinstance(codes, pa.Array) else pa.concat_arrays(codes.chunks)
    flat, ends = codes.flatten().to_numpy().astype(np.uint64), codes.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True)]


def _compare_pairs(pairs: DataFrame, core: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Each pair's first node walks the trie of its partners."""
    own = pairs.select("a").distinct().select("a", F.lit(None).cast("long").alias("b"), F.col("a").alias("node"))
    each = own.union(pairs.select("a", "b", F.col("b").alias("node")))
    total = each.join(core.select("node", F.size("codes").alias("held")), "node").agg(F.sum("held")).first()[0] or 0
    groups = max(1, -(-total // _TASK_GRAMS))
    each = each.join(core, "node").select(F.pmod(F.xxhash64("a"), F.lit(groups)).alias("g"), "a", "b", "size", "copies", "codes").repartition(groups, "g")

    def compare(table: pa.Table) -> pa.Table:
        links, centre, partners = _Links(), {}, {}
        rows = table.select(["a", "b", "size", "copies"]).to_pylist()
        for row, codes in zip(rows, _arrays(table), strict=True):
            if row["b"] is None:
                centre[row["a"]] = (row, codes)
            else:
                partners.setdefault(row["a"], []).append((row, codes))
        for a, others in partners.items():
            own, codes = centre[a]
            for i in Trie([o[1] for o in others], [o[0]["size"] for o in others]).walk(codes, t, own["size"]).tolist():
                links.add((a, own["copies"]), (others[i][0]["b"], others[i][0]["copies"]))
        return links.table()

    return each.groupBy("g").applyInArrow(tidy_group(compare), _FOUND)


def _compare_clusters(cluster: DataFrame, core: DataFrame, t: tuple[int, int], scratch: Scratch) -> DataFrame:
    """Clusters by bands of set size, in blocks: a block meets those of its band and of the next."""
    ratio = t[1] / t[0]
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(ratio)) + 1e-9).cast("int")  # linked sizes are in one band or neighbours
    rows = scratch.save(core.join(cluster, "node").select("cluster", band.alias("band"), "node", "size", "copies", "codes"), "members")
    sizes = scratch.save(rows.groupBy("cluster", "band").agg(F.greatest(F.ceil(F.count("*") / F.lit(_BLOCK)), F.ceil(F.sum(F.size("codes")) / F.lit(_BLOCK_GRAMS))).cast("int").alias("blocks")), "bands")
    below = sizes.select("cluster", (F.col("band") + 1).alias("band"), F.col("blocks").alias("_below"))
    above = sizes.select("cluster", (F.col("band") - 1).alias("band"), F.col("blocks").alias("_above"))
    shape = sizes.join(below, ["cluster", "band"], "left").join(above, ["cluster", "band"], "left")
    rows = rows.join(shape, ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    mine, every = F.col("block"), F.sequence(F.lit(0), F.col("blocks") - 1)
    blank = F.array().cast("array<struct<x:int,y:int,z:int>>")
    # (lower band's block, band step, other block); in a band the pair of blocks is ordered
    same = F.transform(every, lambda o: F.struct(F.least(mine, o).alias("x"), F.lit(0).alias("y"), F.greatest(mine, o).alias("z")))
    up = F.when(F.col("_above").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("_above") - 1), lambda o: F.struct(mine.alias("x"), F.lit(1).alias("y"), o.alias("z")))).otherwise(blank)
    down = F.when(F.col("_below").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("_below") - 1), lambda o: F.struct(o.alias("x"), F.lit(-1).alias("y"), mine.alias("z")))).otherwise(blank)
    dealt = rows.withColumn("p", F.explode(F.concat(same, up, down)))
    low = F.when(F.col("p.y") == -1, F.col("band") - 1).otherwise(F.col("band"))
    step = F.abs(F.col("p.y"))
    left = F.when(F.col("p.y") == 0, F.col("block") == F.col("p.x")).otherwise(F.col("p.y") == 1)
    dealt = dealt.select(F.col("cluster").alias("c"), low.alias("l"), step.alias("s"), F.col("p.x").alias("x"), F.col("p.z").alias("z"), left.alias("left"), "node", "size", "copies", "codes")

    def compare(table: pa.Table) -> pa.Table:
        rows, sets = table.select(["s", "x", "z", "left", "node", "size", "copies"]).to_pylist(), _arrays(table)
        within = rows[0]["s"] == 0 and rows[0]["x"] == rows[0]["z"]
        one = [i for i, r in enumerate(rows) if r["left"]]
        two = one if within else [i for i, r in enumerate(rows) if not r["left"]]
        links = _Links()
        if one and two:
            trie = Trie([sets[i] for i in two], [rows[i]["size"] for i in two])
            for place, i in enumerate(one):
                for k in trie.walk(sets[i], t, rows[i]["size"]).tolist():
                    if within and k <= place:  # each pair once
                        continue
                    b = rows[two[k]]
                    links.add((rows[i]["node"], rows[i]["copies"]), (b["node"], b["copies"]))
        return links.table()

    return dealt.groupBy("c", "l", "s", "x", "z").applyInArrow(tidy_group(compare), _FOUND)
