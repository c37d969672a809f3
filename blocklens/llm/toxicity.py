"""Toxicity by a subsequence string-kernel support vector machine.

The kernel compares two short strings by their common subsequences of three and
four characters, gaps included, each weighed down by the span it takes up, and
normalises by what the strings' lengths allow.  So ``i.d.i.o.t`` stays near
``idiot``.
The machine is trained on Nystroem features: kernels to landmark strings,
whitened by the landmarks' own kernel matrix.  As the kernel is an inner product
over subsequences, the trained function folds into one weight per subsequence,
and a string is scored without the landmarks.

Strings are the words of a text (stripped of outer punctuation, long ones in
overlapping windows, runs of single characters joined).  Labels are given for
whole texts only, so training is multi-instance: words that mark toxic texts
are found by their frequencies, a machine is trained on them against words of
clean texts, and then each toxic text's best word is taken as positive again.
A text's score is its best word's, mapped to 0..1 on the training texts.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Memory, small_batches, tidy

#: Places of a subsequence's characters after its first one, in spans of at most 7, and the decay of a gap.
_SPAN, _DECAY = 7, 0.7
_PATTERNS = [p for size in (2, 3) for p in combinations(range(1, _SPAN), size)]
_ODD = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_BITS = 20
_WINDOW, _STEP = 24, 12
#: Words that begin where none stands out.
_FEW = 50
#: Margins beyond this say no more about a text.
_FAR = 2.0
#: Words a worker remembers, and words whose subsequences are in memory at a time.
_MEMORY, _CALL = 1 << 17, 2000
_SLICE_BYTES = 2 << 20


def words(text: str) -> list[str]:
    """The strings of a text that are scored, in any order, repeats included."""
    out, singles = [], []
    for w in text.lower().split():
        if not (w[0].isalnum() and w[-1].isalnum()):
            w = _strip(w)
            if not w:
                continue
        if len(w) == 1:
            singles.append(w)
            continue
        if singles:
            if len(singles) > 2:
                out += _windows("".join(singles))
            singles.clear()
        if len(w) > _WINDOW:
            out += _windows(w)
        else:
            out.append(w)
    if len(singles) > 2:
        out += _windows("".join(singles))
    return out


def _strip(w: str) -> str:
    a, b = 0, len(w)
    while a < b and not w[a].isalnum():
        a += 1
    while b > a and not w[b - 1].isalnum():
        b -= 1
    return w[a:b]


def _windows(w: str) -> list[str]:
    return [w] if len(w) <= _WINDOW else [w[i : i + _WINDOW] for i in range(0, len(w) - _STEP, _STEP)]


def subsequences(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(string, feature, value)`` of every subsequence that occurs."""
    marked = [f"\x02{s}\x03" for s in strings]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(marked)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters from here to the string's end
    norm = np.zeros(len(marked))
    parts = [codes * odd for odd in _ODD]
    first = codes * np.uint64(0x9E3779B97F4A7C15)
    owners, features, values = [], [], []
    for pattern in _PATTERNS:
        at = np.flatnonzero(left > pattern[-1])
        h = first[at] + np.uint64(len(pattern))
        for k, place in enumerate(pattern):
            h += parts[k][at + place]
        features.append((((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - _BITS)).astype(np.int64))
        owners.append(owner[at])
        value = _DECAY ** (pattern[-1] - len(pattern))
        values.append(np.full(len(at), value))
        norm += value * value * np.maximum(lengths - pattern[-1], 0)
    string = np.concatenate(owners)
    return string, np.concatenate(features), np.concatenate(values) / np.sqrt(np.maximum(norm, 1e-12))[string]


def kernels(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernels of all strings to all landmarks."""
    own, feature, value = subsequences(landmarks)
    used, column = np.unique(feature, return_inverse=True)
    table = np.zeros((len(used), len(landmarks)), np.float32)
    np.add.at(table, (column, own), value)
    where = np.full(1 << _BITS, len(used))
    where[used] = np.arange(len(used))
    out = np.zeros((len(strings), len(landmarks)), np.float32)
    for a in range(0, len(strings), 50):
        s, f, v = subsequences(strings[a : a + 50])
        hit = np.flatnonzero(where[f] < len(used))
        hit = hit[np.argsort(s[hit], kind="stable")]
        s, f, v = s[hit], where[f[hit]], v[hit]
        if len(s):
            start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            out[a + s[start]] = np.add.reduceat(table[f] * v[:, None].astype(np.float32), start)
    return out


def _machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps on the violating rows."""
    x = np.hstack((z, np.ones((len(z), 1), z.dtype)))
    ridge = np.eye(x.shape[1]) * penalty
    ridge[-1, -1] = 1e-8
    w, before = np.zeros(x.shape[1]), None
    for _ in range(30):
        inside = y * (x @ w) < 1
        if before is not None and (inside == before).all():
            break
        before = inside
        left, right = ridge.copy(), np.zeros(x.shape[1])
        where = np.flatnonzero(inside)
        for a in range(0, len(where), _CALL):
            at = where[a : a + _CALL]
            rows = x[at].astype(float)
            weighed = rows * weight[at, None]
            left += weighed.T @ rows
            right += weighed.T @ y[at]
        w = np.linalg.solve(left, right)
    return w[:-1], float(w[-1])


class Model:
    """Weights per subsequence, an offset, and the map to 0..1; pickled to the workers."""

    def __init__(self, table: np.ndarray | None, offset: float, slope: float, shift: float):
        self.table, self.offset, self.slope, self.shift = table, offset, slope, shift

    def strings(self, strings: list[str]) -> np.ndarray:
        out = np.full(len(strings), self.offset)
        for a in range(0, len(strings), _CALL):
            part = strings[a : a + _CALL]
            s, f, v = subsequences(part)
            out[a : a + len(part)] += np.bincount(s, self.table[f] * v, len(part))
        return out

    def probability(self, best: float | None) -> float:
        """Of a text whose best word scores ``best`` (None: it has no words)."""
        if self.table is None:
            return self.shift
        best = -_FAR if best is None else max(-_FAR, min(_FAR, best))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * best + self.shift))))


def _evidence(toxic: list[set[str]], clean: list[set[str]]) -> dict[str, float]:
    """Words of toxic texts by the log ratio of their text frequencies, and of their best run of four characters, cautiously."""
    number: dict[str, int] = {}
    of: dict[str, tuple[int, ...]] = {}
    for w in set().union(*toxic, *clean):
        m = f"\x02{w}\x03"
        of[w] = tuple({number.setdefault(m[i : i + 4], len(number)) for i in range(max(1, len(m) - 3))})
    a, b = (Counter(g for t in texts for g in set().union(*map(of.__getitem__, t))) for texts in (toxic, clean))

    def ratio(g: int) -> float:
        more, less = max(0.0, a[g] - 2 * math.sqrt(a[g])), b[g] + 2 * math.sqrt(b[g])
        return math.log((more + 0.5) / (len(toxic) + 1)) - math.log((less + 0.5) / (len(clean) + 1))

    best = {g: ratio(g) for g in a}
    whole_a, whole_b = (Counter(w for t in texts for w in t) for texts in (toxic, clean))
    whole = lambda w: math.log((whole_a[w] + 0.5) / (len(toxic) + 1)) - math.log((whole_b[w] + 0.5) / (len(clean) + 1))
    return {w: min(whole(w), max(best[g] for g in of[w])) for w in whole_a}


def _changed(w: str, dice: random.Random) -> str:
    """A word with a character put between some of its letters."""
    mark = dice.choice(".-*_ x")
    every = dice.random() < 0.5
    spot = dice.randrange(1, max(2, len(w)))
    return mark.join(w) if every else w[:spot] + mark + w[spot:]


def train(texts: list[str], labels: list[int], landmarks: int = 256, penalty: float = 0.03, rounds: int = 3, seed: int = 0) -> Model:
    """A model from labelled texts; with one label only, a constant."""
    if len(set(labels)) < 2:
        return Model(None, 0.0, 0.0, float(labels[0]) if labels else 0.0)
    dice = random.Random(seed)
    shared: dict[str, str] = {}
    bags = [{shared.setdefault(w, w) for w in words(t)} for t in texts]
    toxic, clean = ([b for b, y in zip(bags, labels, strict=True) if y == side and b] for side in (1, 0))
    plain = Counter(w for b in clean for w in b)
    evidence = _evidence(toxic, clean)
    marks = Counter(w for b in toxic for w in b if evidence[w] >= math.log(20) and plain[w] * 20 <= len(clean))
    if not marks:  # few or balanced labels: the words with most evidence begin, and the rounds choose again
        marks = Counter({w: sum(w in b for b in toxic) for w in sorted(evidence, key=lambda w: (-evidence[w], w))[:_FEW] if evidence[w] > 0})
    ordinary = sorted(plain, key=lambda w: (-plain[w], w))
    rare = sorted(ordinary[3000:])
    dice.shuffle(rare)
    negative = ordinary[:3000] + rare[:7000]
    # words of toxic texts without any evidence are ordinary too
    mild = sorted({w for b in toxic for w in b if evidence[w] < 0} - plain.keys())
    dice.shuffle(mild)
    negative += mild[:2000]
    model = None
    for _ in range(rounds):
        positive = [w for w, _ in sorted(marks.items(), key=lambda x: (-x[1], x[0]))][:2000]
        if not positive:
            break
        negative = [w for w in dict.fromkeys(negative) if w not in marks]
        other = [_changed(w, dice) for w in positive]
        harmless = [_changed(w, dice) for w in negative[:1500]]
        strings = positive + other + negative + harmless
        y = np.array([1.0] * (len(positive) + len(other)) + [-1.0] * (len(negative) + len(harmless)))
        rate = (y < 0).sum() / (y > 0).sum()
        often = np.sqrt([marks[w] for w in positive])
        weight = np.where(y > 0, min(50.0, rate / 4 + 1), 1.0)
        weight[: 2 * len(positive)] *= np.tile(often / often.mean(), 2)
        chosen = list(dict.fromkeys(positive[: landmarks // 2] + negative[: landmarks - min(len(positive), landmarks // 2)]))
        own = kernels(chosen, chosen).astype(float)
        values, vectors = np.linalg.eigh(own)
        keep = values > 1e-6 * values.max()
        white = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
        features = kernels(strings, chosen)
        features = features @ white
        w, offset = _machine(features, y, weight, penalty)
        del features
        s, f, v = subsequences(chosen)
        table = np.bincount(f, v * (white @ w)[s], 1 << _BITS)
        model = Model(table.astype(np.float32), offset, 1.0, 0.0)
        # each toxic text's best word is positive from now on; clean words that score high are hard negatives
        vocabulary = sorted(set().union(*bags))
        score = dict(zip(vocabulary, model.strings(vocabulary).tolist(), strict=True))
        best = [max(b, key=lambda w: (score[w], w)) for b in toxic]
        likely = {w for w in {*marks, *best} if score[w] > 0 and evidence[w] > math.log(4) and plain[w] * 20 <= len(clean)}
        marks = Counter(w for b in toxic for w in likely & b)
        hard = sorted((w for w in plain if w not in marks), key=lambda w: -score[w])
        negative = negative + hard[:3000]
    if model is None:
        return Model(None, 0.0, 0.0, sum(labels) / len(labels))
    best = np.clip([max(map(score.__getitem__, b), default=-_FAR) for b in bags], -_FAR, _FAR)
    model.slope, model.shift = _logistic(best, np.array(labels, float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic map (targets drawn in a little, as Platt does)."""
    up, down = (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    design, w = np.stack((x, np.ones_like(x)), 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-6 * np.eye(2), design.T @ (goal - p) - 1e-6 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def sample(docs: DataFrame, labels: DataFrame, toxic_rows: int = 1500, clean_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``_id, _t, _y``: at most so many labelled texts of each class, picked by a hash of their id; never held-out ones.

    A label other than 0 and 1, a null id and a label without a document are
    left out; an id with both labels counts as toxic, and of documents that
    share an id the text that comes first is taken, so the bound holds for repeated
    rows, too.  Empty tables give an empty sample.
    """
    marked = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_l")).agg(F.max(label_col).cast("int").alias("_y"))
    by = F.xxhash64("_l")
    picked = marked.filter("_y = 1").orderBy(by, "_l").limit(toxic_rows).union(marked.filter("_y = 0").orderBy(by, "_l").limit(clean_rows))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
    rows = rows.join(F.broadcast(picked), F.col("_id") == F.col("_l"))  # bounded by the two limits
    return rows.groupBy("_id").agg(F.min("_t").alias("_t"), F.max("_y").alias("_y"))


def fit(sampled: DataFrame) -> Model:
    """Trains on a bounded sample in one task of an executor; the driver gets the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from blocklens.llm.toxicity import train

        rows = [row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
        rows.sort()
        model = train([r[1] for r in rows], [r[2] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([None if model.table is None else model.table.tobytes()], pa.binary()), *[pa.array([float(x)]) for x in (model.offset, model.slope, model.shift)]], names=["table", "offset", "slope", "shift"])

    # each row is sorted by id, so the model does not depend on how rows were dealt out
    row = sampled.repartition(1).mapInArrow(tidy(run), "table binary, offset double, slope double, shift double").first()
    if row is None:  # an empty sample may have no task
        return train([], [])
    return Model(None if row["table"] is None else np.frombuffer(row["table"], np.float32), row["offset"], row["slope"], row["shift"])


def held_out(id_column):
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


_SCORES: dict[int, Memory] = {}


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``doc_id, held_out, score, predicted``, a row per input row, of whole texts.

    A null, empty or wordless text gets the score of no evidence; a text of any
    length is scored whole, by its best word.  The score depends on the text
    alone, so repeated rows are rows each with one score, and ties cannot
    matter; null ids are not held out; an empty table gives an empty result.
    With ``carry`` the input's columns come first, whatever their names, and
    ``_score, _predicted`` follow.
    """
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    sent = spark.sparkContext.broadcast((model.table.tobytes() if model.table is not None else None, model.offset, model.slope, model.shift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from blocklens.llm._common import Memory, text_parts
        from blocklens.llm.toxicity import _SCORES, Model, words

        Memory.claim("scores")
        table, offset, slope, shift = sent.value
        own = Model(None if table is None else np.frombuffer(table, np.float32), offset, slope, shift)
        key = hash((offset, slope, shift))
        if key not in _SCORES:  # another model: its scores take the place of the last one's
            known = next(iter(_SCORES.values())) if _SCORES else Memory(None, _MEMORY, "scores")
            known.clear()
            known.older = {}
            _SCORES.clear()
            _SCORES[key] = known
        known = _SCORES[key]
        for batch in batches:
            scores: list[float] = []
            for _, _, part in text_parts(batch, batch.num_columns - 1, _SLICE_BYTES):
                if own.table is None:
                    scores += [shift] * len(part)
                    continue
                known.settle()
                found = [words(t) for t in part]
                fresh = known.unknown(set().union(*found))
                known.update(zip(fresh, own.strings(fresh).tolist(), strict=True))
                get = known.__getitem__
                scores += [own.probability(max(map(get, f), default=None)) for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "_score"])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t")
    if carry:
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text)
        out = rows.mapInArrow(tidy(run), f"_row {rows.schema['_row'].dataType.simpleString()}, _score double")
        return out.select("_row.*", "_score", (F.col("_score") >= 0.5).cast("int").alias("_predicted"))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text)
    out = rows.mapInArrow(tidy(run), f"_id {rows.schema['_id'].dataType.simpleString()}, _score double")
    return out.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
