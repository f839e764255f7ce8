"""Toxicity by class-conditional Kneser-Ney models.

Each class has an interpolated Kneser-Ney model of the bytes of its words:
orders above ``SHARED_ORDER`` hold counts of that class alone, from all labelled
training rows; the orders below hold one set of counts, from all documents, so an
expression too rare for its own counts backs off to the same probabilities in
either class.  Texts are compared by log-likelihood ratios normalised by length,
over the whole text; the worst word, the second worst other word and the worst
five words running find short expressions in long texts.  A logistic curve fitted
on a bounded sample of labelled rows that the models have not seen maps these four
to scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import sieve
from .tokens import LOWER, Slab, find, slabs

ORDER, SHARED_ORDER = 6, 3
DISCOUNT = 0.75
#: Most labelled rows of each class that fit the curve, those with the smallest hash of their id.
MAX_PER_CLASS = 5_000
#: One labelled row of so many, by a hash of its id, is left to the curve; the others fit the models.
CURVE_FOLD = 5
_CACHE_WORDS = 1 << 20
_START, _END = 1, 2


def _last(grams: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` symbols of packed grams."""
    return grams & np.int64((1 << 8 * order) - 1)


def packed_grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the start, each byte and the end of each word the ORDER symbols up to it, eight bits each (0: none), and its word."""
    size = end - start + 2
    word = np.repeat(np.arange(len(start)), size)
    place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(start, size) + place - 1
    symbol = LOWER[data[np.clip(at, 0, max(len(data) - 1, 0))]].astype(np.int64) if len(data) else np.zeros(len(at), np.int64)
    symbol[place == 0] = _START
    symbol[place == np.repeat(size, size) - 1] = _END
    grams = symbol.copy()
    for back in range(1, ORDER):
        grams[back:] |= np.where(place[back:] >= back, symbol[:-back] << 8 * back, 0)
    return grams, word


def _counts(grams: np.ndarray, raw: np.ndarray, order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(sorted grams, counts) by order: occurrences at the highest, below it the symbols seen before a gram, or occurrences at the start of words."""
    out, above = {}, None
    for k in range(order, 0, -1):
        keys, inverse = np.unique(_last(grams, k), return_inverse=True)
        seen = np.stack([np.bincount(inverse, r, minlength=len(keys)) for r in raw.T], 1)
        counts = seen
        if above is not None:
            longer, of_longer = above
            at = np.searchsorted(keys, _last(longer, k))
            kinds = np.stack([np.bincount(at, c > 0, minlength=len(keys)) for c in of_longer.T], 1)
            counts = np.where(kinds > 0, kinds, seen)
        whole = (keys >> 8 * (k - 1)) > 0  # the others are shorter grams at the start of a word
        above = keys[whole], seen[whole]
        out[k] = keys[whole], counts[whole]
    return out


class Models:
    """Both classes' models; ``keys[k]`` are the sorted packed grams of order k + 1."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, shared: np.ndarray, shared_counts: np.ndarray):
        """counts: of each gram of ORDER symbols in ordinary and in toxic texts; shared: grams of SHARED_ORDER + 1 symbols in all texts."""
        low, high = _counts(shared, shared_counts[:, None], SHARED_ORDER + 1), _counts(grams, counts, ORDER)
        self.keys: list[np.ndarray] = []
        self.alpha: list[np.ndarray] = []
        self.weight: list[np.ndarray] = []
        for k in range(1, ORDER + 1):
            keys, raw = low[k] if k <= SHARED_ORDER else high[k]
            raw = np.repeat(raw, 2, 1) if k <= SHARED_ORDER else raw
            self.keys.append(keys)
            if k == 1:
                self.alpha.append((raw + 1) / (raw.sum(0) + 256))
                self.unseen = 1 / (raw.sum(0) + 256)
                continue
            before = self.keys[k - 2]
            context = find(before, keys >> 8)
            raw, context = raw * (context >= 0)[:, None], np.maximum(context, 0)
            total = np.stack([np.bincount(context, r, minlength=len(before)) for r in raw.T], 1)
            kinds = np.stack([np.bincount(context, r > 0, minlength=len(before)) for r in raw.T], 1)
            with np.errstate(invalid="ignore", divide="ignore"):
                self.alpha.append(np.nan_to_num(np.maximum(raw - DISCOUNT, 0) / total[context]))
                self.weight.append(np.where(total > 0, DISCOUNT * kinds / total, 1.0))

    def probabilities(self, grams: np.ndarray) -> np.ndarray:
        """Of the last symbol of each packed gram after those before it, in ordinary and in toxic texts."""
        at = find(self.keys[0], _last(grams, 1))
        p = np.where((at >= 0)[:, None], self.alpha[0][np.maximum(at, 0)], self.unseen)
        for k in range(2, ORDER + 1):
            live = np.flatnonzero(_last(grams, k) >> 8 * (k - 1) > 0)
            before = find(self.keys[k - 2], _last(grams[live], k) >> 8)
            live, before = live[before >= 0], before[before >= 0]  # unknown contexts back off with weight 1
            at = find(self.keys[k - 1], _last(grams[live], k))
            p[live] = p[live] * self.weight[k - 2][before] + np.where((at >= 0)[:, None], self.alpha[k - 1][np.maximum(at, 0)], 0)
        return p

    def ratios(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Toxic over ordinary log-likelihood of each word; its start is given."""
        if not len(start):
            return np.zeros(0)
        grams, word = packed_grams(data, start, end)
        given = grams == _START
        p = self.probabilities(grams[~given])
        return np.bincount(word[~given], np.log(p[:, 1]) - np.log(p[:, 0]), minlength=len(start))


class Scorer:
    """Ratios of words, kept between slabs in sorted arrays of bounded size."""

    def __init__(self, models: Models):
        self.models = models
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0)) for _ in range(2)]

    def words(self, slab: Slab) -> np.ndarray:
        keys, first, inverse = np.unique(slab.hash, return_index=True, return_inverse=True)
        out, todo = np.empty(len(keys)), np.arange(len(keys))
        for known, values in self.levels:
            at = find(known, keys[todo])
            out[todo[at >= 0]] = values[at[at >= 0]]
            todo = todo[at < 0]
        if len(todo):
            out[todo] = self.models.ratios(slab.data, slab.start[first[todo]], slab.end[first[todo]])
            recent = self._merged(self.levels[1], (keys[todo], out[todo]))
            if len(recent[0]) > _CACHE_WORDS // 8:
                old = self.levels[0] if len(self.levels[0][0]) < _CACHE_WORDS else (np.zeros(0, np.uint64), np.zeros(0))
                self.levels[0], recent = self._merged(old, recent), (np.zeros(0, np.uint64), np.zeros(0))
            self.levels[1] = recent
        return out[inverse]

    @staticmethod
    def _merged(a, b):
        keys = np.concatenate((a[0], b[0]))
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate((a[1], b[1]))[order]

    def features(self, slab: Slab) -> np.ndarray:
        """For each row: ratio a byte, the worst word, the second worst other word, the worst five words running."""
        n = len(slab)
        out = np.zeros((n, 4))
        if not len(slab.hash):
            return out
        ratio = self.words(slab)
        row, length = slab.row(), (slab.end - slab.start + 1).astype(float)
        has = np.flatnonzero(np.diff(slab.first))
        begin = slab.first[has]
        out[:, 0] = np.bincount(row, ratio, minlength=n) / np.maximum(np.bincount(row, length, minlength=n), 1)
        out[has, 1] = np.maximum.reduceat(ratio, begin)
        worst = np.zeros(n, np.uint64)
        top = np.flatnonzero(ratio >= out[row, 1])
        worst[row[top]] = slab.hash[top]
        other = np.where(slab.hash == worst[row], -np.inf, ratio)
        out[has, 2] = np.maximum(np.maximum.reduceat(other, begin), -20)
        run = np.concatenate(([0.0], np.cumsum(ratio)))
        last = np.minimum(np.arange(len(ratio)) + 5, slab.first[1:][row])
        out[has, 3] = np.maximum.reduceat(run[last] - run[:-1], begin)
        return np.clip(out, -60, 60)


_KEPT: list[tuple[object, Scorer]] = []


def _scorer(shared) -> Scorer:
    models = shared.value
    if not _KEPT or _KEPT[0][0] is not models:
        _KEPT[:] = [(models, Scorer(models))]
    return _KEPT[0][1]


_GRAMS = "label int, gram long, n long"


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of ORDER symbols of rows with a label, and of SHARED_ORDER + 1 symbols of the others (as label -1)."""
    for batch in batches:
        label = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
        for rows, slab in slabs(batch.column(1)):
            if not len(slab.hash):
                continue
            _, first, inverse = np.unique(slab.hash, return_index=True, return_inverse=True)
            grams, word = packed_grams(slab.data, slab.start[first], slab.end[first])
            of_word = label[rows][slab.row()]
            for c in np.unique(of_word):
                times = np.bincount(inverse, of_word == c, minlength=len(first))[word]
                of_class = grams[times > 0] if c >= 0 else _last(grams[times > 0], SHARED_ORDER + 1)
                keys, at = np.unique(of_class, return_inverse=True)
                n = np.bincount(at, times[times > 0], minlength=len(keys)).astype(np.int64)
                yield pa.record_batch([pa.array(np.full(len(keys), c, np.int32)), pa.array(keys), pa.array(n)], ["label", "gram", "n"])


def _features(shared):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            out = np.zeros((batch.num_rows, 4))
            for rows, slab in slabs(batch.column("row").field(0)):
                out[rows] = scorer.features(slab)
            values = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), 4).cast(pa.list_(pa.float64()))
            yield pa.record_batch([batch.column("row"), values], ["row", "f"])

    return features


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights with intercept, and the centre and scale of x, by Newton's method."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), (x - centre) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, centre, scale


def toxicity(docs: DataFrame, labels: DataFrame, keep: list[str], text: str = "text", key: str = "doc_id", label: str = "toxic", train: Column | None = None, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """The columns ``keep`` with ``score``, from 0 to 1.

    Learns from the labelled rows for which ``train`` (a condition on ``labels``)
    holds; an id with both labels has none.  Four fifths of them, all of these, fit
    the orders of a class; of the others at most ``max_per_class`` of each class fit
    the curve.  The shared orders count all documents.  Null and empty texts have
    features 0; rows of one text have one score; an empty table gives no rows.
    Where one class has no labelled rows, all scores are 0.

    The driver gets distinct grams of six bytes of labelled texts and of four of all
    texts, so it grows as these do, not as the number of words or rows.
    """
    spark = docs.sparkSession
    given = labels if train is None else labels.where(train)
    given = given.select(F.col(key).cast("long").alias("__id"), F.col(label).cast("int").alias("__label")).dropna().where(F.col("__label").isin(0, 1))
    given = given.groupBy("__id").agg(F.min("__label").alias("__label"), F.max("__label").alias("__most")).where("__label = __most").drop("__most")
    fold = F.pmod(F.xxhash64(F.lit(7), "__id"), F.lit(CURVE_FOLD))
    rows = docs.select(F.col(key).cast("long").alias("__id"), F.col(text).alias("__text"))
    models_of = given.where(fold > 0)
    # only labelled texts are shuffled, at every size
    labelled = sieve(models_of, "__id", rows, F.col("__id")).join(models_of.hint("merge"), "__id").select("__label", "__text")
    counted = labelled.mapInArrow(_count_grams, _GRAMS).unionByName(rows.select(F.lit(-1).alias("__label"), "__text").mapInArrow(_count_grams, _GRAMS))
    grams = counted.groupBy("label", "gram").agg(F.sum("n").alias("n")).toArrow()
    of, gram, n = (grams[c].to_numpy() for c in ("label", "gram", "n"))
    if len({0, 1} & set(np.unique(of).tolist())) < 2:
        return docs.select(*keep, F.lit(0.0).alias("score"))
    keys, at = np.unique(gram[of >= 0], return_inverse=True)
    counts = np.stack([np.bincount(at, np.where(of[of >= 0] == c, n[of >= 0], 0), minlength=len(keys)) for c in range(2)], 1)
    models = Models(keys, counts, gram[of < 0], n[of < 0].astype(float))
    picked = None
    for c in (0, 1):
        part = given.where((F.col("__label") == c) & (fold == 0)).orderBy(F.xxhash64("__id"), "__id").limit(max_per_class)
        picked = part if picked is None else picked.union(part)
    known = docs.join(F.broadcast(picked), F.col(key).cast("long") == F.col("__id"))  # at most 2 * max_per_class
    shared = spark.sparkContext.broadcast(models)

    def described(frame: DataFrame, columns: list[str]) -> DataFrame:
        packed = frame.select(F.struct(F.col(text).alias("__text"), *columns).alias("row"))
        return packed.mapInArrow(_features(shared), f"row {packed.schema['row'].dataType.simpleString()}, f array<double>")

    curve = described(known, ["__label"]).select("f", "row.__label").collect()
    x, y = np.array([r.f for r in curve]).reshape(-1, 4), np.array([r["__label"] for r in curve], float)
    if len(set(y)) < 2:
        x, y = np.array([[0.0, 0, 0, 0], [1, 10, 10, 20]]), np.array([0.0, 1])
    w, centre, scale = _logistic(x, y)
    slope = w[1:] / scale
    linear = F.lit(float(w[0] - (slope * centre).sum()))
    for i in range(4):
        linear = linear + F.col("f")[i] * F.lit(float(slope[i]))
    return described(docs, keep).select(*[F.col("row")[c].alias(c) for c in keep], (1 / (1 + F.exp(-linear))).alias("score"))
