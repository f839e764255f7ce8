"""Quality classification by importance resampling.

Two generative models over hashed n-grams, one fitted on texts labelled good
and one on all raw texts, give each document an importance weight: the ratio of
its probabilities.  Gumbel noise turns log weights into keys of which the k
largest are a sample without replacement in proportion to the weights.  k is
given as a share of the rows; without one it is the number of keys above the
value that parts labelled rows which the target model has not seen with fewest
errors, so it follows the share of good documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .tokens import Slab, chain, slabs

BUCKETS = 10_000
#: Most labelled rows used, those with the smallest hash of their id.
MAX_LABELLED = 100_000
#: One labelled row of so many is left to the border and not in the target model.
BORDER_FOLD = 5
#: The k-th largest key is searched by counts in so many ranges, each time in the range that holds it.
_RANGES = 1 << 12


def features(slab: Slab, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each n-gram: words and marks, their pairs, and two more buckets for a word said again at once or next but one."""
    row, m = slab.row(), np.uint64(buckets)
    if not len(row):
        return np.zeros(0, np.int64), row
    out, rows = [(slab.hash % m).astype(np.int64)], [row]
    worded = slab.data[slab.start] >= 0x30
    for gap in (1, 2):
        near = row[gap:] == row[:-gap]
        if gap == 1:
            out.append((chain([slab.hash[:-1], slab.hash[1:]]) % m).astype(np.int64)[near])
            rows.append(row[1:][near])
        again = near & worded[gap:] & (slab.hash[gap:] == slab.hash[:-gap])
        out.append(np.full(again.sum(), buckets + gap - 1))
        rows.append(row[gap:][again])
    return np.concatenate(out), np.concatenate(rows)


def _count(wanted: np.ndarray, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets + 2, np.int64), np.zeros(buckets + 2, np.int64)
        for batch in batches:
            good = np.isin(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), wanted) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for rows, slab in slabs(batch.column(1), marks=True):
                f, r = features(slab, buckets)
                raw += np.bincount(f, minlength=len(raw))
                target += np.bincount(f[good[rows][r]], minlength=len(raw))
        yield pa.record_batch([pa.array(np.arange(len(raw))), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    return count


def _weigh(shared, buckets: int):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for rows, slab in slabs(batch.column("row").field(0), marks=True):
                f, r = features(slab, buckets)
                out[rows] = np.bincount(r, ratio[f], minlength=len(slab))
            yield pa.record_batch([batch.column("row"), pa.array(out)], ["row", "log_weight"])

    return weigh


def gumbel(*seeds: Column) -> Column:
    """Standard Gumbel noise that the seeds fix."""
    u = (F.pmod(F.xxhash64(*seeds), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def _threshold(keys: np.ndarray, good: np.ndarray) -> float:
    """The key that parts good from other rows with fewest errors; of equal ones the lowest."""
    if not len(keys) or good.all():
        return -np.inf
    order = np.argsort(keys, kind="stable")
    keys, good = keys[order], good[order]
    errors = np.concatenate(([0], np.cumsum(np.where(good, 1, -1))))  # with the i lowest rejected
    cuts = np.concatenate(([True], keys[1:] > keys[:-1], [True]))
    at = int(np.where(cuts, errors, len(keys) + 1).argmin())
    if at in (0, len(keys)):
        return -np.inf if at == 0 else np.inf
    return float((keys[at - 1] + keys[at]) / 2)


def kth_largest(keys: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, exactly, by counts alone: no task or driver holds more than a few thousand rows."""
    value = F.col(column)
    n, low, high = keys.agg(F.count(value), F.min(value), F.max(value)).first()
    if k <= 0 or not n:
        return np.inf
    k = min(k, n)
    while low < high:
        width = (high - low) / _RANGES
        part = F.least(F.lit(_RANGES - 1), F.floor((value - F.lit(low)) / F.lit(width))) if width > 0 else F.lit(0)
        counts = keys.where(value.between(low, high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()
        for r in sorted(counts, key=lambda r: -r.part):
            if r.n >= k:
                break
            k -= r.n
        if (r.low, r.high) == (low, high):  # neighbouring doubles: nothing left to part
            above = keys.where(value == F.lit(high)).count()
            return high if above >= k else low
        low, high = r.low, r.high
    return low


def importance_resampling(
    docs: DataFrame,
    labels: DataFrame,
    keep: list[str],
    text: str = "text",
    key: str = "doc_id",
    label: str = "quality",
    buckets: int = BUCKETS,
    max_labelled: int = MAX_LABELLED,
    seed: int = 0,
    share: float | None = None,
) -> DataFrame:
    """The columns ``keep`` with log_weight, gumbel_key and selected.

    With ``share`` the rows with the share * n largest keys are selected; rows of one
    key stay or go together, so repeats may exceed it.  A null or empty text has
    weight 1 (log 0).  Rows with equal key and text share their noise.  An id that is
    labelled both good and bad counts as unlabelled.  Without labelled good rows all
    weights are 1; without labelled bad rows, and so without a border, all rows are
    selected.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    given = labels.select(F.col(key).cast("long").alias("id"), F.col(label).alias("good")).dropna().groupBy("id").agg(F.min("good").alias("good"), F.max("good").alias("most"))
    sample = given.where("good = most").select("id", "good", (F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(BORDER_FOLD)) == 0).alias("held")).orderBy(F.xxhash64("id"), "id").limit(max_labelled).collect()
    wanted = np.array(sorted(r.id for r in sample if r.good == 1 and not r.held), np.int64)
    counts = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(_count(wanted, buckets), "bucket long, raw long, target long")
    counts = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(buckets + 2), np.zeros(buckets + 2)
    for r in counts:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    ratio = np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    if not len(wanted):
        ratio[:] = 0
    shared = spark.sparkContext.broadcast(ratio)

    def scored(frame: DataFrame, columns: list[str]) -> DataFrame:
        # the text once, at place 0, and the key at place 1
        order = list(dict.fromkeys([text, key, *columns]))
        rows = frame.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(order)]).alias("row"))
        out = rows.mapInArrow(_weigh(shared, buckets), f"row {rows.schema['row'].dataType.simpleString()}, log_weight double")
        noise = gumbel(F.col("row.c1"), F.col("row.c0"), F.lit(seed))
        return out.select(*[F.col(f"row.c{order.index(c)}").alias(c) for c in columns], "log_weight", (F.col("log_weight") + noise).alias("gumbel_key"))

    if share is not None:
        keys = stored(scored(docs, []).select("gumbel_key"), "gumbel-keys")
        k = round(share * keys.count())
        return scored(docs, keep).withColumn("selected", F.col("gumbel_key") >= F.lit(kth_largest(keys, "gumbel_key", k)))
    held = [(r.id, int(r.good)) for r in sample if r.held]
    known = docs.join(F.broadcast(spark.createDataFrame(held, "__id long, __good int")), F.col(key).cast("long") == F.col("__id"))  # at most max_labelled rows
    known = scored(known, ["__good"]).select("gumbel_key", "__good").collect()
    border = _threshold(np.array([r.gumbel_key for r in known]), np.array([r["__good"] == 1 for r in known], bool))
    return scored(docs, keep).withColumn("selected", F.col("gumbel_key") > border)
