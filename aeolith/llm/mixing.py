"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in native expressions only.

Every source gets a target number of words.  Whole epochs of a source come
first; the rest is filled with its documents in the order of exponential keys
divided by their quality weights, up to the prefix sum nearest the rest.  Prefix
sums are taken in two steps, over key ranges and then inside each, so that no
task holds a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import parted
from .storage import drop, stored

MAX_EPOCHS = 3
#: Key ranges of a source.
RANGES = 1024
SIZE_PATTERN = r"[^\x20\x09-\x0D]+"


def document_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SIZE_PATTERN)).cast("long"), F.lit(0).cast("long"))


def exponential_key(identity: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) from a digest of the identity."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(identity.cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digest, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def _given_weight(unlabelled: float) -> Column:
    weight = F.coalesce("__weight", F.lit(unlabelled)).cast("double")
    return F.when((weight > 0) & ~F.isnan(weight), weight).otherwise(1.0)


def _rates(low: float, high: float) -> list[float]:
    """Rates from the largest weight down to the least or below it, each half of the one before; of wider spans at most 64, further apart."""
    top = math.log2(high)
    steps = max(0, math.ceil(top - math.log2(low)))
    n = min(64, steps + 1)
    return [2.0 ** (top - steps * i / max(1, n - 1)) for i in range(n)]


def key_range(key: Column, rates: list[float], ranges: int) -> Column:
    """The range of a key: even parts of the mean of the exponential distributions of some rates.

    Keys of a weight are exponential with its rate, whose density is at most twice that of
    the rate below it, so a range holds at most 2 * len(rates) / ranges of the documents,
    whatever the shares of the weights.
    """
    beyond = sum((F.exp(key * -r) for r in rates), F.lit(0.0)) / len(rates)
    return F.floor((1 - beyond) * ranges).cast("int")


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source_size and target of each source (s_null, s_key); one row a source, so one window over all of them.

    Sources in the order of their names, null last, weigh 1, 2, 3, 1, ... and share
    the whole; a target stops at max_epochs times its source, and what lies above
    is shared by weight among the rest.
    """
    rank = F.row_number().over(Window.orderBy("s_null", "s_key"))
    weighted = sizes.withColumn("weight", (1 + (rank - 1) % 3).cast("double"))
    weighted = weighted.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "s_null", "s_key").rowsBetween(Window.unboundedPreceding, -1)
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    open_words = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = weighted.withColumn("level", open_words / open_weight)
    # sources are capped as long as the cap stays under their share of what the capped ones leave
    level = level.withColumn("open", F.col("cap") / F.col("weight") > F.col("level"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "s_null", "s_key")
    first_open = level.withColumn("place", F.row_number().over(by_cap)).withColumn("first", F.min(F.when(F.col("open"), F.col("place"))).over(everything))
    final = first_open.withColumn("final", F.max(F.when(F.col("place") == F.col("first"), F.col("level"))).over(everything))
    target = F.when(F.col("first").isNull() | (F.col("place") < F.col("first")), F.col("cap")).otherwise(F.least(F.col("weight") * F.col("final"), F.col("cap")))
    return final.select("s_null", "s_key", "source_size", target.alias("target"))


def mix(docs: DataFrame, keep: list[str], text: str = "text", source: str = "source", identity: str = "doc_id", weights: DataFrame | None = None, unlabelled: float = 0.75, seed: int = 0, ranges: int = RANGES, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The columns ``keep`` with size, source_size, target, epochs (times the document is taken) and taken (words).

    ``weights`` has a ``__weight`` for each ``__key``, an identity; others weigh
    ``unlabelled``, and a weight that is no number or not above 0 counts as 1.  Null and
    empty texts have size 0 and take nothing; a null source is a source of its own,
    the last; rows of one identity, source and size are taken together.  Reruns
    agree.  ``weights`` holds each key once.  A source's border, the last document
    that its prefix sum takes, decides all its documents: of the texts only those of
    rows with a weight are shuffled, to learn it.  An empty table has no rows.
    """
    rows = docs.select(
        F.struct(*keep).alias("row"),
        F.col(source).isNull().alias("s_null"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s_key"),
        F.coalesce(F.col(identity).cast("string"), F.lit("")).alias("identity"),
        document_size(F.col(text)).alias("size"),
    )
    unit = ["s_null", "s_key", "identity", "size"]
    given = None if weights is None else stored(weights.where(F.col("__key").isNotNull()).select(F.col("__key").cast("string").alias("identity"), "__weight"), "weights")

    def with_key(frame: DataFrame) -> DataFrame:
        """frame, with ``__weight``, with the exponential key and its range."""
        keyed = frame.withColumn("key", exponential_key(F.col("identity"), _given_weight(unlabelled), seed))
        return keyed.withColumn("range", key_range(F.col("key"), rates, ranges)).drop("__weight")

    bounds = [1.0]
    if given is not None:
        weight = _given_weight(unlabelled)
        bounds = [w for w in given.agg(F.min(weight), F.max(weight)).first() if w is not None and math.isfinite(w)] + [unlabelled if unlabelled > 0 else 1.0]
    rates = _rates(min(bounds), max(bounds))
    units = rows.groupBy(*unit).agg(F.count("*").alias("copies"))
    units = units.withColumn("__weight", F.lit(1.0)) if given is None else units.join(given, "identity", "left")
    units = with_key(units).withColumn("words", F.col("size") * F.col("copies"))
    units = stored(units.select(*unit, "key", "range", "words"), "units")
    by_range = units.groupBy("s_null", "s_key", "range").agg(F.sum("words").alias("range_size"))
    by_source = by_range.groupBy("s_null", "s_key").agg(F.sum("range_size").alias("source_size"))
    earlier = Window.partitionBy("s_null", "s_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.withColumn("start", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
    plan = starts.join(source_targets(by_source, max_epochs), ["s_null", "s_key"]).select("s_null", "s_key", "range", "start", "source_size", "target")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # in the order of the keys the prefix sums only grow, so one border a source decides all its documents; it lies in
    # the last range that starts below the rest
    own = Window.partitionBy("s_null", "s_key").orderBy("key", "identity", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = plan.where(F.col("start") <= F.col("rest")).groupBy("s_null", "s_key").agg(F.max("range").alias("range"))
    bordering = units.join(plan.join(last, ["s_null", "s_key", "range"]), ["s_null", "s_key", "range"])
    summed = bordering.withColumn("before", F.col("start") + F.coalesce(F.sum("words").over(own), F.lit(0)))
    fits = (2 * F.col("before") + F.col("words") <= 2 * F.col("rest")) & (F.col("rest") > 0)
    border = summed.where(fits).groupBy("s_null", "s_key").agg(F.max(F.struct("key", "identity", "size")).alias("border"))
    sources = plan.groupBy("s_null", "s_key").agg(*[F.max(c).alias(c) for c in ("source_size", "target", "whole")]).join(last.withColumnRenamed("range", "border_range"), ["s_null", "s_key"], "left")
    sources = stored(sources.join(border, ["s_null", "s_key"], "left"), "borders")
    drop(units)
    if given is None:
        weighted = rows.withColumn("__weight", F.lit(1.0))
    else:  # only texts of rows that may have a weight are shuffled
        maybe, never = parted(given, "identity", rows, F.col("identity"))
        weighted = maybe.join(given.hint("merge"), "identity", "left").unionByName(never.withColumn("__weight", F.lit(None).cast("double")))
    out = with_key(weighted).join(sources, ["s_null", "s_key"])
    under = (F.col("range") < F.col("border_range")) | ((F.col("range") == F.col("border_range")) & (F.struct("key", "identity", "size") <= F.col("border")))
    epochs = F.col("whole") + F.coalesce(under, F.lit(False)).cast("long")
    return out.select("row.*", "size", "source_size", "target", epochs.alias("epochs"), (F.col("size") * epochs).alias("taken"))


def label_weight(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(__key, __weight): 1 for rows labelled good, 0.25 for others, the larger of several."""
    return labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(F.when(F.col(label) == 1, 1.0).when(F.col(label) == 0, 0.25)).alias("__weight"))
