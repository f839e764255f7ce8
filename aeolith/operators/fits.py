"""Maximum-likelihood fits of distributions for each group, from aggregated sums.

No task holds the values of a group.  Where the likelihood needs sums that depend on the
parameter (Weibull), each Newton round is one aggregation of value counts; where it
needs two means (gamma, exponential), these are aggregated once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeolith.functions.quantiles import bound
from aeolith.functions.scaling import clean
from aeolith.session import shared_path

#: A shape is found when no group's changes by more than this share; at most so many rounds.
TOLERANCE, ROUNDS = 1e-9, 60


def value_counts(facts: DataFrame, dataset: str, keys: Sequence[str]) -> DataFrame:
    """(keys, x, n): how often each positive value occurs; counts of parts add up to those of the whole."""
    x = clean(F.col(dataset).cast("double"))
    return facts.select(*keys, x.alias("x")).where("x > 0 AND x < double('infinity')").groupBy(*keys, "x").agg(F.count("*").alias("n"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fit_weibull(facts: DataFrame, dataset: str, keys: Sequence[str] = ("gid",)) -> DataFrame:
    """(keys, n, fit): fit is [shape, 0, scale] of a Weibull distribution from 0 that makes the values most likely.

    Values that are null, NaN, infinite or not above 0 do not count; a group without two
    different values has a null fit.  Starts from the moments; a round reads the value
    counts, and sums x**k, x**k ln x and x**k (ln x)**2 under the group's shape k.
    """
    keys = list(keys)
    w, log, n = F.col("n"), F.log("x"), F.sum("n")
    counts = _written(value_counts(facts, dataset, keys), "value-counts")
    mean, square = F.sum(w * F.col("x")) / n, F.sum(w * F.col("x") * F.col("x")) / n
    start = F.pow(F.sqrt(F.greatest(F.lit(1e-12), square / (mean * mean) - 1)), -1.086)
    # powers of x over the largest value stay finite
    groups = counts.groupBy(*keys).agg(n.alias("total"), (F.sum(w * log) / n).alias("log_mean"), F.max("x").alias("top"), F.min("x").alias("least"), start.alias("k"))
    groups = _written(groups.withColumn("k", F.when(F.col("top") > F.col("least"), F.greatest(F.lit(0.02), F.least(F.lit(100.0), "k")))), "fit")
    names = [f"__{c}" for c in keys]
    given = counts.select(*[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)], "x", "n")
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(keys, names, strict=True)]
    for _ in range(ROUNDS):
        joined = given.join(groups, same).where("k IS NOT NULL")
        power = w * F.exp(F.col("k") * F.log(F.col("x") / F.col("top")))
        sums = joined.groupBy(*keys).agg(F.sum(power).alias("a"), F.sum(power * log).alias("b"), F.sum(power * log * log).alias("c"))
        sums = sums.select(*[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)], "a", "b", "c")
        ratio = F.col("b") / F.col("a")
        value = ratio - 1 / F.col("k") - F.col("log_mean")
        slope = F.col("c") / F.col("a") - ratio * ratio + 1 / (F.col("k") * F.col("k"))
        new = F.greatest(F.col("k") / 3, F.least(F.col("k") * 3, F.col("k") - value / slope))
        after = groups.join(sums, same, "left").withColumns({"old": F.col("k"), "k": F.when(F.col("a").isNotNull(), new)})
        groups = _written(after.drop(*names, "b", "c"), "fit")
        # the sum is that of the shape before, which by then is the same
        if not groups.where(F.abs(F.col("k") - F.col("old")) > TOLERANCE * F.col("k")).limit(1).count():
            break
        groups = groups.drop("a", "old")
    scale = F.col("top") * F.pow(F.col("a") / F.col("total"), 1 / F.col("k"))
    fit = F.when(F.col("k").isNotNull(), F.array(F.col("k"), F.lit(0.0), scale))
    return groups.select(*keys, F.col("total").alias("n"), fit.alias("fit"))


def digamma(a: Column) -> Column:
    """By the recurrence up to a + 8 and the asymptotic series there."""
    z = a + 8
    series = F.log(z) - 1 / (2 * z) - 1 / (12 * z * z) + 1 / (120 * F.pow(z, 4)) - 1 / (252 * F.pow(z, 6)) + 1 / (240 * F.pow(z, 8))
    return series - sum((1 / (a + i) for i in range(1, 8)), 1 / a)


def trigamma(a: Column) -> Column:
    z = a + 8
    series = 1 / z + 1 / (2 * z * z) + 1 / (6 * F.pow(z, 3)) - 1 / (30 * F.pow(z, 5)) + 1 / (42 * F.pow(z, 7))
    return series + sum((1 / ((a + i) * (a + i)) for i in range(1, 8)), 1 / (a * a))


def fit_gamma(facts: DataFrame, dataset: str, keys: Sequence[str] = ("gid",), rounds: int = 8) -> DataFrame:
    """(keys, n, fit): fit is [shape, 0, scale] of a gamma distribution from 0; groups and values count as for Weibull.

    The mean and the mean logarithm are all it needs: one aggregation, then Newton rounds in
    the row, from a start that is within 1.5 % already.
    """
    keys = list(keys)
    n, x = F.sum("n"), F.col("x")
    means = value_counts(facts, dataset, keys).groupBy(*keys).agg(n.alias("total"), (F.sum(F.col("n") * x) / n).alias("mean"), (F.sum(F.col("n") * F.log(x)) / n).alias("log_mean"), F.max(x).alias("top"), F.min(x).alias("least"))
    s = F.log("mean") - F.col("log_mean")
    shape = bound((3 - s + F.sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s), lambda a: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), a, _gamma_step))
    fitted = means.withColumn("k", F.when(F.col("top") > F.col("least"), shape))
    return fitted.select(*keys, F.col("total").alias("n"), F.when(F.col("k").isNotNull(), F.array(F.col("k"), F.lit(0.0), F.col("mean") / F.col("k"))).alias("fit"))


def _gamma_step(a: Column, _: Column) -> Column:
    s = F.log("mean") - F.col("log_mean")
    return a - (F.log(a) - digamma(a) - s) / (1 / a - trigamma(a))


def fit_exponential(facts: DataFrame, dataset: str, keys: Sequence[str] = ("gid",)) -> DataFrame:
    """(keys, n, fit): fit is [least, mean - least]; values that are null or NaN do not count, those of any sign do."""
    x = clean(F.col(dataset).cast("double"))
    return facts.groupBy(*keys).agg(F.count(x).alias("n"), F.when(F.count(x) > 0, F.array(F.min(x), F.avg(x) - F.min(x))).alias("fit"))


FITS: dict[str, Callable[..., DataFrame]] = {"weibull_min": fit_weibull, "gamma": fit_gamma, "expon": fit_exponential}


def fit(facts: DataFrame, dataset: str, distribution: str, period: str = "full", gid: str = "gid", ts: str = "ts") -> DataFrame:
    """gid, month, hour (null where all are taken together), n and the parameters ``fit`` of a distribution, by period as in stats()."""
    if distribution not in FITS:
        raise KeyError(f"unknown distribution: {distribution}")
    named = {"full": [], "monthly": ["month"], "diurnal": ["hour"], "monthly_diurnal": ["month", "hour"]}
    if period not in named:
        raise KeyError(f"unknown period: {period}")
    rows = facts.select(F.col(gid).alias("gid"), F.month(ts).alias("month"), F.hour(ts).alias("hour"), F.col(dataset).alias("x"))
    out = FITS[distribution](rows, "x", ["gid", *named[period]])
    return out.select("gid", *[F.col(c) if c in named[period] else F.lit(None).cast("int").alias(c) for c in ("month", "hour")], "n", "fit")
