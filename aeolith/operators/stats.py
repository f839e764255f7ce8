"""Statistics over time for each site."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeolith.functions.quantiles import knots
from aeolith.functions.scaling import clean
from aeolith.sources.scan import in_year

_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
Aggregate = Callable[[Column], Column]

STATISTICS: dict[str, Aggregate] = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
_GROUPINGS = {"full": [()], "monthly": [("month",)], "diurnal": [("hour",)], "monthly_diurnal": [("month", "hour")], "all": [(), ("month",), ("hour",), ("month", "hour")]}
#: Statistics that those of a site's months and hours are merged into, from (count, sum, squared spread, least, largest).
MERGED = ("mean", "min", "max", "sum", "count", "std", "stdev")


def register(name: str, aggregate: Aggregate) -> None:
    """A statistic of the caller's: an aggregate of a column, with keyword arguments if it takes any; also of_values()."""
    STATISTICS[name] = aggregate


def mode(x: Column) -> Column:
    """The most frequent value, the smallest of equals."""
    return F.mode(x, True)


def percentiles(x: Column, q: Sequence[float] = (0.25, 0.5, 0.75)) -> Column:
    """Exact values at some shares, as a list."""
    return F.percentile(x, F.array(*[F.lit(float(v)) for v in q]))


register("mode", mode)
register("percentiles", percentiles)


def of_values(function: Callable, returns: str = "double") -> Aggregate:
    """A statistic from a function of the numpy array of a group's values, without null and NaN, and its keyword arguments.

    The values of a group meet in one task: a site's series at most.
    """

    several = returns.startswith("array")

    def aggregate(x: Column, **arguments) -> Column:
        def of(groups: pd.Series) -> pd.Series:
            found = [function(v, **arguments) if len(v) else None for v in groups]
            return pd.Series([[float(y) for y in v] if several and v is not None else v for v in found], dtype=object if several else None)

        return F.pandas_udf(of, returns)(F.collect_list(F.nanvl(x, F.lit(None))))

    return aggregate


Statistic = str | dict


def _named(statistics: Sequence[str] | dict[str, Statistic]) -> dict[str, tuple[str | Aggregate, dict]]:
    """name: (registered name or aggregate, its arguments), from names or from name: {"func": ..., "kwargs": {...}}."""
    if not isinstance(statistics, dict):
        statistics = {s: {"func": s} for s in ([statistics] if isinstance(statistics, str) else statistics)}
    out = {}
    for name, given in statistics.items():
        given = given if isinstance(given, dict) else {"func": given}
        if "func" not in given or not isinstance(given.get("kwargs", {}), dict):
            raise ValueError(f'{name}: a statistic is {{"func": ..., "kwargs": {{...}}}}')
        func = given["func"]
        if isinstance(func, str) and func not in STATISTICS and func not in MERGED:
            raise KeyError(f"unknown statistic: {func}")
        out[name] = func, given.get("kwargs", {})
    return out


def _spread(whole: bool, ddof: str) -> Aggregate:
    if ddof not in ("reference", "sample", "population"):
        raise KeyError(f"unknown ddof: {ddof}")
    return F.stddev_samp if ddof == "sample" or whole and ddof == "reference" else F.stddev_pop


def _grouped(rows: DataFrame, grouping: Sequence[str], out: dict[str, Column]) -> DataFrame:
    # no cell is negative: always null
    none = F.when(F.max("cell") < 0, 0) if "cell" in rows.columns else F.lit(None).cast("int")
    table = rows.groupBy("gid", *grouping).agg(none.alias("__none"), *[c.alias(f"__{n}") for n, c in out.items()])
    return table.select("gid", *[F.col(c) if c in grouping else F.col("__none").alias(c) for c in ("month", "hour")], *[F.col(f"__{n}").alias(n) for n in out])


def _from_cells(rows: DataFrame, groupings: list[tuple], named: dict, ddof: str) -> DataFrame:
    """Months and hours of a site are aggregated once, before the shuffle; all other groups are merged from these few rows."""
    x = F.col("x")
    cells = rows.groupBy("gid", "month", "hour").agg(F.count(x).alias("n"), F.sum(x).alias("s"), (F.var_pop(x) * F.count(x)).alias("q"), F.min(x).alias("low"), F.max(x).alias("high"))
    n, s = F.sum("n"), F.sum("s")
    between = F.sum(F.try_divide(F.col("s") * F.col("s"), F.col("n"))) - F.try_divide(s * s, n)
    squares = F.greatest(F.lit(0.0), F.sum("q") + F.greatest(F.lit(0.0), between))
    parts = []
    for grouping in groupings:
        whole = not grouping
        less = 1 if _spread(whole, ddof) is F.stddev_samp else 0
        merged = {"mean": F.try_divide(s, n), "sum": s, "count": n, "min": F.min("low"), "max": F.max("high"), "std": F.when(n > less, F.sqrt(squares / (n - less)))}
        merged["stdev"] = merged["std"]
        parts.append(_grouped(cells, grouping, {name: merged[func] for name, (func, _) in named.items()}))
    return reduce(DataFrame.unionByName, parts)


def stats(facts: DataFrame, dataset: str, statistics: Sequence[str] | dict[str, Statistic] = ("mean", "median", "std"), period: str = "all", mask_zeros: bool = False, gid: str = "gid", ts: str = "ts", ddof: str = "reference") -> DataFrame:
    """gid, month and hour (null where all are taken together) and the statistics.

    A statistic is a registered name, or under a name of its own {"func": name or
    aggregate, "kwargs": {...}}; it may give a list.  If all can be merged, months and
    hours of sites are aggregated before the only shuffle of rows.  Others, medians for
    one, need the values of a site together: rows are shuffled once, by site, and all
    groups are made from that.  NaN and null are passed over, zeros too with
    ``mask_zeros``.  ``std`` (and ``stdev``) is that of a sample over the whole period
    and of a population in groups, or as ``ddof`` says: sample, population.
    """
    if period not in _GROUPINGS:
        raise KeyError(f"unknown period: {period}")
    named = _named(statistics)
    value = clean(F.col(dataset).cast("double"))
    if mask_zeros:
        value = F.nullif(value, F.lit(0.0))
    rows = facts.select(F.col(gid).alias("gid"), F.month(ts).alias("month"), F.hour(ts).alias("hour"), value.alias("x"))
    groupings = _GROUPINGS[period]
    if len(groupings) > 1 and all(isinstance(f, str) and f in MERGED and not k for f, k in named.values()):
        return _from_cells(rows, groupings, named, ddof)
    if len(groupings) > 1:
        # all groups read the same columns of the same exchange, which then runs once
        rows = rows.select(F.col("gid").alias("site"), (F.col("month") * 100 + F.col("hour")).alias("cell"), "x").repartition("site")
        rows = rows.select(F.col("site").alias("gid"), F.expr("cell DIV 100").cast("int").alias("month"), (F.col("cell") % 100).alias("hour"), "x", "cell")
    parts = []
    for grouping in groupings:
        own = {**STATISTICS, **dict.fromkeys(("std", "stdev"), _spread(not grouping, ddof))}
        parts.append(_grouped(rows, grouping, {name: (own[f] if isinstance(f, str) else f)(F.col("x"), **k) for name, (f, k) in named.items()}))
    return reduce(DataFrame.unionByName, parts)


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(x * w) / F.sum(w)


def weighted_std(x: Column, w: Column) -> Column:
    """The spread around the weighted mean, of a population."""
    mean = weighted_mean(x, w)
    return F.sqrt(F.greatest(F.lit(0.0), weighted_mean(x * x, w) - mean * mean))


Weighted = Callable[[Column, Column], Column]
WEIGHTED: dict[str, Weighted] = {"mean": weighted_mean, "std": weighted_std, "sum": lambda x, w: F.sum(x * w)}


def register_weighted(name: str, aggregate: Weighted) -> None:
    """A weighted statistic of the caller's: an aggregate of a column and its weight, also a grouped pandas UDF of two."""
    WEIGHTED[name] = aggregate


def weighted_stats(facts: DataFrame, dataset: str, weights: Sequence[str], statistics: Sequence[str | Weighted] = ("mean",), period: str = "all", gid: str = "gid", ts: str = "ts") -> DataFrame:
    """As stats(), with the product of some datasets as weight; a row without value or weight does not count.

    A statistic is a name of ``WEIGHTED`` or a function of value and weight, named as the function is.
    """
    if period not in _GROUPINGS:
        raise KeyError(f"unknown period: {period}")
    weight = F.lit(1.0)
    for w in weights:
        weight = weight * clean(F.col(w).cast("double"))
    rows = facts.select(F.col(gid).alias("gid"), F.month(ts).alias("month"), F.hour(ts).alias("hour"), clean(F.col(dataset).cast("double")).alias("x"), weight.alias("w"))
    rows = rows.where("x IS NOT NULL AND w IS NOT NULL")
    named = {s if isinstance(s, str) else s.__name__: s for s in statistics}
    unknown = [n for n, s in named.items() if isinstance(s, str) and s not in WEIGHTED]
    if unknown:
        raise KeyError(f"unknown statistic: {unknown[0]}")
    out = [(WEIGHTED[s] if isinstance(s, str) else s)(F.col("x"), F.col("w")).alias(n) for n, s in named.items()]
    sets = [[F.col("gid"), *[F.col(c) for c in g]] for g in _GROUPINGS[period]]
    return rows.groupingSets(sets, *[F.col(c) for c in ("gid", "month", "hour")]).agg(*out)


def label(month: Column, hour: Column, statistic: str) -> Column:
    """The name of a column of the wide form: mean, Jan_mean, 00:00UTC_mean, Jan-00:00UTC_mean."""
    m = F.when(month.isNotNull(), F.get(F.array(*[F.lit(x) for x in _MONTHS]), month - 1))
    h = F.when(hour.isNotNull(), F.format_string("%02d:00UTC", hour))
    return F.concat_ws("_", F.nullif(F.concat_ws("-", m, h), F.lit("")), F.lit(statistic))


def widened(grouped: DataFrame, statistics: Sequence[str]) -> DataFrame:
    """One row a site, one column for each group and statistic; at most 325 groups."""
    pairs = F.array(*[F.struct(label(F.col("month"), F.col("hour"), s).alias("name"), F.col(s).cast("double").alias("value")) for s in statistics])
    long = grouped.select("gid", F.explode(pairs).alias("p")).select("gid", "p.name", "p.value")
    return long.groupBy("gid").pivot("name").agg(F.first("value"))


def with_meta(grouped: DataFrame, meta: DataFrame, columns: Sequence[str] = ("latitude", "longitude")) -> DataFrame:
    """Sites of the statistics with columns of their metadata."""
    return grouped.join(meta.select("gid", *columns), "gid")


def circular_mean(facts: DataFrame, dataset: str, weights: Sequence[str] = (), exponential: bool = True, keys: Sequence[str] = ("gid",)) -> DataFrame:
    """Mean direction in degrees; several weights multiply, and enter as their exponential unless told otherwise."""
    value = clean(F.col(dataset).cast("double"))
    weight = F.lit(1.0)
    for w in weights:
        weight = weight * clean(F.col(w).cast("double"))
    if weights and exponential:
        weight = F.exp(weight)
    weight = F.when(value.isNull(), None).otherwise(weight)
    rad = F.radians(value)
    sums = facts.groupBy(*keys).agg(F.sum(weight * F.sin(rad)).alias("s"), F.sum(weight * F.cos(rad)).alias("c"), F.sum(weight).alias("w"))
    angle = F.degrees(F.atan2(F.col("s") / F.col("w"), F.col("c") / F.col("w")))
    return sums.select(*keys, F.when(angle < 0, angle + 360).otherwise(angle).alias("circular_mean"))


def cdf(facts: DataFrame, dataset: str, n: int = 50, sampling: str = "linear", base: float = 10, decimals: int | None = None, keys: Sequence[str] = ("gid",)) -> DataFrame:
    """Values at a grid of quantiles, exact, as an array."""
    return facts.groupBy(*keys).agg(knots(F.col(dataset), n, sampling, base, decimals).alias("cdf"))


def daily(facts: DataFrame, dataset: str) -> DataFrame:
    """Maximum, minimum, mean and sum of each site and day."""
    x = clean(F.col(dataset).cast("double"))
    return facts.groupBy("gid", F.to_date("ts").alias("day")).agg(F.max(x).alias("max"), F.min(x).alias("min"), F.avg(x).alias("mean"), F.sum(x).alias("sum"))


def means_map(facts: DataFrame, meta: DataFrame, dataset: str, year: int | None = None) -> DataFrame:
    """Mean of each site over all years or one, with its coordinates."""
    rows = facts if year is None else facts.where(in_year(year))
    return with_meta(rows.groupBy("gid").agg(F.avg(clean(F.col(dataset).cast("double"))).alias("mean")), meta)
