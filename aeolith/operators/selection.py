"""Exact order statistics of a whole table, by counts alone."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that a range is cut into in each round; the driver gets one count for each.
PARTS = 1024


def median_above(x: Column, limit: float) -> Column:
    """An aggregate: whether the exact median exceeds a limit; null without values.

    More than half of the values above it decide, or fewer; at exactly half the median is
    the middle of the largest value up to the limit and the least beyond.
    """
    x = F.nanvl(x.cast("double"), F.lit(None))
    twice, n = 2 * F.count_if(x > limit), F.count(x)
    middle = (F.max(F.when(x <= limit, x)) + F.min(F.when(x > limit, x))) / 2
    return F.when(n == 0, None).when(twice == n, middle > limit).otherwise(twice > n)


def order_statistics(df: DataFrame, column: str, places: Sequence[int]) -> list[float]:
    """The values at some places (from 0) of the sorted column, exactly.

    Each round counts the values in parts of the ranges that hold a wanted place, and
    goes on inside the parts that do, until a part holds one value only.  Rows are
    aggregated where they are; no task gets more than counts.  Null and NaN do not count.
    """
    x = F.nanvl(F.col(column).cast("double"), F.lit(None))
    rows = df.select(x.alias("x")).where("x IS NOT NULL")
    n, low, high = rows.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if any(not 0 <= p < n for p in places):
        raise IndexError(f"places {list(places)} of {n} values")
    found: dict[int, float] = {}
    open_ = {(low, high): [(p, p) for p in places]} if n else {}  # range: (place in the table, place in the range)
    while open_:
        known = [r for r in open_ if r[0] == r[1]]
        for r in known:
            found.update((p, r[0]) for p, _ in open_.pop(r))
        if not open_:
            break
        ranges = list(open_)
        counted = None
        for i, (a, b) in enumerate(ranges):
            width = b / PARTS - a / PARTS
            part = F.least(F.lit(PARTS - 1), F.floor((F.col("x") - F.lit(a)) / F.lit(width))) if width > 0 else F.when(F.col("x") == F.lit(a), 0).otherwise(1)
            mine = F.when(F.col("x").between(a, b), F.struct(F.lit(i).alias("range"), part.cast("int").alias("part")))
            counted = mine if counted is None else F.coalesce(counted, mine)
        parts = rows.select(counted.alias("at"), "x").where("at IS NOT NULL").groupBy("at").agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        table = sorted((r["at"]["range"], r["at"]["part"], r.n, r.low, r.high) for r in parts.collect())  # PARTS rows for each range at most
        following: dict[tuple[float, float], list[tuple[int, int]]] = {}
        for i, r in enumerate(ranges):
            for place, inside in open_[r]:
                for _, _, m, a, b in (t for t in table if t[0] == i):
                    if inside < m:
                        following.setdefault((a, b), []).append((place, inside))
                        break
                    inside -= m
        open_ = following
    return [found[p] for p in places]


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles of the whole table, interpolated between neighbours; None without values."""
    n = df.select(F.count(F.nanvl(F.col(column).cast("double"), F.lit(None)))).first()[0]
    if not n:
        return [None] * len(shares)
    at = [q * (n - 1) for q in shares]
    places = sorted({p for x in at for p in (math.floor(x), math.ceil(x))})
    values = dict(zip(places, order_statistics(df, column, places), strict=True))
    return [values[math.floor(x)] + (values[math.ceil(x)] - values[math.floor(x)]) * (x - math.floor(x)) for x in at]
