"""Joint probability densities of two datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(start: float, stop: float, step: float) -> list[float]:
    """Bin edges from start, one step past the last that is below stop + step."""
    n, out = 0, []
    while start + n * step < stop + step:
        out.append(start + n * step)
        n += 1
    return out


def _bin(x: Column, start: float, stop: float, step: float) -> Column:
    """The left edge of a value's bin: half open, the last closed; null outside."""
    e = edges(start, stop, step)
    last = len(e) - 2
    number = F.least(F.floor((x - start) / step), F.when(x == e[-1], F.lit(last)).otherwise(F.floor((x - start) / step)))
    return F.when((x >= e[0]) & (x <= e[-1]), F.lit(float(start)) + number * F.lit(float(step)))


def joint_density(facts: DataFrame, first: Column, first_bins: tuple[float, float, float], second: Column, second_bins: tuple[float, float, float], dense: bool = False) -> DataFrame:
    """gid, bin_1, bin_2 (left edges) and density: counts over counts in range and the area of a bin.

    Sparse by default; ``dense`` adds bins without values, one row for each site and bin.
    """
    rows = facts.select("gid", _bin(first, *first_bins).alias("bin_1"), _bin(second, *second_bins).alias("bin_2")).dropna()
    counts = rows.groupBy("gid", "bin_1", "bin_2").agg(F.count("*").alias("n"))
    totals = counts.groupBy("gid").agg(F.sum("n").alias("total"))
    out = counts.join(totals, "gid").select("gid", "bin_1", "bin_2", (F.col("n") / (F.col("total") * F.lit(float(first_bins[2] * second_bins[2])))).alias("density"))
    if not dense:
        return out
    left = F.array(*[F.lit(float(x)) for x in edges(*first_bins)[:-1]])
    right = F.array(*[F.lit(float(x)) for x in edges(*second_bins)[:-1]])
    grid = facts.select("gid").distinct().select("gid", F.explode(left).alias("bin_1")).select("gid", "bin_1", F.explode(right).alias("bin_2"))
    return grid.join(out, ["gid", "bin_1", "bin_2"], "left").withColumn("density", F.coalesce("density", F.lit(0.0)))


def wind_rose(facts: DataFrame, speed: Column, direction: Column, speed_bins: tuple = (0, 30, 1), direction_bins: tuple = (0, 360, 5), dense: bool = False) -> DataFrame:
    return joint_density(facts, speed, speed_bins, direction, direction_bins, dense)


def mean_density(density: DataFrame, sites: DataFrame) -> DataFrame:
    """The mean over all sites; bins a site has no values in count as 0."""
    n = sites.agg(F.count_distinct("gid").alias("n"))
    return density.groupBy("bin_1", "bin_2").agg(F.sum("density").alias("d")).select("bin_1", "bin_2", (F.col("d") / n.scalar()).alias("density"))
