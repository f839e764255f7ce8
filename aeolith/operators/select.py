"""Sites, regions, boxes, times and index requests."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeolith.errors import ResourceValueError


def index_condition(column: Column, item: int | slice | Sequence[int] | Sequence[bool], length: int | None = None) -> Column:
    """A whole number, a slice (end excluded), a list or a mask on an axis, as a condition."""
    if isinstance(item, slice):
        start, step = item.start or 0, item.step or 1
        if (start < 0 or (item.stop or 0) < 0) and length is None:
            raise IndexError("negative bounds need the length of the axis")
        start = start + length if start < 0 else start
        out = column >= start
        if item.stop is not None:
            out = out & (column < (item.stop + length if item.stop < 0 else item.stop))
        return out & ((column - start) % step == 0) if step != 1 else out
    if isinstance(item, int) and not isinstance(item, bool):
        return column == (item + length if item < 0 and length is not None else item)
    values = list(item)
    if values and all(isinstance(x, bool) for x in values):
        values = [i for i, x in enumerate(values) if x]
    return column.isin(values)


def requested(facts: DataFrame, **lists: Sequence) -> DataFrame:
    """Rows in the order of a request, with its places in ``pos``; several lists are read side by side.

    The request is as long as the caller's own lists, and joined by broadcast.
    """
    sizes = {len(v) for v in lists.values()}
    if len(sizes) > 1:
        raise IndexError("lists of a request differ in length")
    rows = [(i, *r) for i, r in enumerate(zip(*lists.values(), strict=True))]
    kinds = dict(facts.dtypes)
    schema = ", ".join(["pos long", *[f"`{k}` {kinds[k]}" for k in lists]])
    return facts.join(F.broadcast(facts.sparkSession.createDataFrame(rows, schema)), list(lists))


def timestep(facts: DataFrame, at: str | datetime) -> DataFrame:
    """The rows of one time, given in UTC; no such time is an error."""
    out = facts.where(F.col("ts") == F.lit(at).cast(dict(facts.dtypes)["ts"]))
    if not out.limit(1).count():
        raise IndexError(f"{at} is no time of the table")
    return out


def with_time_index(facts: DataFrame) -> DataFrame:
    """Adds ``t_idx``, the number of each distinct time; the time axis is a dimension of its own, small beside the facts."""
    times = facts.select("ts").distinct().withColumn("t_idx", F.row_number().over(Window.orderBy("ts")) - 1)
    return facts.join(times, "ts")


def time_stride(facts: DataFrame, step: int) -> DataFrame:
    """Every step-th distinct time."""
    return with_time_index(facts).where(F.col("t_idx") % step == 0)


def in_region(meta: DataFrame, value: str, column: str = "state") -> DataFrame:
    return meta.where(F.col(column) == value)


def in_box(meta: DataFrame, corner: tuple[float, float], other: tuple[float, float]) -> DataFrame:
    """Sites between two corners (latitude, longitude) in any order, borders included."""
    (a, c), (b, d) = sorted((corner[0], other[0])), sorted((corner[1], other[1]))
    return meta.where(F.col("latitude").between(a, c) & F.col("longitude").between(b, d))


def at_sites(facts: DataFrame, sites: DataFrame) -> DataFrame:
    """Facts of the given sites."""
    return facts.join(sites.select("gid"), "gid", "left_semi")


def wide(facts: DataFrame, dataset: str, gids: Sequence[int]) -> DataFrame:
    """One row a time, one column a site."""
    return facts.where(F.col("gid").isin(list(gids))).groupBy("ts").pivot("gid", list(gids)).agg(F.first(dataset))


def timestep_map(facts: DataFrame, meta: DataFrame, dataset: str, at: str | datetime, region: tuple[str, str] | None = None, box: tuple | None = None) -> DataFrame:
    """longitude, latitude and value of each site at one time, in a region or a box but not both."""
    if region and box:
        raise ValueError("give a region or a box")
    sites = in_region(meta, region[0], region[1]) if region else in_box(meta, *box) if box else meta
    rows = facts.where(F.col("ts") == F.lit(at).cast(dict(facts.dtypes)["ts"]))
    return rows.join(sites, "gid").select("longitude", "latitude", F.col(dataset).alias("value"))


def distinct_values(meta: DataFrame, column: str) -> DataFrame | None:
    """None where there is no such column."""
    return meta.select(column).distinct() if column in meta.columns else None


def check_bounds(meta: DataFrame, points: Sequence[tuple[float, float]]) -> None:
    """Points outside the extent of the sites are an error."""
    b = meta.agg(F.min("latitude"), F.max("latitude"), F.min("longitude"), F.max("longitude")).first()
    for lat, lon in points:
        if not (b[0] <= lat <= b[1] and b[2] <= lon <= b[3]):
            raise ResourceValueError(f"({lat}, {lon}) is outside {tuple(b)}")


def grid_place(gid: Column, width: int) -> tuple[Column, Column]:
    """Row and column of a site of a grid."""
    return F.floor(gid / width).cast("long"), F.pmod(gid, F.lit(width))


def expand_spatial(values: DataFrame, times: DataFrame) -> DataFrame:
    """Values that only depend on the site, at all times (repeated along the missing axis).

    The time axis is the small side: it holds each time once, and is broadcast
    only while Spark's size estimate allows it.  Sites are dealt to all tasks first, as
    few of them make many rows.
    """
    dealt = values.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.join(times.select("ts").distinct())


def spectrum(facts: DataFrame, dataset: str, frequencies: Sequence[float], directions: Sequence[float]) -> DataFrame:
    """Nested arrays (frequency, direction) of each site and time as rows: gid, ts, frequency, direction and the value."""
    f, d = (F.array(*[F.lit(float(x)) for x in axis]) for axis in (frequencies, directions))
    rows = facts.select("gid", "ts", F.posexplode(dataset).alias("i", "row")).select("gid", "ts", "i", F.posexplode("row").alias("j", dataset))
    return rows.select("gid", "ts", F.get(f, F.col("i")).alias("frequency"), F.get(d, F.col("j")).alias("direction"), dataset)
