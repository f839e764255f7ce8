"""Operators that depend on the order of time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeolith.functions import solar


def roll_to_local(facts: DataFrame, datasets: str | list[str], timezones: DataFrame, steps_per_hour: int = 1) -> DataFrame:
    """Values rolled by each site's offset from UTC: they wrap at the ends, times stay.

    facts need ``t_idx``, from 0 without gaps at each site.  All datasets move in
    one join on site and place.
    """
    names = [datasets] if isinstance(datasets, str) else list(datasets)
    size = facts.groupBy("gid").agg((F.max("t_idx") + 1).alias("__n"))
    sites = timezones.select("gid", (F.col("timezone") * steps_per_hour).cast("int").alias("__shift")).join(size, "gid")
    moved = facts.select("gid", "t_idx", *names).join(sites, "gid")
    moved = moved.select("gid", F.pmod(F.col("t_idx") + F.col("__shift"), F.col("__n")).alias("t_idx"), *names)
    return facts.drop(*names).join(moved, ["gid", "t_idx"]).select(*facts.columns)


def interpolate_in_time(facts: DataFrame, dataset: str, order: Column | None = None) -> DataFrame:
    """Nulls between values on a line by position, then the nearest value at the ends."""
    at = F.col("ts") if order is None else order
    rows = facts.withColumn("__pos", F.row_number().over(Window.partitionBy("gid").orderBy(at)))
    before = Window.partitionBy("gid").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    # from the end: a frame that grows is read once, one that shrinks again for each row
    after = Window.partitionBy("gid").orderBy(F.desc("__pos")).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when(F.col(dataset).isNotNull(), F.col("__pos"))
    rows = rows.withColumns({"__v0": F.last(dataset, True).over(before), "__p0": F.last(seen, True).over(before), "__v1": F.last(dataset, True).over(after), "__p1": F.last(seen, True).over(after)})
    line = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * (F.col("__pos") - F.col("__p0")) / F.nullif(F.col("__p1") - F.col("__p0"), F.lit(0))
    return rows.withColumn(dataset, F.coalesce(F.col(dataset), line, "__v0", "__v1")).drop("__pos", "__v0", "__p0", "__v1", "__p1")


def fill_cloud_property(facts: DataFrame, dataset: str, cloud_type: str = "cloud_type", clear: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Negative and missing values are unknown, 0 under a clear sky; unknown ones are interpolated in time."""
    value = F.when(F.col(cloud_type).isin(list(clear)), 0.0).when(F.col(dataset) < 0, None).otherwise(F.nanvl(F.col(dataset).cast("double"), F.lit(None)))
    return interpolate_in_time(facts.withColumn(dataset, value), dataset)


def time_index(spark, year: int, step: str = "1 hour") -> DataFrame:
    """All times of a year at a step, without zone (UTC)."""
    bounds = f"TIMESTAMP_NTZ '{year}-01-01 00:00:00', TIMESTAMP_NTZ '{year + 1}-01-01 00:00:00' - INTERVAL {step}, INTERVAL {step}"
    return spark.range(1).select(F.explode(F.expr(f"sequence({bounds})")).alias("ts"))


def time_indices(years: DataFrame, step: str = "1 hour") -> DataFrame:
    """(year, ts): all times of each of the years at a step."""
    start = [F.make_timestamp_ntz(F.col("year") + n, *[F.lit(v) for v in (1, 1, 0, 0, 0.0)]) for n in (0, 1)]
    return years.select("year", F.explode(F.sequence(start[0], start[1] - F.expr(f"INTERVAL {step}"), F.expr(f"INTERVAL {step}"))).alias("ts"))


def upsampled(facts: DataFrame, step: str, linear: Sequence[str] = (), held: Sequence[str] = ()) -> DataFrame:
    """(gid, ts, datasets) at each step of a site's own period, from its first whole step to its last value.

    ``linear`` datasets lie on a line by elapsed time between the values before and
    after, ``held`` ones have the last value; the first value counts before it.  Null
    and NaN are no values.  Each site is sorted once, with its new times among its rows.
    """
    micros = "CAST(unix_micros(CAST(ts AS timestamp)) AS double)"
    width = f"INTERVAL {step}"
    spans = facts.groupBy("gid").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).where("lo IS NOT NULL")
    # steps count from midnight of the site's first day
    grid = spans.select("gid", F.explode(F.expr(f"sequence(CAST(date_trunc('day', lo) AS timestamp_ntz), CAST(hi AS timestamp_ntz), {width})")).alias("ts"), "lo").where(F.expr(f"ts > lo - {width}")).drop("lo")
    names = [*linear, *held]
    values = {n: F.nanvl(F.col(n).cast("double"), F.lit(None)) if n in linear else F.col(n) for n in names}
    rows = facts.select("gid", F.col("ts").cast("timestamp_ntz").alias("ts"), *[v.alias(n) for n, v in values.items()], F.lit(False).alias("__new"))
    kinds = dict(rows.dtypes)
    new = grid.select("gid", "ts", *[F.lit(None).cast(kinds[n]).alias(n) for n in names], F.lit(True).alias("__new"))
    both = rows.unionByName(new).withColumn("__at", F.expr(micros))
    # of one time the rows with values come first, seen from either side
    before = Window.partitionBy("gid").orderBy("ts", "__new").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("gid").orderBy(F.desc("ts"), "__new").rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for n in names:
        seen = F.when(F.col(n).isNotNull(), F.struct(F.col("__at").alias("at"), F.col(n).alias("v")))
        a, b = F.last(seen, True).over(before), F.last(seen, True).over(after)
        if n in held:
            out[n] = F.coalesce(a["v"], b["v"])
        else:
            line = a["v"] + (b["v"] - a["v"]) * (F.col("__at") - a["at"]) / F.nullif(b["at"] - a["at"], F.lit(0.0))
            out[n] = F.coalesce(line, a["v"], b["v"])
    return both.withColumns(out).where("__new").select("gid", "ts", *names)


def downscaled(facts: DataFrame, meta: DataFrame, step: str, linear: Sequence[str], cloud: Sequence[str] = (), cloud_type: str = "cloud_type") -> DataFrame:
    """Facts at a finer step, with the sun's zenith at the new times.

    Cloud properties are filled first, the cloud type holds until the next one; what
    clouds do to irradiance between the times is not modelled.
    """
    for c in cloud:
        facts = fill_cloud_property(facts, c, cloud_type)
    finer = upsampled(facts, step, [*linear, *cloud], [cloud_type] if cloud_type in facts.columns else [])
    sun = finer.join(meta.select("gid", "latitude", "longitude"), "gid")
    return sun.withColumn("solar_zenith_angle", solar.zenith(F.col("ts"), F.col("latitude"), F.col("longitude"))).drop("latitude", "longitude")


def thinned(facts: DataFrame, seconds: int) -> DataFrame:
    """Times on a grid of so many seconds from the first; a grid finer than the data is an error."""
    times = facts.select("ts").distinct().withColumn("__gap", F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(Window.orderBy("ts")).cast("timestamp")))
    start, gap = times.agg(F.min("ts"), F.min("__gap")).first()
    if gap is not None and seconds * 1_000_000 < gap:
        raise ValueError("the resolution is finer than that of the data")
    elapsed = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(start).cast("timestamp"))
    return facts.where(elapsed % (seconds * 1_000_000) == 0)


def repeated_times(facts: DataFrame) -> DataFrame:
    """Times that a site has more than once."""
    return facts.groupBy("gid", "ts").count().where("count > 1").select("gid", "ts", "count")
