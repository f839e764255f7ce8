"""One query for each operator family, with SQL that gives the same rows.

The driver's tables stand in for resource data: ``events`` for hourly facts,
``lineitem`` for daily facts of several years, ``supplier`` for sites,
``customer`` for target points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aeolith.functions import heights, irradiance, quantiles, scaling, solar, units
from aeolith.operators import derive, fits, jointpd, ordered, select, selection, spatial, stats
from aeolith.plans import site_model
from aeolith.session import shared_path
from aeolith.sources import layout, scan, sink
from aeolith.sources.catalog import GEOTHERMAL, SOLAR, WAVE, WIND, Catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None, recursive: bool = False):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = (_WITH.replace("WITH", "WITH RECURSIVE", 1) if recursive else _WITH) + sql
        return f

    return add


_WITH = """
WITH facts AS (SELECT user_id AS gid, ts, event_id, value, value AS windspeed_80m, value * 1.05 + 0.5 AS windspeed_100m,
    CAST(event_id * 37 % 360 AS DOUBLE) AS winddirection_80m, CAST(event_id * 41 % 360 AS DOUBLE) AS winddirection_100m FROM events),
daily AS (SELECT l_suppkey AS gid, l_shipdate AS ts, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem),
meta AS (SELECT s_suppkey AS gid, 25 + (s_suppkey * 7 % 240) / 10.0 AS latitude, -124 + (s_suppkey * 13 % 570) / 10.0 AS longitude, CAST(-5 - s_nationkey % 4 AS INTEGER) AS timezone,
    n_name AS state, r_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
points AS (SELECT c_custkey AS point, 25 + (c_custkey * 11 % 2400) / 100.0 AS latitude, -124 + (c_custkey * 17 % 5700) / 100.0 AS longitude FROM customer),
near AS (SELECT p.point, m.gid, sqrt((p.latitude - m.latitude) * (p.latitude - m.latitude) + (p.longitude - m.longitude) * (p.longitude - m.longitude)) AS planar,
    2 * asin(least(1.0, sqrt(power(sin((radians(m.latitude) - radians(p.latitude)) / 2), 2) + cos(radians(p.latitude)) * cos(radians(m.latitude)) * power(sin((radians(m.longitude) - radians(p.longitude)) / 2), 2)))) AS great
  FROM points p, meta m)
"""


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _filed(*parts: DataFrame) -> list[DataFrame]:
    """The tables, each written to a file of its own and read from there."""
    spark = parts[0].sparkSession
    paths = [shared_path(spark, f"part{i}") for i in range(len(parts))]
    for part, path in zip(parts, paths, strict=True):
        sink.write_profiles(part, path)
    return [scan.read_facts(spark, f"{path}/facts", raw=True) for path in paths]


def facts(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return _read(spark, d, "events").select(
        F.col("user_id").alias("gid"), "ts", "event_id", "value", v.alias("windspeed_80m"), (v * 1.05 + 0.5).alias("windspeed_100m"),
        (F.col("event_id") * 37 % 360).cast("double").alias("winddirection_80m"), (F.col("event_id") * 41 % 360).cast("double").alias("winddirection_100m"),
    )


def daily(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "lineitem").select(F.col("l_suppkey").alias("gid"), F.col("l_shipdate").alias("ts"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def meta(spark: SparkSession, d: str) -> DataFrame:
    joined = _read(spark, d, "supplier").join(_read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(_read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("s_suppkey")
    return joined.select(
        k.alias("gid"), (25 + (k * 7 % 240) / 10.0).alias("latitude"), (-124 + (k * 13 % 570) / 10.0).alias("longitude"), (-5 - F.col("s_nationkey") % 4).cast("int").alias("timezone"),
        F.col("n_name").alias("state"), F.col("r_name").alias("country"),
    )


def points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return _read(spark, d, "customer").select(k.alias("point"), (25 + (k * 11 % 2400) / 100.0).alias("latitude"), (-124 + (k * 17 % 5700) / 100.0).alias("longitude"))


def _r(x: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


# --- scans, index algebra, selection ---------------------------------------------------------------------------------


@query("SELECT gid, ts, round(CAST(CAST(round_even(value * 100, 0) AS INTEGER) AS DOUBLE) / 100, 4) AS value FROM facts")
def scan_unscale(spark, d):
    raw = facts(spark, d).select("gid", "ts", F.bround(F.col("value") * 100).cast("int").alias("value", metadata={"scale_factor": 100}))
    return scan.normalised(raw, SOLAR).select("gid", "ts", _r(F.col("value").cast("double"), 4).alias("value"))


@query("SELECT gid, ts, round(CAST(CAST(round_even(value * 10, 0) AS INTEGER) AS DOUBLE) * 0.5 + 3, 3) AS value FROM facts")
def scan_unscale_offset(spark, d):
    raw = facts(spark, d).select("gid", "ts", F.bround(F.col("value") * 10).cast("int").alias("value", metadata={"psm_scale_factor": 0.5, "psm_add_offset": 3}))
    return scan.normalised(raw, SOLAR).select("gid", "ts", _r(F.col("value").cast("double"), 3).alias("value"))


@query("SELECT ts, value FROM facts WHERE gid = 7")
def site_timeseries(spark, d):
    return facts(spark, d).where(select.index_condition(F.col("gid"), 7)).select("ts", "value")


@query("SELECT pos, gid, ts, value FROM facts JOIN (VALUES (0, 9), (1, 3), (2, 9), (3, 42)) AS r(pos, gid) USING (gid)")
def site_list_ordered(spark, d):
    return select.requested(facts(spark, d), gid=[9, 3, 9, 42]).select(F.col("pos").cast("int").alias("pos"), "gid", "ts", "value")


@query("SELECT gid, ts, value FROM facts WHERE gid >= 10 AND gid < 40 AND (gid - 10) % 3 = 0 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def index_slice(spark, d):
    rows = facts(spark, d).where(select.index_condition(F.col("gid"), slice(10, 40, 3)))
    return rows.where((F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-12").cast("timestamp_ntz"))).select("gid", "ts", "value")


@query("SELECT gid, ts, value FROM (SELECT *, dense_rank() OVER (ORDER BY ts) - 1 AS i FROM facts) WHERE i % 5 = 0")
def time_stride(spark, d):
    return select.time_stride(facts(spark, d), 5).select("gid", "ts", "value")


@query("SELECT gid, ts, value FROM facts WHERE ts = (SELECT max(ts) FROM facts)")
def timestep(spark, d):
    last = facts(spark, d).agg(F.max("ts")).first()[0]
    return select.timestep(facts(spark, d), last).select("gid", "ts", "value")


@query("SELECT gid, ts, value FROM facts WHERE gid IN (SELECT gid FROM meta WHERE state = 'CANADA' OR state LIKE 'NATION%3')")
def region_filter(spark, d):
    sites = meta(spark, d)
    chosen = select.in_region(sites, "CANADA").unionByName(sites.where(F.col("state").like("NATION%3")))
    return select.at_sites(facts(spark, d), chosen).select("gid", "ts", "value")


@query("SELECT gid, ts, value FROM facts WHERE gid IN (SELECT gid FROM meta WHERE latitude BETWEEN 28 AND 40 AND longitude BETWEEN -120 AND -80)")
def box_filter(spark, d):
    return select.at_sites(facts(spark, d), select.in_box(meta(spark, d), (40, -80), (28, -120))).select("gid", "ts", "value")


@query("SELECT longitude, latitude, l_quantity AS value FROM daily JOIN meta USING (gid) WHERE ts = TIMESTAMP '1997-06-15' AND latitude BETWEEN 25 AND 45 AND longitude BETWEEN -124 AND -70")
def timestep_map(spark, d):
    return select.timestep_map(daily(spark, d), meta(spark, d), "l_quantity", "1997-06-15", box=((25, -124), (45, -70)))


@query("SELECT DISTINCT state FROM meta")
def distinct_regions(spark, d):
    return select.distinct_values(meta(spark, d), "state")


@query("SELECT gid, CAST(floor(gid / 16) AS BIGINT) AS grid_row, gid % 16 AS grid_col FROM meta")
def grid_places(spark, d):
    row, col = select.grid_place(F.col("gid"), 16)
    return meta(spark, d).select("gid", row.alias("grid_row"), col.alias("grid_col"))


@query("SELECT ts, max(value) FILTER (gid = 3) AS g3, max(value) FILTER (gid = 9) AS g9 FROM facts WHERE gid IN (3, 9) GROUP BY ts")
def site_table_wide(spark, d):
    return select.wide(facts(spark, d), "value", [3, 9]).withColumnsRenamed({"3": "g3", "9": "g9"})


# --- statistics ------------------------------------------------------------------------------------------------------

_STATS_SQL = """SELECT gid, month, hour, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std FROM (
  SELECT gid, month, hour, avg(x) AS mean, median(x) AS median, CASE WHEN month IS NULL AND hour IS NULL THEN stddev_samp(x) ELSE stddev_pop(x) END AS std
  FROM (SELECT gid, CAST({month} AS INTEGER) AS month, CAST({hour} AS INTEGER) AS hour, {x} AS x FROM {table}) GROUP BY GROUPING SETS ({sets}))"""


def _stats(table, dataset: str, period: str, **options) -> Query:
    def run(spark, d):
        out = stats.stats(table(spark, d), dataset, period=period, **options)
        return out.select("gid", "month", "hour", _r("mean").alias("mean"), _r("median").alias("median"), _r("std").alias("std"))

    return run


for _period, (_table, _name, _dataset, _month, _hour) in {
    "full": (facts, "facts", "value", "NULL", "NULL"),
    "monthly": (daily, "daily", "l_quantity", "month(ts)", "NULL"),
    "diurnal": (facts, "facts", "value", "NULL", "hour(ts)"),
    "monthly_diurnal": (facts, "facts", "value", "month(ts)", "hour(ts)"),
}.items():
    query(_STATS_SQL.format(x=_dataset, table=_name, sets="(gid, month, hour)", month=_month, hour=_hour), f"{_period}_stats")(_stats(_table, _dataset, _period))
_ALL = "(gid), (gid, month), (gid, hour), (gid, month, hour)"
query(_STATS_SQL.format(x="value", table="facts", sets=_ALL, month="month(ts)", hour="hour(ts)"), "all_stats")(_stats(facts, "value", "all"))
query(_STATS_SQL.format(x="nullif(l_discount, 0)", table="daily", sets=_ALL, month="month(ts)", hour="hour(ts)"), "masked_zero_stats")(_stats(daily, "l_discount", "all", mask_zeros=True))


@query(""", m AS (SELECT gid, v FROM (SELECT gid, l_quantity AS v, row_number() OVER (PARTITION BY gid ORDER BY count(*) DESC, l_quantity) AS k FROM daily GROUP BY gid, l_quantity) WHERE k = 1)
SELECT gid, min(l_quantity) AS min, max(l_quantity) AS max, max(v) AS mode FROM daily JOIN m USING (gid) GROUP BY gid""")
def custom_min_mode(spark, d):
    return stats.stats(daily(spark, d), "l_quantity", ["min", "max", "mode"], "full").select("gid", "min", "max", "mode")


_WEIBULL_SQL = """, v AS (SELECT gid, CAST(month(ts) AS INTEGER) AS month, l_quantity AS x FROM daily WHERE l_quantity > 0),
g AS (SELECT gid, month, count(*) AS n, avg(ln(x)) AS m, max(x) AS top, greatest(0.02, least(100.0, power(sqrt(greatest(1e-12, avg(x * x) / (avg(x) * avg(x)) - 1)), -1.086))) AS k0 FROM v GROUP BY ALL HAVING min(x) < max(x)),
c AS (SELECT gid, month, [x, cast(count(*) as double)] AS p FROM v GROUP BY gid, month, x), a AS (SELECT gid, month, list(p) AS p FROM c GROUP BY ALL),
r AS (SELECT gid, month, 0 AS i, k0 AS k FROM g), s AS (SELECT g.*, p FROM g JOIN a USING (gid, month)){rounds}
SELECT gid, month, n, CAST(unnest([0, 1, 2]) AS INTEGER) AS place, round(unnest([k, 0.0, top * power(list_sum(list_transform(p, lambda y: y[2] * power(y[1] / top, k))) / n, 1 / k)]), 5) AS weibull FROM s JOIN r{last} USING (gid, month)"""
_NEWTON = """, t{i} AS (SELECT gid, month, k, m, list_sum(list_transform(p, lambda y: y[2] * power(y[1] / top, k))) AS a, list_sum(list_transform(p, lambda y: y[2] * power(y[1] / top, k) * ln(y[1]))) AS b, list_sum(list_transform(p, lambda y: y[2] * power(y[1] / top, k) * ln(y[1]) * ln(y[1]))) AS c FROM s JOIN r{before} USING (gid, month)),
r{i} AS (SELECT gid, month, greatest(k / 3, least(k * 3, k - (b / a - 1 / k - m) / (c / a - (b / a) * (b / a) + 1 / (k * k)))) AS k FROM t{i})"""


@query(_WEIBULL_SQL.format(rounds="".join(_NEWTON.format(i=i, before=i - 1 or "") for i in range(1, 9)), last=8))
def weibull_fit(spark, d):
    """Shape, place and scale by site and month, as the places of a list."""
    out = fits.fit(daily(spark, d), "l_quantity", "weibull_min", "monthly").where("fit IS NOT NULL")
    return out.select("gid", "month", "n", F.posexplode("fit").alias("place", "weibull")).withColumn("weibull", _r("weibull", 5))


_DIGAMMA = "(ln({a} + 8) - 1 / (2 * ({a} + 8)) - 1 / (12 * power({a} + 8, 2)) + 1 / (120 * power({a} + 8, 4)) - 1 / (252 * power({a} + 8, 6)) + 1 / (240 * power({a} + 8, 8)) - " + " - ".join(f"1 / ({{a}} + {i})" for i in range(8)) + ")"


@query(f""", g AS (SELECT gid, count(*) AS n, avg(value) AS mean, ln(avg(value)) - avg(ln(value)) AS s FROM facts WHERE value > 0 GROUP BY gid HAVING min(value) < max(value)),
r AS (SELECT gid, n, mean, s, 1e-6 AS low, 1e6 AS high, 0 AS i FROM g UNION ALL SELECT gid, n, mean, s, CASE WHEN ln(sqrt(low * high)) - {_DIGAMMA.format(a='sqrt(low * high)')} > s THEN sqrt(low * high) ELSE low END, CASE WHEN ln(sqrt(low * high)) - {_DIGAMMA.format(a='sqrt(low * high)')} > s THEN high ELSE sqrt(low * high) END, i + 1 FROM r WHERE i < 56)
SELECT gid, n, round(sqrt(low * high), 5) AS shape, round(mean / sqrt(low * high), 4) AS scale FROM r WHERE i = 56""", recursive=True)
def gamma_fit(spark, d):
    out = fits.fit(facts(spark, d), "value", "gamma").where("fit IS NOT NULL")
    return out.select("gid", "n", _r(F.get("fit", F.lit(0)), 5).alias("shape"), _r(F.get("fit", F.lit(2)), 4).alias("scale"))


@query("""SELECT gid, CAST(month(ts) AS INTEGER) AS month, round(quantile_cont(l_quantity, 0.1), 6) AS p10, round(quantile_cont(l_quantity, 0.9), 6) AS p90, max(l_quantity) - min(l_quantity) AS span, list_reverse_sort(list(l_quantity))[2] AS second FROM daily GROUP BY ALL""")
def custom_arguments(spark, d):
    """A list from arguments, a function of a group's values, and one of its two largest."""
    wanted = {
        "p": {"func": "percentiles", "kwargs": {"q": [0.1, 0.9]}},
        "span": {"func": stats.of_values(lambda x: float(x.max() - x.min()))},
        "second": {"func": lambda x, place: F.get(F.sort_array(F.collect_list(x), asc=False), F.lit(place)), "kwargs": {"place": 1}},
    }
    out = stats.stats(daily(spark, d), "l_quantity", wanted, "monthly")
    return out.select("gid", "month", *[_r(F.get("p", F.lit(i)), 6).alias(n) for i, n in enumerate(("p10", "p90"))], "span", "second")


_SHARES = (0.05, 0.5, 0.95)


@query(f"SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS place, round(unnest(quantile_cont(value, {list(_SHARES)})), 6) AS value FROM facts")
def selection_quantiles(spark, d):
    """Exact quantiles of the whole selection, by counts in narrowing ranges."""
    found = selection.quantiles(facts(spark, d), "value", _SHARES)
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(v).cast("double") for v in found])).alias("place", "value")).withColumn("value", _r("value"))


@query("SELECT gid, month, hour, round(mean, 9) AS mean, round(std, 6) AS std, low, high, n FROM (SELECT gid, month, hour, avg(x) AS mean, CASE WHEN month IS NULL AND hour IS NULL THEN stddev_samp(x) ELSE stddev_pop(x) END AS std, min(x) AS low, max(x) AS high, count(x) AS n FROM (SELECT gid, CAST(month(ts) AS INTEGER) AS month, CAST(hour(ts) AS INTEGER) AS hour, value AS x FROM facts) GROUP BY GROUPING SETS ((gid), (gid, month), (gid, hour), (gid, month, hour)))")
def merged_stats(spark, d):
    out = stats.stats(facts(spark, d), "value", {"mean": "mean", "std": "std", "low": "min", "high": "max", "n": "count"}, "all")
    return out.select("gid", "month", "hour", _r("mean", 9).alias("mean"), _r("std").alias("std"), "low", "high", "n")


@query("SELECT gid, latitude, longitude, round(avg(value), 6) AS mean FROM facts JOIN meta USING (gid) GROUP BY ALL")
def stats_with_meta(spark, d):
    return stats.with_meta(stats.stats(facts(spark, d), "value", ["mean"], "full"), meta(spark, d)).select("gid", "latitude", "longitude", _r("mean").alias("mean"))


@query("""SELECT gid, round(avg(l_quantity) FILTER (month(ts) = 1), 6) AS "Jan_mean", round(avg(l_quantity) FILTER (month(ts) = 7), 6) AS "Jul_mean", round(avg(l_quantity) FILTER (month(ts) = 12), 6) AS "Dec_mean" FROM daily GROUP BY gid""")
def monthly_wide(spark, d):
    out = stats.widened(stats.stats(daily(spark, d), "l_quantity", ["mean"], "monthly"), ["mean"])
    return out.select("gid", *[_r(c).alias(c) for c in ("Jan_mean", "Jul_mean", "Dec_mean")])


_CIRCLE = "round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 6) AS circular_mean"


@query(f"SELECT gid, {_CIRCLE} FROM (SELECT gid, degrees(atan2(avg(sin(radians(winddirection_80m))), avg(cos(radians(winddirection_80m))))) AS a FROM facts GROUP BY gid)")
def circular_mean(spark, d):
    return stats.circular_mean(facts(spark, d), "winddirection_80m").select("gid", _r("circular_mean").alias("circular_mean"))


@query(f"SELECT gid, {_CIRCLE} FROM (SELECT gid, degrees(atan2(sum(w * sin(radians(x))) / sum(w), sum(w * cos(radians(x))) / sum(w))) AS a FROM (SELECT gid, winddirection_80m AS x, exp(value / 100.0) AS w FROM facts) GROUP BY gid)")
def weighted_circular_mean(spark, d):
    return stats.circular_mean(facts(spark, d).withColumn("w", F.col("value") / 100.0), "winddirection_80m", ["w"]).select("gid", _r("circular_mean").alias("circular_mean"))


def _cdf(sampling: str) -> None:
    grid = quantiles.grid(11, sampling)

    def run(spark, d):
        out = stats.cdf(facts(spark, d), "value", 11, sampling)
        return out.select("gid", F.posexplode("cdf").alias("knot", "value")).select("gid", "knot", _r("value").alias("value"))

    query(f"SELECT gid, CAST(unnest(range(0, 11)) AS INTEGER) AS knot, round(unnest(quantile_cont(value, {grid})), 6) AS value FROM facts GROUP BY gid", f"cdf_{sampling}")(run)


for _kind in ("linear", "log", "invlog"):
    _cdf(_kind)


_JPD_SQL = """, b AS (SELECT gid, least(floor(({x} - {x0}) / {xs}), {xn}) * {xs} + {x0} AS bin_1, least(floor(({y} - {y0}) / {ys}), {yn}) * {ys} + {y0} AS bin_2 FROM facts WHERE {x} BETWEEN {x0} AND {x1} AND {y} BETWEEN {y0} AND {y1}),
c AS (SELECT gid, bin_1, bin_2, count(*) AS n FROM b GROUP BY ALL)
SELECT {keys} CAST(bin_1 AS DOUBLE) AS bin_1, CAST(bin_2 AS DOUBLE) AS bin_2, round({value}, 9) AS density FROM (SELECT *, n / (sum(n) OVER (PARTITION BY gid) * {xs} * {ys}) AS d FROM c) {tail}"""
_ROSE = {"x": "windspeed_80m", "x0": "0.0", "x1": "300.0", "xs": "10.0", "xn": "29", "y": "winddirection_80m", "y0": "0.0", "y1": "360.0", "ys": "30.0", "yn": "11"}


@query(_JPD_SQL.format(**{**_ROSE, "y": "windspeed_100m", "y1": "320.0", "ys": "20.0", "yn": "15"}, keys="gid,", value="d", tail=""))
def joint_pd(spark, d):
    out = jointpd.joint_density(facts(spark, d), F.col("windspeed_80m"), (0, 300, 10), F.col("windspeed_100m"), (0, 320, 20))
    return out.select("gid", "bin_1", "bin_2", _r("density", 9).alias("density"))


@query(_JPD_SQL.format(**_ROSE, keys="gid,", value="d", tail=""))
def wind_rose(spark, d):
    out = jointpd.wind_rose(facts(spark, d), F.col("windspeed_80m"), F.col("winddirection_80m"), (0, 300, 10), (0, 360, 30))
    return out.select("gid", "bin_1", "bin_2", _r("density", 9).alias("density"))


@query(_JPD_SQL.format(**_ROSE, keys="", value="sum(d) / (SELECT count(DISTINCT gid) FROM facts)", tail="GROUP BY bin_1, bin_2"))
def mean_joint_pd(spark, d):
    rose = jointpd.wind_rose(facts(spark, d), F.col("windspeed_80m"), F.col("winddirection_80m"), (0, 300, 10), (0, 360, 30))
    return jointpd.mean_density(rose, facts(spark, d)).select("bin_1", "bin_2", _r("density", 9).alias("density"))


@query("SELECT gid, CAST(ts AS DATE) AS day, round(max(value), 6) AS max, round(min(value), 6) AS min, round(avg(value), 6) AS mean, round(sum(value), 5) AS sum FROM facts GROUP BY gid, CAST(ts AS DATE)")
def daily_agg(spark, d):
    return stats.daily(facts(spark, d), "value").select("gid", "day", *[_r(c).alias(c) for c in ("max", "min", "mean")], _r("sum", 5).alias("sum"))


@query("SELECT gid, latitude, longitude, round(avg(l_quantity), 6) AS mean FROM daily JOIN meta USING (gid) WHERE year(ts) = 1997 GROUP BY ALL")
def means_map(spark, d):
    return stats.means_map(daily(spark, d), meta(spark, d), "l_quantity", 1997).select("gid", "latitude", "longitude", _r("mean").alias("mean"))


@query("SELECT gid, latitude, longitude, round(avg(l_quantity), 6) AS mean FROM daily JOIN meta USING (gid) GROUP BY ALL")
def multi_year_means(spark, d):
    return stats.means_map(daily(spark, d), meta(spark, d), "l_quantity").select("gid", "latitude", "longitude", _r("mean").alias("mean"))


@query("SELECT gid, CAST(year(ts) AS INTEGER) AS year, count(*) AS n FROM daily WHERE year(ts) IN (1996, 1998) GROUP BY 1, 2")
def year_filter(spark, d):
    return scan.in_years(daily(spark, d), ["1996", 1998]).groupBy("gid", F.year("ts").alias("year")).agg(F.count("*").alias("n"))


@query("SELECT gid, round(avg(value) / 1000 * 24, 9) AS irradiation FROM facts GROUP BY gid")
def daily_irradiation(spark, d):
    return facts(spark, d).groupBy("gid").agg(_r(irradiance.daily_irradiation(F.avg("value")), 9).alias("irradiation"))


# --- heights ---------------------------------------------------------------------------------------------------------


@query("SELECT gid, ts, round((windspeed_100m - windspeed_80m) / 20.0 * 90 + (windspeed_100m - (windspeed_100m - windspeed_80m) / 20.0 * 100), 6) AS windspeed_90m FROM facts")
def linear_height(spark, d):
    return derive.with_dataset(facts(spark, d), "windspeed_90m", WIND).select("gid", "ts", _r("windspeed_90m").alias("windspeed_90m"))


@query(", a AS (SELECT ln(avg(windspeed_100m) / avg(windspeed_80m)) / ln(100.0 / 80.0) AS alpha FROM facts) SELECT gid, ts, round(windspeed_80m * power(120.0 / 80.0, alpha), 5) AS windspeed_120m FROM facts, a")
def power_law_shear(spark, d):
    return derive.with_dataset(facts(spark, d), "windspeed_120m", WIND).select("gid", "ts", _r("windspeed_120m", 5).alias("windspeed_120m"))


@query(""", z AS (SELECT gid, ts, CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE windspeed_80m END AS a, CASE WHEN event_id % 13 = 0 THEN 0.0 ELSE windspeed_100m END AS b FROM facts)
SELECT gid, ts, round(CASE WHEN a = 0 THEN 0.001 ELSE a END * power(120.0 / 80.0, greatest(0.06, least(0.6, ln((CASE WHEN b = 0 THEN 0.001 ELSE b END) / CASE WHEN a = 0 THEN 0.001 ELSE a END) / ln(100.0 / 80.0)))), 5) AS windspeed_120m FROM z""")
def power_law_clipped(spark, d):
    """Exponents by row within bounds; zeros at either height count as 0.001."""
    e = F.col("event_id")
    rows = facts(spark, d).withColumns({"windspeed_80m": F.when(e % 11 == 0, 0.0).otherwise(F.col("windspeed_80m")), "windspeed_100m": F.when(e % 13 == 0, 0.0).otherwise(F.col("windspeed_100m"))})
    return derive.with_dataset(rows, "windspeed_120m", WIND, per="row").select("gid", "ts", _r("windspeed_120m", 5).alias("windspeed_120m"))


_TURN = "((2 * (((winddirection_100m - winddirection_80m) % 360 + 360) % 360)) % 360 - (((winddirection_100m - winddirection_80m) % 360 + 360) % 360))"


@query(f"SELECT gid, ts, round(((winddirection_100m + {_TURN} * 0.5) % 360 + 360) % 360, 6) AS winddirection_90m FROM facts")
def circular_height(spark, d):
    return derive.with_dataset(facts(spark, d), "winddirection_90m", WIND).select("gid", "ts", _r("winddirection_90m").alias("winddirection_90m"))


@query("SELECT gid, ts, round(value + (2.0 - 80.0) / 1000 * 6.56, 6) AS temperature_80m, round(value * 100 + (100.0 - 80.0) / 1000 * 11109.0, 4) AS pressure_80m FROM facts")
def lapse_rate(spark, d):
    rows = facts(spark, d).select("gid", "ts", F.col("value").alias("temperature_2m"), (F.col("value") * 100).alias("pressure_100m"))
    c = Catalog.of(rows, WIND)
    return rows.select("gid", "ts", _r(c.column("temperature_80m")).alias("temperature_80m"), _r(c.column("pressure_80m"), 4).alias("pressure_80m"))


_PSI = """CASE WHEN {z} < 0 THEN ((pi() / 2 - 2 * atan({x}) + ln(power(1 + {x}, 2) * (1 + power({x}, 2)) / 8)) + power({z}, 2) * (1.5 * ln(power({y}, 2) + {y} + 1.0 / 3) - sqrt(3) * atan(2 * {y} + 1 / sqrt(3)) + pi() / sqrt(3))) / (1 + power({z}, 2))
 ELSE -6.1 * ln({p} + power(1 + power({p}, 2.5), 0.4)) END"""


def _psi_sql(z: str) -> str:
    n = f"least({z}, 0.0)"
    return _PSI.format(z=z, x=f"power(1 - 16 * {n}, 0.25)", y=f"power(1 - 10 * {n}, 1.0 / 3)", p=f"greatest({z}, 0.0)")


def _profile_sql(h: str) -> str:
    return f"(ln({h} / z0) - ({_psi_sql(f'({h} * l)')}) + ({_psi_sql('(z0 * l)')}))"


@query(f"SELECT gid, ts, round(v * {_profile_sql('40.0')} / {_profile_sql('80.0')}, 5) AS windspeed_40m FROM (SELECT gid, ts, windspeed_80m AS v, 0.05 + (event_id % 7) / 100.0 AS z0, (event_id % 21 - 10) / 1000.0 AS l FROM facts)")
def monin_obukhov(spark, d):
    rows = facts(spark, d).withColumns({"roughness_length": 0.05 + (F.col("event_id") % 7) / 100.0, "inversemoninobukhovlength_2m": (F.col("event_id") % 21 - 10) / 1000.0})
    return derive.with_dataset(rows, "windspeed_40m", WIND).select("gid", "ts", _r("windspeed_40m", 5).alias("windspeed_40m"))


@query(f"SELECT gid, ts, round(v * {_profile_sql('40.0')} / {_profile_sql('80.0')}, 5) AS windspeed_40m FROM (SELECT gid, ts, windspeed_80m AS v, 0.05 + (gid % 7) / 100.0 AS z0, (event_id % 21 - 10) / 1000.0 AS l FROM facts)")
def monin_obukhov_meta(spark, d):
    """Roughness from the table of sites."""
    rows = facts(spark, d).withColumn("inversemoninobukhovlength_2m", (F.col("event_id") % 21 - 10) / 1000.0)
    sites = rows.select("gid").distinct().withColumn("z0", 0.05 + (F.col("gid") % 7) / 100.0)
    return derive.with_dataset(rows, "windspeed_40m", WIND, meta=sites).select("gid", "ts", _r("windspeed_40m", 5).alias("windspeed_40m"))


@query("SELECT gid, ts, round(CASE WHEN gid % 2 = 0 THEN (windspeed_100m + windspeed_80m) / 2 ELSE windspeed_100m END, 5) AS hub FROM facts")
def site_heights(spark, d):
    rows = facts(spark, d)
    hubs = rows.select("gid").distinct().withColumn("height", F.when(F.col("gid") % 2 == 0, 90).otherwise(100))
    return derive.at_site_heights(rows, "windspeed", hubs, WIND, "hub").select("gid", "ts", _r("hub", 5).alias("hub"))


# --- sun and irradiance ----------------------------------------------------------------------------------------------

_SUN = """, s0 AS (SELECT gid, ts, latitude, longitude, epoch(ts) / 86400.0 + 2440587.5 - 2451545 AS n, hour(ts) + minute(ts) / 60.0 AS zulu FROM facts JOIN meta USING (gid)),
s1 AS (SELECT *, radians(((280.460 + 0.9856474 * n) % 360 + 360) % 360 + 1.915 * sin(radians((357.528 + 0.9856003 * n) % 360)) + 0.02 * sin(2 * radians((357.528 + 0.9856003 * n) % 360))) AS ec, radians(23.439 - 0.0000004 * n) AS ob FROM s0),
s2 AS (SELECT *, asin(sin(ob) * sin(ec)) AS de, radians((((6.697375 + 0.06570982441908 * n + 1.00273790935 * zulu) * 15 + longitude) % 360 + 360) % 360) - atan2(cos(ob) * sin(ec), cos(ec)) AS h0 FROM s1),
s3 AS (SELECT *, CASE WHEN h0 < -pi() THEN h0 + 2 * pi() WHEN h0 > pi() THEN h0 - 2 * pi() ELSE h0 END AS ha, radians(latitude) AS la FROM s2),
s4 AS (SELECT *, asin(greatest(-1, least(1, sin(de) * sin(la) + cos(de) * cos(la) * cos(ha)))) AS el FROM s3),
s5 AS (SELECT *, degrees(el) AS e FROM s4)
"""
_ZENITH = "90 - least(90, e + CASE WHEN e < -0.56 THEN 0.56 ELSE 3.51561 * (0.1594 + 0.0196 * e + 0.00002 * e * e) / (1 + 0.505 * e + 0.0845 * e * e) END)"


@query(_SUN + f"SELECT gid, ts, round({_ZENITH}, 4) AS zenith, round(e, 4) AS elevation FROM s5")
def solar_zenith(spark, d):
    rows = facts(spark, d).join(meta(spark, d), "gid")
    at = (F.col("ts"), F.col("latitude"), F.col("longitude"))
    return rows.select("gid", "ts", _r(solar.zenith(*at), 4).alias("zenith"), _r(solar.elevation(*at), 4).alias("elevation"))


@query(_SUN + "SELECT gid, ts, round(degrees(acos(greatest(-1, least(1, (sin(el) * sin(la) - sin(de)) / (cos(el) * cos(la)))))), 3) AS azimuth FROM s5")
def solar_azimuth(spark, d):
    rows = facts(spark, d).join(meta(spark, d), "gid")
    return rows.select("gid", "ts", _r(solar.azimuth(F.col("ts"), F.col("latitude"), F.col("longitude")), 3).alias("azimuth"))


@query(_SUN + f"SELECT gid, ts, round(greatest(0, 500.0 * cos(radians({_ZENITH})) + 80), 3) AS ghi FROM s5")
def fill_irradiance(spark, d):
    rows = facts(spark, d).join(meta(spark, d), "gid")
    z = solar.zenith(F.col("ts"), F.col("latitude"), F.col("longitude"))
    return rows.select("gid", "ts", _r(irradiance.fill_missing(None, F.lit(500.0), F.lit(80.0), z)["ghi"], 3).alias("ghi"))


_IRR = "SELECT gid, ts, value * 4 AS ghi, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE value * 3 END AS dni, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE value END AS dhi FROM facts"


def _irradiance(spark, d):
    v, e = F.col("value"), F.col("event_id")
    return facts(spark, d).select("gid", "ts", (v * 4).alias("ghi"), F.when(e % 5 == 0, 0.0).otherwise(v * 3).alias("dni"), F.when(e % 7 == 0, 0.0).otherwise(v).alias("dhi"))


def _factors(spark, d):
    gid = F.col("gid")
    return meta(spark, d).where(gid % 3 != 0).select("gid", (0.9 + gid % 5 / 10.0).alias("scalar"), (gid % 4 - 2.0).alias("adder"))


_FACTORS = "f AS (SELECT gid, 0.9 + gid % 5 / 10.0 AS scalar, gid % 4 - 2.0 AS adder FROM meta WHERE gid % 3 <> 0)"


@query(f""", {_FACTORS}, i AS ({_IRR}), j AS (SELECT i.*, scalar, adder, CASE WHEN ghi = 0 THEN 0 ELSE greatest(0, ghi * scalar + adder) END AS g, CASE WHEN dni = 0 THEN 0 ELSE greatest(0, dni * scalar + adder) END AS n FROM i LEFT JOIN f USING (gid))
SELECT gid, ts, round(CASE WHEN scalar IS NULL THEN ghi ELSE g END, 4) AS ghi, round(CASE WHEN scalar IS NULL THEN dni ELSE n END, 4) AS dni,
  round(CASE WHEN scalar IS NULL THEN dhi WHEN dhi = 0 THEN 0 WHEN dni = 0 THEN g ELSE greatest(0, g - n * (ghi - dhi) / dni) END, 4) AS dhi FROM j""")
def irradiance_bias(spark, d):
    out = derive.linear_irradiance_bias(_irradiance(spark, d), _factors(spark, d))
    return out.select("gid", "ts", *[_r(c, 4).alias(c) for c in ("ghi", "dni", "dhi")])


@query(f", {_FACTORS} SELECT gid, ts, round(CASE WHEN scalar IS NULL THEN windspeed_80m ELSE greatest(0, windspeed_80m * scalar + adder) END, 5) AS windspeed_80m FROM facts LEFT JOIN f USING (gid)")
def wind_bias(spark, d):
    return derive.linear_wind_bias(facts(spark, d), _factors(spark, d), "windspeed_80m").select("gid", "ts", _r("windspeed_80m", 5).alias("windspeed_80m"))


_KNOTS = 20
_QDM = """, k AS (SELECT gid, quantile_cont(value, {grid}) AS mf FROM facts GROUP BY gid), kk AS (SELECT gid, mf, list_transform(mf, lambda x: x * 0.9 + 1.0) AS mh, list_transform(mf, lambda x: x * 1.1) AS oh FROM k),
p AS (SELECT gid, ts, value AS x, mf, mh, oh, len(list_filter(mf, lambda z: z <= value)) AS a FROM facts JOIN kk USING (gid)),
q AS (SELECT *, CASE WHEN a <= 0 THEN 0.0 WHEN a >= 20 THEN 1.0 ELSE (a - 1) / 19.0 + (x - mf[a]) * (a / 19.0 - (a - 1) / 19.0) / (mf[a + 1] - mf[a]) END AS q FROM p),
r AS (SELECT *, least(19, CAST(floor(q * 19 + 1e-12) AS INTEGER)) AS i FROM q),
t AS (SELECT *, CASE WHEN i >= 19 THEN oh[20] ELSE oh[i + 1] + (q * 19 - i) * (oh[i + 2] - oh[i + 1]) END AS o, CASE WHEN i >= 19 THEN mh[20] ELSE mh[i + 1] + (q * 19 - i) * (mh[i + 2] - mh[i + 1]) END AS m FROM r)
SELECT gid, ts, round({out}, 3) AS corrected FROM t"""


def _qdm(relative: bool) -> Query:
    def run(spark, d):
        rows = facts(spark, d)
        k = stats.cdf(rows, "value", _KNOTS)
        table = k.select("gid", F.col("cdf").alias("params_mf"), F.transform("cdf", lambda x: x * 0.9 + 1.0).alias("params_mh"), F.transform("cdf", lambda x: x * 1.1).alias("params_oh"))
        out = derive.with_factors(rows, table, ["params_oh", "params_mh", "params_mf"])
        new = quantiles.delta_mapping(F.col("value"), F.col("__params_oh"), F.col("__params_mh"), F.col("__params_mf"), relative)
        return out.select("gid", "ts", _r(new, 3).alias("corrected"))

    return run


query(_QDM.format(grid=quantiles.grid(_KNOTS), out="o * x / m"), "qdm_relative")(_qdm(True))
query(_QDM.format(grid=quantiles.grid(_KNOTS), out="o + x - m"), "qdm_absolute")(_qdm(False))


_QDM_TAIL = _QDM[_QDM.index("q AS ") : _QDM.index("SELECT gid, ts, round({out}")].rstrip()


@query(f""", i AS ({_IRR}), l AS (SELECT gid, ts, 'g' AS v, ghi AS raw FROM i UNION ALL SELECT gid, ts, 'd' AS v, dni AS raw FROM i),
k AS (SELECT gid, v, quantile_cont(raw, {quantiles.grid(_KNOTS)}) AS mf FROM l GROUP BY gid, v), kk AS (SELECT gid, v, mf, list_transform(mf, lambda x: x * 0.9 + 1.0) AS mh, list_transform(mf, lambda x: x * 1.1) AS oh FROM k),
p AS (SELECT gid, ts, v, x, mf, mh, oh, len(list_filter(mf, lambda z: z <= x)) AS a FROM (SELECT *, CASE WHEN raw = 0 THEN 1.0 ELSE raw END AS x FROM l) JOIN kk USING (gid, v)),
{_QDM_TAIL}, n AS (SELECT gid, ts, max(CASE WHEN v = 'g' THEN o * x / m END) AS ng, max(CASE WHEN v = 'd' THEN o * x / m END) AS nd FROM t GROUP BY gid, ts),
c AS (SELECT i.*, CASE WHEN ghi = 0 THEN 0 ELSE greatest(0, ng) END AS g, CASE WHEN dni = 0 THEN 0 ELSE greatest(0, nd) END AS b FROM i JOIN n USING (gid, ts)),
h AS (SELECT gid, ts, g, b, CASE WHEN dhi = 0 THEN 0 WHEN dni = 0 THEN g ELSE greatest(0, g - b * (ghi - dhi) / dni) END AS h FROM c)
SELECT gid, ts, round(g, 3) AS ghi, round(b, 3) AS dni, round(h, 3) AS dhi, round(avg(g) OVER (PARTITION BY gid), 4) AS ghi_mean FROM h""")
def qdm_irradiance(spark, d):
    """ghi and dni by mappings of their own, dhi from the closure, means after that."""
    rows = _irradiance(spark, d)
    table = None
    for v in ("ghi", "dni"):
        k = stats.cdf(rows, v, _KNOTS).select("gid", F.col("cdf").alias(f"{v}_params_mf"), F.transform("cdf", lambda x: x * 0.9 + 1.0).alias(f"{v}_params_mh"), F.transform("cdf", lambda x: x * 1.1).alias(f"{v}_params_oh"))
        table = k if table is None else table.join(k, "gid")
    out, means = derive.bias_corrected(rows, table, "mapped_irradiance", means=["ghi"])
    return out.join(means, "gid").select("gid", "ts", *[_r(c, 3).alias(c) for c in ("ghi", "dni", "dhi")], _r("ghi_mean", 4).alias("ghi_mean"))


@query("SELECT gid, ts, l_quantity, l_tax FROM daily WHERE gid BETWEEN 20 AND 24 AND ts >= TIMESTAMP '1997-03-01' AND ts < TIMESTAMP '1997-06-01'")
def clustered_site_period(spark, d):
    """Few sites and a season from files along a curve over both."""
    path = shared_path(spark, "clustered")
    rows = layout.clustered(daily(spark, d), path, 8, megabytes=0.25)
    return rows.where(F.col("gid").between(20, 24) & layout.during("1997-03-01", "1997-06-01")).select("gid", "ts", "l_quantity", "l_tax")


@query(", n AS (SELECT point, gid FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY planar, gid) AS k FROM near WHERE point <= 50) WHERE k = 1) SELECT point, gid, ts, value FROM n JOIN facts USING (gid)")
def table_at_places(spark, d):
    """Series of the sites nearest to fifty places."""
    return spatial.table_at(facts(spark, d), meta(spark, d), "value", points(spark, d).where("point <= 50"), check=False).select("point", "gid", "ts", "value")


@query(""", s AS (SELECT median(value + 250) AS mt, median(value * 1000) AS mp FROM facts)
SELECT gid, ts, round(greatest(-200, least(100, value + 250 - CASE WHEN mt > 200 THEN 273.15 ELSE 0 END)), 5) AS temperature_80m, round(greatest(0.5, least(1.099, value * 1000 * CASE WHEN mp > 1000 THEN 9.86923e-6 ELSE 1 END)), 6) AS pressure_80m FROM facts, s""")
def unit_normalise(spark, d):
    rows = facts(spark, d).select("gid", "ts", (F.col("value") + 250).alias("temperature_80m"), (F.col("value") * 1000).alias("pressure_80m"))
    out = derive.in_model_units(rows, ["temperature_80m", "pressure_80m"], "windpower")
    return out.select("gid", "ts", _r("temperature_80m", 5).alias("temperature_80m"), _r("pressure_80m").alias("pressure_80m"))


@query("SELECT gid, ts, greatest(0, least(120, value)) AS windspeed FROM facts")
def range_clamp(spark, d):
    return facts(spark, d).select("gid", "ts", units.clamped(F.col("value"), "windspeed", "windpower").alias("windspeed"))


@query("SELECT gid, ts, round(value * (1 - hour(ts) / 48.0), 6) AS value FROM facts")
def curtail(spark, d):
    rows = facts(spark, d)
    shares = rows.select("ts").distinct().withColumn("share", 1 - F.hour("ts") / 48.0)
    return derive.curtail(rows, shares, "value").select("gid", "ts", _r("value").alias("value"))


# --- order in time ---------------------------------------------------------------------------------------------------


def _indexed(spark, d):
    return facts(spark, d).withColumn("t_idx", F.row_number().over(Window.partitionBy("gid").orderBy("ts")) - 1)


_INDEXED = ", x AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY ts) - 1 AS t_idx, count(*) OVER (PARTITION BY gid) AS n FROM facts)"


@query(_INDEXED + " SELECT a.gid, a.ts, b.value FROM x a JOIN meta USING (gid) JOIN x b ON b.gid = a.gid AND ((b.t_idx + timezone) % b.n + b.n) % b.n = a.t_idx")
def roll_local_time(spark, d):
    return ordered.roll_to_local(_indexed(spark, d), "value", meta(spark, d)).select("gid", "ts", "value")


@query(""", v AS (SELECT gid, ts, row_number() OVER (PARTITION BY gid ORDER BY ts) AS pos, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM facts),
w AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS p1 FROM v
  WINDOW b AS (PARTITION BY gid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY gid ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT gid, ts, round(coalesce(v, v0 + (v1 - v0) * (pos - p0) / nullif(p1 - p0, 0), v0, v1), 6) AS value FROM w""")
def time_interpolate(spark, d):
    rows = facts(spark, d).select("gid", "ts", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"))
    return ordered.interpolate_in_time(rows, "value").select("gid", "ts", _r("value").alias("value"))


@query("""SELECT CAST(y AS INTEGER) AS year, t.ts, coalesce(n, 0) AS n FROM (SELECT DISTINCT year(ts) AS y FROM daily) AS ys, unnest(generate_series(make_timestamp(y, 1, 1, 0, 0, 0.0), make_timestamp(y, 12, 31, 18, 0, 0.0), INTERVAL 6 HOUR)) AS t(ts)
LEFT JOIN (SELECT ts, count(*) AS n FROM daily GROUP BY ts) AS c ON c.ts = t.ts""")
def time_index(spark, d):
    """All times of the years that the data has, with the number of values at each."""
    rows = daily(spark, d)
    index = ordered.time_indices(rows.select(F.year("ts").alias("year")).distinct(), "6 hours")
    return index.join(rows.groupBy("ts").agg(F.count("*").alias("n")), "ts", "left").select("year", "ts", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT gid, t.ts, round(CASE WHEN n.ts IS NULL OR n.ts = b.ts THEN b.value WHEN b.ts IS NULL THEN n.value ELSE b.value + (n.value - b.value) * (epoch_us(t.ts) - epoch_us(b.ts)) / CAST(epoch_us(n.ts) - epoch_us(b.ts) AS DOUBLE) END, 5) AS value, coalesce(b.kind, n.kind) AS kind
FROM (SELECT gid, unnest(generate_series(date_trunc('day', lo), hi, INTERVAL 15 MINUTE)) AS ts, lo FROM (SELECT gid, min(ts) AS lo, max(ts) AS hi FROM facts GROUP BY gid)) AS t
ASOF LEFT JOIN (SELECT gid AS g, ts, value, event_id % 7 AS kind FROM facts) AS b ON t.gid = b.g AND t.ts >= b.ts ASOF LEFT JOIN (SELECT gid AS g, ts, value, event_id % 7 AS kind FROM facts) AS n ON t.gid = n.g AND t.ts <= n.ts
WHERE t.ts > lo - INTERVAL 15 MINUTE""")
def upsampled_quarters(spark, d):
    """Irregular times to quarter hours: one dataset on lines, one held."""
    rows = facts(spark, d).select("gid", "ts", "value", (F.col("event_id") % 7).alias("kind"))
    return ordered.upsampled(rows, "15 minutes", ["value"], ["kind"]).select("gid", "ts", _r("value", 5).alias("value"), "kind")


@query("SELECT gid, ts, l_quantity FROM daily WHERE date_diff('day', (SELECT min(ts) FROM daily), ts) % 3 = 0")
def temporal_thinning(spark, d):
    return ordered.thinned(daily(spark, d), 3 * 86400).select("gid", "ts", "l_quantity")


@query("SELECT gid, ts, count(*) AS count FROM daily GROUP BY gid, ts HAVING count(*) > 1")
def repeated_times(spark, d):
    return ordered.repeated_times(daily(spark, d))


# --- space -----------------------------------------------------------------------------------------------------------


@query("SELECT point, gid, round(planar, 9) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY planar, gid) AS k FROM near) WHERE k = 1")
def nearest_site(spark, d):
    return spatial.nearest(points(spark, d), meta(spark, d)).select("point", "gid", _r("distance", 9).alias("distance"))


@query("SELECT round(max(m) * 1.05 * sqrt(2) / 2, 9) AS threshold FROM (SELECT min(sqrt(power(a.latitude - b.latitude, 2) + power(a.longitude - b.longitude, 2))) AS m FROM meta a JOIN meta b ON a.gid <> b.gid GROUP BY a.gid)")
def distance_threshold(spark, d):
    return spark.range(1).select(_r(spatial.distance_threshold(meta(spark, d)), 9).alias("threshold"))


def crowd(spark: SparkSession, d: str) -> DataFrame:
    """Many sites, nine of ten of them in one small place."""
    k = F.col("o_orderkey")
    far = k % 10 == 0
    return _read(spark, d, "orders").select(
        k.alias("gid"),
        F.when(far, 25 + (k * 7 % 2400) / 100.0).otherwise(35 + (k * 7919 % 10007) / 100000.0).alias("latitude"),
        F.when(far, -124 + (k * 13 % 5700) / 100.0).otherwise(-100 + (k * 104729 % 10009) / 100000.0).alias("longitude"),
    )


_CROWD = """, crowd AS (SELECT o_orderkey AS gid, CASE WHEN o_orderkey % 10 = 0 THEN 25 + (o_orderkey * 7 % 2400) / 100.0 ELSE 35 + (o_orderkey * 7919 % 10007) / 100000.0 END AS latitude,
  CASE WHEN o_orderkey % 10 = 0 THEN -124 + (o_orderkey * 13 % 5700) / 100.0 ELSE -100 + (o_orderkey * 104729 % 10009) / 100000.0 END AS longitude FROM orders)"""


@query(_CROWD + """, a AS (SELECT p.point, c.gid, sqrt((p.latitude - c.latitude) * (p.latitude - c.latitude) + (p.longitude - c.longitude) * (p.longitude - c.longitude)) AS d FROM points p, crowd c),
r AS (SELECT point, min_by(gid, struct_pack(d := d, gid := gid)) AS gid, min(d) AS distance FROM a GROUP BY point) SELECT point, gid, round(distance, 9) AS distance FROM r""")
def nearest_of_crowd(spark, d):
    """More sites than go to a task, crowded ones."""
    return spatial.nearest(points(spark, d), crowd(spark, d)).select("point", "gid", _r("distance", 9).alias("distance"))


@query(_CROWD + """, a AS (SELECT m.gid AS point, c.gid, 2 * asin(least(1.0, sqrt(power(sin((radians(c.latitude) - radians(m.latitude)) / 2), 2) + cos(radians(m.latitude)) * cos(radians(c.latitude)) * power(sin((radians(c.longitude) - radians(m.longitude)) / 2), 2)))) AS d FROM meta m, crowd c)
SELECT point, rank, round(d, 9) AS distance FROM (SELECT *, CAST(row_number() OVER (PARTITION BY point ORDER BY d, gid) AS INTEGER) AS rank FROM a) WHERE rank <= 4""")
def four_nearest_of_crowd(spark, d):
    near = spatial.nearest(meta(spark, d).withColumnRenamed("gid", "point"), crowd(spark, d), 4, "haversine")
    return near.select("point", "rank", _r("distance", 9).alias("distance"))


_WEIGHTS = ", k AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY great, gid) AS k FROM near QUALIFY k <= 4), w AS (SELECT point, gid, CASE WHEN min(great) OVER (PARTITION BY point) < 1e-12 THEN CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END ELSE 1 / greatest(great, 1e-12) END AS w FROM k), ww AS (SELECT point AS target, gid, w / sum(w) OVER (PARTITION BY point) AS weight FROM w)"


@query(_WEIGHTS + " SELECT target, CAST(ts AS DATE) AS day, round(sum(weight * q), 4) AS value FROM ww JOIN (SELECT gid, ts, avg(l_quantity) AS q FROM daily GROUP BY gid, ts) USING (gid) GROUP BY ALL")
def regrid_idw(spark, d):
    rows = daily(spark, d).groupBy("gid", "ts").agg(F.avg("l_quantity").alias("value"))
    out = spatial.regrid_onto(rows, meta(spark, d), points(spark, d).withColumnRenamed("point", "target"), "value")
    return out.select("target", F.to_date("ts").alias("day"), _r("value", 4).alias("value"))


@query(_WEIGHTS + " SELECT target, day, round(sum(weight * q), 4) AS quantity, round(sum(weight * t), 6) AS tax FROM ww JOIN (SELECT gid, CAST(date_trunc('month', ts) AS DATE) AS day, avg(l_quantity) AS q, avg(l_tax) AS t FROM daily GROUP BY ALL) USING (gid) GROUP BY ALL")
def regrid_cached(spark, d):
    """Two datasets by one table of weights, stored by the first and read by the second."""
    rows = daily(spark, d).groupBy("gid", F.date_trunc("month", "ts").cast("date").alias("ts")).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_tax").alias("tax"))
    cache, targets = shared_path(spark, "weights"), points(spark, d).withColumnRenamed("point", "target")
    quantity, tax = (spatial.regrid_onto(rows, meta(spark, d), targets, v, cache=cache) for v in ("quantity", "tax"))
    out = quantity.join(tax, ["target", "ts"])
    return out.select("target", F.col("ts").alias("day"), _r("quantity", 4).alias("quantity"), _r("tax").alias("tax"))


@query("SELECT gid AS target, gid, 1.0 AS weight FROM meta")
def regrid_exact_match(spark, d):
    sites = meta(spark, d)
    return spatial.regrid_weights(sites, sites.withColumnRenamed("gid", "target"), own=True).where("weight > 0").select("target", "gid", "weight")


@query(""", lowres AS (SELECT gid AS low_gid, latitude, longitude FROM meta WHERE gid % 10 = 0),
pair AS (SELECT m.gid, arg_min(low_gid, struct_pack(a := sqrt(power(m.latitude - l.latitude, 2) + power(m.longitude - l.longitude, 2)), b := low_gid)) AS low_gid FROM meta m, lowres l GROUP BY m.gid),
high AS (SELECT DISTINCT gid, ts FROM daily), low AS (SELECT gid AS low_gid, ts, avg(l_quantity) AS q FROM daily WHERE gid % 10 = 0 AND day(ts) % 2 = 0 GROUP BY ALL),
v AS (SELECT gid, ts, row_number() OVER (PARTITION BY gid ORDER BY ts) AS pos, q AS v FROM high JOIN pair USING (gid) LEFT JOIN low USING (low_gid, ts)),
w AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS p1 FROM v
  WINDOW b AS (PARTITION BY gid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY gid ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT gid, ts, round(coalesce(v, v0 + (v1 - v0) * (pos - p0) / nullif(p1 - p0, 0), v0, v1), 5) AS value FROM w""")
def multi_resolution_join(spark, d):
    sites, rows = meta(spark, d), daily(spark, d)
    low = rows.where("gid % 10 = 0 AND day(ts) % 2 = 0").groupBy("gid", "ts").agg(F.avg("l_quantity").alias("value"))
    out = spatial.with_low_resolution(rows.select("gid", "ts").distinct(), sites, low, sites.where("gid % 10 = 0"), ["value"])
    return out.select("gid", "ts", _r("value", 5).alias("value"))


@query("""SELECT 7 - (gid // 12 - 2) AS "row", gid % 12 - 3 AS col, gid FROM (SELECT c_custkey - 1 AS gid FROM customer) WHERE gid // 12 BETWEEN 2 AND 9 AND gid % 12 BETWEEN 3 AND 7""")
def raster_index(spark, d):
    """Customers as a grid of twelve columns and as many rows as they fill."""
    k = F.col("c_custkey") - 1
    sites = _read(spark, d, "customer").select(k.alias("gid"), (30 + F.floor(k / 12) * 0.25).alias("latitude"), (-100 + k % 12 * 0.3).alias("longitude"))
    out = spatial.raster(sites, (30.5, -99.1), (8, 5))
    return out.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "gid")


# --- composition, site models, sinks ---------------------------------------------------------------------------------


@query("SELECT gid, ts, windspeed_80m, winddirection_80m FROM facts")
def multi_file_join(spark, d):
    f = facts(spark, d)
    return scan.by_dataset(_filed(f.select("gid", "ts", "windspeed_80m"), f.select("gid", "ts", "winddirection_80m")), check=True)


@query("SELECT gid, ts, value, CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN windspeed_100m END AS windspeed_100m FROM facts")
def multi_time_union(spark, d):
    f, cut = facts(spark, d), F.lit("2024-01-16").cast("timestamp_ntz")
    return scan.by_time(_filed(f.where(F.col("ts") < cut).select("gid", "ts", "value"), f.where(F.col("ts") >= cut).select("gid", "ts", "value", "windspeed_100m")))


@query("SELECT gid, ts, value FROM facts WHERE gid < 50 UNION ALL SELECT gid - 50 + (SELECT max(gid) + 1 FROM facts WHERE gid < 50), ts, value FROM facts WHERE gid >= 50")
def combine_sites(spark, d):
    f = facts(spark, d).select("gid", "ts", "value")
    return scan.combined_sites(_filed(f.where("gid < 50"), f.where("gid >= 50").withColumn("gid", F.col("gid") - 50)))


@query("SELECT gid, ts, value FROM facts")
def combine_time(spark, d):
    f, cut = facts(spark, d), F.lit("2024-01-16").cast("timestamp_ntz")
    return scan.combined_times(_filed(f.where(F.col("ts") < cut).select("gid", "ts", "value", "windspeed_80m"), f.where(F.col("ts") >= cut).select("gid", "ts", "value")))


@query("SELECT CAST(2000 + o_custkey % 20 AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1")
def year_from_name(spark, d):
    name = F.concat(F.lit("site_7_wind_"), (2000 + F.col("o_custkey") % 20).cast("string"), F.lit(".parquet"))
    return _read(spark, d, "orders").select(scan.year_from_file(name).alias("year")).groupBy("year").agg(F.count("*").alias("n"))


@query("""SELECT gid, ts, CAST(year(ts) AS INTEGER) AS "Year", CAST(month(ts) AS INTEGER) AS "Month", CAST(day(ts) AS INTEGER) AS "Day", CAST(hour(ts) AS INTEGER) AS "Hour", CAST(minute(ts) AS INTEGER) AS "Minute",
  round(least(1360, value * 3), 5) AS "DNI", round(least(1360, value), 5) AS "DHI", round(least(1360, value * 4), 5) AS "GHI", round(least(120, value / 20), 5) AS "Wind Speed", round(least(100, value / 10), 5) AS "Temperature" FROM facts""", "site_model_solar")
def site_model_solar(spark, d):
    v = F.col("value")
    rows = facts(spark, d).select("gid", "ts", (v * 3).alias("dni"), v.alias("dhi"), (v * 4).alias("ghi"), (v / 20).alias("windspeed"), (v / 10).alias("air_temperature"))
    out = site_model.site_table(site_model.loaded(rows, "pv", SOLAR))
    return out.select("gid", "ts", "Year", "Month", "Day", "Hour", "Minute", *[_r(F.col(f"`{c}`"), 5).alias(c) for c in ("DNI", "DHI", "GHI", "Wind Speed", "Temperature")])


@query(_INDEXED + f""", y AS (SELECT gid, t_idx, n, ts, least(120, (windspeed_100m + windspeed_80m) / 2) AS s, ((winddirection_100m + {_TURN} * 0.5) % 360 + 360) % 360 AS w, least(100, value / 10) AS t, greatest(0.5, least(1.099, value / 100)) AS p FROM x)
SELECT a.gid, a.ts, round(b.t, 5) AS "Temperature", round(b.p, 5) AS "Pressure", round(b.s, 5) AS "Speed", round(b.w, 5) AS "Direction" FROM y a JOIN meta USING (gid) JOIN y b ON b.gid = a.gid AND ((b.t_idx + timezone) % b.n + b.n) % b.n = a.t_idx""", "site_model_wind")
def site_model_wind(spark, d):
    rows = _indexed(spark, d).withColumns({"temperature": F.col("value") / 10, "pressure": F.col("value") / 100})
    table = site_model.loaded(rows, "windpower", WIND, 90)
    out = site_model.site_table(table, meta(spark, d), time_columns=False)
    return out.select("gid", "ts", *[_r(c, 5).alias(c) for c in ("Temperature", "Pressure", "Speed", "Direction")])


@query("SELECT gid, ts, round(least(20.5, value / 10), 5) AS wave_height, round(least(9.75, value / 15), 5) AS wave_period FROM facts", "site_model_wave")
def site_model_wave(spark, d):
    rows = facts(spark, d).select("gid", "ts", (F.col("value") / 10).alias("significant_wave_height"), (F.col("value") / 15).alias("energy_period"))
    return site_model.site_table(site_model.loaded(rows, "wave", WAVE), time_columns=False).select("gid", "ts", _r("wave_height", 5).alias("wave_height"), _r("wave_period", 5).alias("wave_period"))


@query("""SELECT gid, ts, round(least(1000, greatest(-200, value + 20 * depth / 100.0)), 5) AS temperature, round(least(1000000, value * depth / 100.0), 5) AS "potential_MW", CAST(depth AS DOUBLE) AS height
FROM (SELECT gid, ts, value, 500 + gid % 4 * 1000 AS depth FROM facts)""", "site_model_geothermal")
def site_model_geothermal(spark, d):
    """Depths that differ by site: between, beyond and at the stored ones."""
    v = F.col("value")
    depths = (1500, 2500)
    rows = facts(spark, d).select("gid", "ts", *[(v + 20 * h / 100).alias(f"temperature_{h}m") for h in depths], *[(v * h / 100).alias(f"potential_MW_{h}m") for h in depths])
    wanted = rows.select("gid").distinct().withColumn("height", (500 + F.col("gid") % 4 * 1000).cast("double"))
    table = site_model.loaded(rows, "geothermal", GEOTHERMAL, heights_by_site=wanted)
    return site_model.with_heights(table, wanted).select("gid", "ts", _r("temperature", 5).alias("temperature"), _r("potential_MW", 5).alias("potential_MW"), "height")


@query("SELECT gid, round(avg(least(1360, value * 4)), 5) AS ghi, round(avg(least(1360, value * 4)) / 1000 * 24, 7) AS ghi_daily FROM facts GROUP BY gid", "site_model_means")
def site_model_means(spark, d):
    v = F.col("value")
    rows = facts(spark, d).select("gid", "ts", (v * 3).alias("dni"), v.alias("dhi"), (v * 4).alias("ghi"), (v / 20).alias("windspeed"), (v / 10).alias("air_temperature"))
    return site_model.means(site_model.loaded(rows, "pv", SOLAR)).select("gid", _r("ghi", 5).alias("ghi"), _r("ghi_daily", 7).alias("ghi_daily"))


@query("SELECT gid, ts, CAST(round_even(value * 10, 0) AS SMALLINT) AS value FROM facts")
def scaled_write_roundtrip(spark, d):
    path = shared_path(spark, "scaled")
    sink.write_profiles(facts(spark, d).select("gid", "ts", "value"), path, {"value": {"dtype": "smallint", "scale_factor": 10}})
    return scan.read_facts(spark, f"{path}/facts", raw=True)


@query("SELECT gid, ts, value FROM facts WHERE gid IN (SELECT gid FROM meta WHERE latitude > 35)")
def save_subset(spark, d):
    return _filed(sink.subset(facts(spark, d), meta(spark, d).where("latitude > 35"), ["value"]))[0]


@query("SELECT gid, ts, gid + dayofyear(ts) / 10.0 + 1 AS q, CAST(round_even((gid + dayofyear(ts) / 10.0) * 10, 0) AS INTEGER) AS stored FROM meta, (SELECT DISTINCT ts FROM daily)")
def store_update(spark, d):
    sites, times = meta(spark, d), daily(spark, d).select("ts").distinct()
    path = shared_path(spark, "store")
    sink.create_store(path, sites, times, {"made_by": "store_update"})
    times = spark.read.parquet(f"{path}/time_index")
    values = select.expand_spatial(sites.select("gid"), times)  # a value for every site and time is what a store holds
    values = values.select("gid", "ts", (F.col("gid") + F.dayofyear("ts") / 10).alias("q")).withColumn("stored", F.col("q"))
    sink.write_dataset(path, values, "q")
    sink.write_dataset(path, values, "stored", {"dtype": "int", "scale_factor": 10})
    sink.update_dataset(path, values.withColumn("q", F.col("q") + 1), "q")
    return sink.read_store(spark, path, ["q", "stored"])


@query("SELECT gid, ts, l_quantity, CAST(year(ts) AS INTEGER) AS year FROM daily WHERE year(ts) IN (1994, 1996)")
def multi_year_files(spark, d):
    folder, rows = shared_path(spark, "years"), daily(spark, d).select("gid", "ts", "l_quantity")
    paths = [f"{folder}/daily_{y}.parquet" for y in (1994, 1995, 1996)]
    for y, path in zip((1994, 1995, 1996), paths, strict=True):
        scan.in_years(rows, [y]).write.parquet(path)
    return scan.by_year(spark, paths, [1994, 1996])


@query("""SELECT gid, ts, round(CASE WHEN value = 0 THEN 0 ELSE greatest(0, (60 + gid % 7) * sqrt(-ln(1 - q)) * (value / ((80 + gid % 5) * sqrt(-ln(1 - q))))) END, 6) AS value
  FROM (SELECT gid, ts, value, 1 - exp(-power((CASE WHEN value = 0 THEN 0.01 ELSE value END) / 90.0, 2)) AS q FROM facts)""")
def qdm_parametric(spark, d):
    parameters = lambda scale: F.array(F.lit(2.0), F.lit(0.0), scale.cast("double"))
    rows = facts(spark, d).select("gid", "ts", "value")
    sites = rows.select("gid").distinct().select("gid", parameters(60 + F.col("gid") % 7).alias("params_oh"), parameters(80 + F.col("gid") % 5).alias("params_mh"), parameters(F.lit(90)).alias("params_mf"))
    return derive.mapped_wind_bias(rows, sites, "value", dist="weibull_min").select("gid", "ts", _r("value", 6).alias("value"))


@query("""SELECT gid, CAST(month(ts) AS INTEGER) AS month, round(sum(windspeed_80m * value) / sum(value), 5) AS mean, round(sum(windspeed_80m * value), 2) AS sum FROM facts GROUP BY gid, month(ts)""")
def weighted_monthly(spark, d):
    out = stats.weighted_stats(facts(spark, d), "windspeed_80m", ["value"], ["mean", "sum"], "monthly")
    return out.select("gid", "month", _r("mean", 5).alias("mean"), _r("sum", 2).alias("sum"))


@query("""SELECT gid, ts, round(least(1360, value * 3), 5) AS "DNI", round(least(1360, value), 5) AS "DHI", round(least(1360, value * 4), 5) AS "GHI", round(least(120, value / 20), 5) AS "Wind Speed", round(least(100, value / 10), 5) AS "Temperature" FROM facts""")
def site_model_files(spark, d):
    v, rows = F.col("value"), facts(spark, d)
    sun = rows.select("gid", "ts", (v * 3).alias("dni"), v.alias("dhi"), (v * 4).alias("ghi"))
    air = rows.select("gid", "ts", (v / 20).alias("windspeed"), (v / 10).alias("air_temperature"))
    out = site_model.site_table(site_model.loaded_files(_filed(sun, air), "pv"), time_columns=False)
    return out.select("gid", "ts", *[_r(F.col(f"`{c}`"), 5).alias(c) for c in ("DNI", "DHI", "GHI", "Wind Speed", "Temperature")])


@query("SELECT gid, ts, windspeed_100m, winddirection_100m FROM facts")
def height_projection(spark, d):
    return layout.at_height(facts(spark, d), 100, WIND)


@query("""SELECT dataset, 'double' AS dtype, CAST(t AS BIGINT) AS chunk_times, CAST(least(sites, ceil(2 / (t * 8 * 1e-6))) AS BIGINT) AS chunk_sites
FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS dataset, CASE WHEN w >= times THEN ceil(times / 4.0) ELSE w END AS t, sites
  FROM (SELECT times, sites, ceil(ceil(8 / (times / 8760.0)) * 7 * 24 * (times / 8760.0)) AS w FROM (SELECT count(DISTINCT ts) AS times, count(DISTINCT gid) AS sites FROM daily)))""")
def chunk_plan(spark, d):
    """The chunks that the datasets would get, from the times and sites they have."""
    return layout.describe_layout(daily(spark, d), WIND)


@query("SELECT gid, time_bucket(INTERVAL '1 day', ts) AS ts, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM facts GROUP BY 1, 2")
def windowed_stats(spark, d):
    from aeolith.streaming.stats import windowed_stats as windows

    return windows(facts(spark, d), "value", "1 day").select("gid", F.col("start").cast("timestamp_ntz").alias("ts"), "n", _r("mean").alias("mean"), _r("std").alias("std"))


@query("SELECT count(*) AS n, round(avg(CASE WHEN z < 0 THEN 0 ELSE 1 - exp(-power(greatest(z, 0), 2.0)) END), 6) AS p FROM (SELECT (value - 1.0) / 50.0 AS z FROM facts)")
def parametric_distribution(spark, d):
    p = quantiles.parametric_cdf("weibull_min", F.col("value"), 2.0, 1.0, 50.0)
    return facts(spark, d).agg(F.count("*").alias("n"), _r(F.avg(p)).alias("p"))


@query("""SELECT gid, time_bucket(INTERVAL '1 day', ts) AS ts, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM facts GROUP BY 1, 2""")
def streamed_stats(spark, d):
    """Events replayed in batches, one of ten a batch late, equal to the statistics of all."""
    from aeolith.streaming.stats import latest, upserted, windowed_stats

    source, sunk = shared_path(spark, "replay"), shared_path(spark, "streamed")
    rows = facts(spark, d).select("gid", "ts", "value", (F.floor(F.dayofmonth("ts") / 8) + (F.col("event_id") % 10 == 0).cast("int")).cast("int").alias("part"))
    for part in range(5):  # files arrive in this order
        rows.where(F.col("part") == part).drop("part").coalesce(4).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 4).parquet(source)
    upserted(windowed_stats(stream, "value", "1 day", "20 days", median=True), f"{sunk}/windows", f"{sunk}/checkpoint").awaitTermination()
    out = latest(spark, f"{sunk}/windows")
    return out.select("gid", F.col("start").cast("timestamp_ntz").alias("ts"), "n", _r("mean").alias("mean"), _r("median").alias("median"))


@query("""SELECT f.gid, f.ts, round(CASE WHEN f.ts < TIMESTAMP '2024-01-16' THEN round_even(value * 10, 0) / 10 ELSE round_even(value * 100, 0) / 100 END, 4) AS value, CAST(hour(f.ts) AS INTEGER) AS hour_of_day, m.timezone, m.latitude
FROM facts AS f LEFT JOIN meta AS m USING (gid)""")
def labelled_files(spark, d):
    """One variable in two files of different scales, one by time alone and one by site alone, with coordinates."""
    from aeolith.sources import labelled

    rows, sites, cut = facts(spark, d), meta(spark, d), F.lit("2024-01-16").cast("timestamp_ntz")
    root = shared_path(spark, "labelled")
    values = rows.select("gid", "ts", "value")
    parts = {
        "early": sink.scaled(values.where(F.col("ts") < cut), {"value": {"dtype": "smallint", "scale_factor": 10, "units": "W"}}),
        "late": sink.scaled(values.where(F.col("ts") >= cut), {"value": {"dtype": "int", "scale_factor": 100, "units": "W"}}),
        "times": rows.select("ts", F.hour("ts").alias("hour_of_day")).distinct(),
        "sites": sites.select("gid", "timezone"),
    }
    for name, part in parts.items():
        part.write.parquet(f"{root}/{name}")
    data = labelled.open_files(spark, [f"{root}/{n}" for n in parts], SOLAR, sites)
    out = data.table("value", "hour_of_day", "timezone", coordinates=True)
    return out.select("gid", "ts", _r(F.col("value").cast("double"), 4).alias("value"), "hour_of_day", "timezone", "latitude")
