import datetime as dt
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aeolith.errors import ExtrapolationWarning, ResourceKeyError, ResourceValueError, ResourceWarning
from aeolith.operators import derive, fits, jointpd, ordered, select, selection, spatial, stats
from aeolith.plans import site_model
from aeolith.sources import sink
from aeolith.sources.catalog import WIND, Catalog


def test_index_algebra(facts):
    def gids(item, n=4):
        return sorted(r.gid for r in facts.where(select.index_condition(F.col("gid"), item, n)).select("gid").distinct().collect())

    assert gids(2) == [2] and gids(-1) == [3]
    assert gids(slice(1, None)) == [1, 2, 3] and gids(slice(0, 4, 2)) == [0, 2] and gids(slice(-2, None)) == [2, 3]
    assert gids([3, 0]) == [0, 3] and gids([True, False, False, True]) == [0, 3]


def test_requests_keep_order_and_repeats(facts):
    at = dt.datetime(2012, 1, 31, 5)
    rows = select.requested(facts, gid=[2, 0, 2], ts=[at] * 3).orderBy("pos").collect()
    assert [r.gid for r in rows] == [2, 0, 2]
    with pytest.raises(IndexError):
        select.requested(facts, gid=[1], ts=[at, at])


def test_places(facts, meta):
    assert select.in_box(meta, (42, -102), (41, -104)).count() == 2
    assert select.at_sites(facts, select.in_region(meta, "CO")).select("gid").distinct().count() == 2
    assert select.distinct_values(meta, "country") is None
    with pytest.raises(IndexError):
        select.timestep(facts, "1999-01-01")
    with pytest.raises(ResourceValueError):
        select.check_bounds(meta, [(10.0, 0.0)])
    assert select.time_stride(facts, 6).count() == 4 * 8


def test_stats_against_numpy(facts):
    rows = stats.stats(facts, "windspeed_80m", ["mean", "median", "std", "min"], "all").collect()
    by = {(r.gid, r.month, r.hour): r for r in rows}
    x = np.array([10 + h % 24 for h in range(48)], float)
    whole = by[1, None, None]
    assert (whole.mean, whole.median) == (x.mean(), np.median(x)) and whole.std == pytest.approx(x.std(ddof=1))
    assert by[1, 1, None].std == pytest.approx(x[:24].std()) and by[1, 2, 7].mean == 17 and by[1, None, 7].std == 0
    with pytest.raises(KeyError):
        stats.stats(facts, "windspeed_80m", ["nope"])


def _exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan, sum("Exchange hashpartitioning" in line and "Reused" not in line for line in plan.splitlines())


def test_medians_of_all_groups_take_one_exchange(spark, facts, tmp_path):
    facts.write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    plan, n = _exchanges(stats.stats(facts, "windspeed_80m", ["mean", "median", "std"], "all"))
    assert "Expand" not in plan and n == 1 and plan.count("ReusedExchange") == 3, plan


@pytest.mark.parametrize("period", ["full", "monthly", "diurnal", "monthly_diurnal", "all"])
def test_merged_statistics_equal_direct_ones(spark, facts, period):
    odd = facts.unionByName(facts.withColumn("gid", F.lit(9)).withColumn("windspeed_80m", F.lit(None).cast("double"))).unionByName(facts.limit(1).withColumn("gid", F.lit(10)))
    names = ["mean", "min", "max", "sum", "count", "std"]
    merged = stats.stats(odd, "windspeed_80m", names, period)
    direct = stats.stats(odd, "windspeed_80m", [*names, "median"], period)
    plan, _ = _exchanges(merged)
    assert period != "all" or "partial_var_pop" in plan or "var_pop" in plan
    a, b = ({(r.gid, r.month, r.hour): tuple(r[3:9]) for r in df.collect()} for df in (merged, direct))
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], nan_ok=True), k


def test_custom_statistics_take_arguments_and_give_lists(facts):
    def span(x, low=0.0):
        return x.max() - x.min() + low

    wanted = {
        "q": {"func": "percentiles", "kwargs": {"q": [0.1, 0.9]}}, "spread": {"func": "std"}, "top": {"func": lambda x, n=1: F.slice(F.sort_array(F.collect_list(x), asc=False), 1, n), "kwargs": {"n": 2}},
        "span": {"func": stats.of_values(span), "kwargs": {"low": 5.0}}, "ends": {"func": stats.of_values(lambda x: [x.min(), x.max()], "array<double>")},
    }
    rows = stats.stats(facts, "windspeed_80m", wanted, "monthly").where("gid = 1").orderBy("month").collect()
    x = np.array([10 + h % 24 for h in range(24)], float)
    assert len(rows) == 2
    for r in rows:
        assert r.q == pytest.approx(np.quantile(x, [0.1, 0.9]).tolist()) and r.spread == pytest.approx(x.std())
        assert (r.top, r.span, r.ends) == ([33.0, 32.0], 28.0, [10.0, 33.0])
    for bad in ({"a": {"kwargs": {}}}, {"a": {"func": "mean", "kwargs": [1]}}):
        with pytest.raises(ValueError):
            stats.stats(facts, "windspeed_80m", bad)
    with pytest.raises(KeyError):
        stats.stats(facts, "windspeed_80m", {"a": {"func": "nope"}})


def test_fits_maximise_likelihood(spark):
    rng = np.random.default_rng(4)
    samples = {(0, 1): rng.weibull(2.3, 800) * 7.9, (0, 2): rng.weibull(0.7, 500) * 3, (1, 1): rng.gamma(3.0, 2.0, 900), (None, 1): rng.weibull(9, 300) * 250}
    rows = [(g, m, float(v)) for (g, m), x in samples.items() for v in x] + [(5, 1, 2.0), (5, 1, 2.0), (6, 1, None), (6, 1, 0.0), (0, 1, float("nan")), (0, 1, -3.0), (0, 1, 0.0)]
    df = spark.createDataFrame(rows, "gid long, month int, x double")

    def weibull(k, x):
        scale = (x**k).mean() ** (1 / k)
        return len(x) * math.log(k / scale) + ((k - 1) * np.log(x / scale) - (x / scale) ** k).sum()

    def gamma(k, x):
        scale = x.mean() / k
        return ((k - 1) * np.log(x) - x / scale).sum() - len(x) * (math.lgamma(k) + k * math.log(scale))

    for name, likelihood in (("weibull_min", weibull), ("gamma", gamma)):
        got = {(r.gid, r.month): r for r in fits.FITS[name](df, "x", ["gid", "month"]).collect()}
        assert got[5, 1].fit is None and (6, 1) not in got and got[0, 1].n == 800
        for key, x in samples.items():
            k, place, scale = got[key].fit
            assert place == 0 and scale == pytest.approx(((x**k).mean() ** (1 / k)) if name == "weibull_min" else x.mean() / k, rel=1e-9)
            best = likelihood(k, x)
            assert all(best >= likelihood(k * f, x) for f in (0.99, 1.01, 0.9999, 1.0001)), (name, key)
    assert {r.gid: r.fit for r in fits.fit_exponential(df.where("gid = 5"), "x").collect()} == {5: [2.0, 0.0]}
    with pytest.raises(KeyError):
        fits.fit(df, "x", "cauchy")


def test_order_statistics_equal_sorting(spark):
    rng = np.random.default_rng(1)
    values = [*rng.normal(0, 1e6, 300), *([7.0] * 50), 1e300, -1e300, 5e-324, 0.0, float("inf"), 1e300]
    df = spark.createDataFrame([(v,) for v in [*map(float, values), None, float("nan")]], "x double").repartition(5)
    places = list(range(0, len(values), 37)) + [len(values) - 1]
    assert selection.order_statistics(df.where("x < double('infinity')"), "x", places[:-1]) == [sorted(values)[p] for p in places[:-1]]
    finite = [v for v in values if abs(v) < 1e9]
    some = spark.createDataFrame([(float(v),) for v in finite], "x double")
    assert selection.quantiles(some, "x", [0, 0.31, 0.5, 1]) == pytest.approx(np.quantile(finite, [0, 0.31, 0.5, 1]).tolist())
    assert selection.quantiles(some.limit(0), "x", [0.5]) == [None]
    with pytest.raises(IndexError):
        selection.order_statistics(some, "x", [10**6])


@pytest.mark.parametrize("values", [[1, 2, 3, 4], [1, 2, 2, 9], [5], [2, 2], [], [float("nan"), 3, None], [1, 3, 3, 8, 9], [0, 4]])
def test_median_above(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values] or [(None,)], "x double")
    known = [v for v in values if v is not None and v == v]
    for limit in (0.0, 1.0, 2.0, 2.5, 3.0, 8.5):
        want = bool(np.median(known) > limit) if known else None
        assert df.agg(selection.median_above(F.col("x"), limit).alias("a")).first().a == want


def test_units_without_a_sort(facts):
    out = derive.in_model_units(facts.withColumn("temperature_80m", F.col("windspeed_80m") + 280), ["temperature_80m"], "windpower")
    plan, _ = _exchanges(out)
    assert "percentile" not in plan and "median" not in plan.replace("median_above", "") and out.agg(F.max("temperature_80m")).first()[0] == pytest.approx(53 + 280 - 273.15)


def test_masked_and_missing_values(spark):
    df = spark.createDataFrame([(0, dt.datetime(2020, 1, 1, h), v) for h, v in enumerate([0.0, 2.0, float("nan"), None, 4.0])], "gid long, ts timestamp_ntz, x double")
    assert stats.stats(df, "x", ["mean"], "full", mask_zeros=True).first().mean == 3
    assert stats.stats(df, "x", ["mean"], "full").first().mean == 2
    assert stats.cdf(df, "x", 3).first().cdf == [0.0, 2.0, 4.0]
    assert stats.cdf(df.where("x IS NULL"), "x", 3).first().cdf == [0.0, 0.0, 0.0]


def test_labels(facts):
    wide = stats.widened(stats.stats(facts, "windspeed_80m", ["mean"], "all"), ["mean"])
    assert {"mean", "Jan_mean", "05:00UTC_mean", "Feb-23:00UTC_mean"} <= set(wide.columns)


def test_registered_statistics(facts):
    stats.register("range", lambda x: F.max(x) - F.min(x))
    assert stats.stats(facts, "windspeed_80m", ["range", "mode"], "full").where("gid = 0").first()[3:] == (23.0, 0.0)


def test_circular_means(spark):
    df = spark.createDataFrame([(0, 350.0, 1.0), (0, 10.0, 1.0), (0, float("nan"), 9.0), (1, 90.0, 0.0), (1, 180.0, 5.0)], "gid long, d double, w double")
    got = {r.gid: r.circular_mean for r in stats.circular_mean(df, "d").collect()}
    assert math.cos(math.radians(got[0])) == pytest.approx(1) and got[1] == pytest.approx(135)
    heavy = {r.gid: r.circular_mean for r in stats.circular_mean(df, "d", ["w"]).collect()}
    assert heavy[1] == pytest.approx(math.degrees(math.atan2(1, -math.exp(5))))


def test_joint_density_integrates_to_one(facts):
    d = jointpd.joint_density(facts, F.col("windspeed_80m"), (0, 60, 5), F.col("windspeed_100m"), (0, 70, 7), dense=True)
    assert d.where("gid = 1").agg(F.sum("density")).first()[0] * 35 == pytest.approx(1)
    assert d.count() == 4 * 12 * 10
    h, _, _ = np.histogram2d([10 + t % 24 for t in range(48)], [(10 + t % 24) * 1.1 + 1 for t in range(48)], [np.arange(0, 65, 5), np.arange(0, 77, 7)], density=True)
    mine = {(r.bin_1, r.bin_2): r.density for r in d.where("gid = 1").collect()}
    assert all(mine[5.0 * i, 7.0 * j] == pytest.approx(h[i, j]) for i in range(12) for j in range(10))


def test_roll_wraps(facts, meta):
    rows = facts.withColumn("t_idx", F.expr("CAST(row_number() OVER (PARTITION BY gid ORDER BY ts) - 1 AS long)"))
    out = ordered.roll_to_local(rows, "windspeed_80m", meta).where("gid = 0").orderBy("t_idx").collect()
    assert [r.windspeed_80m for r in out] == np.roll([float(h % 24) for h in range(48)], -7).tolist()


def test_interpolation_is_by_position(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])], "gid long, ts long, x double")
    assert [r.x for r in ordered.interpolate_in_time(df, "x").orderBy("ts").collect()] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_upsampling_by_elapsed_time(spark):
    at = lambda h, m: dt.datetime(2020, 6, 1, h, m)
    rows = [(0, at(1, 0), 0.0, 3), (0, at(2, 0), 4.0, 4), (0, at(2, 30), None, 5), (0, at(3, 0), 8.0, None), (1, at(5, 10), 7.0, 1), (2, None, 1.0, 1)]
    out = ordered.upsampled(spark.createDataFrame(rows, "gid long, ts timestamp_ntz, x double, kind int"), "30 minutes", ["x"], ["kind"])
    got = [(r.gid, r.ts.hour, r.ts.minute, r.x, r.kind) for r in out.orderBy("gid", "ts").collect()]
    assert got == [(0, 1, 0, 0.0, 3), (0, 1, 30, 2.0, 3), (0, 2, 0, 4.0, 4), (0, 2, 30, 6.0, 5), (0, 3, 0, 8.0, 5), (1, 5, 0, 7.0, 1)]


def test_downscaling_adds_the_sun(spark, meta):
    at = lambda h: dt.datetime(2020, 6, 1, h)
    rows = spark.createDataFrame([(0, at(18), 1.0, 5.0, 7), (0, at(19), 3.0, -9.0, 7), (0, at(20), 5.0, 9.0, 0)], "gid long, ts timestamp_ntz, x double, depth double, cloud_type int")
    out = ordered.downscaled(rows, meta, "15 minutes", ["x"], ["depth"]).orderBy("ts").collect()
    assert len(out) == 9 and [r.x for r in out] == [1 + i / 4 * 2 for i in range(9)] and out[4].depth == 2.5 and out[5].cloud_type == 7
    assert all(0 < r.solar_zenith_angle < 45 for r in out)


def test_cloud_property(spark):
    df = spark.createDataFrame([(0, 0, 5.0, 7), (0, 1, -9.0, 7), (0, 2, 7.0, 7), (0, 3, 3.0, 0)], "gid long, ts long, x double, cloud_type int")
    assert [r.x for r in ordered.fill_cloud_property(df, "x").orderBy("ts").collect()] == [5.0, 6.0, 7.0, 0.0]


def test_repeated_times(facts):
    assert ordered.repeated_times(facts.unionByName(facts.limit(1))).count() == 1


@pytest.mark.parametrize("limit", [10**6, 1])
def test_nearest_like_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(spatial, "ARRAY_SITES", limit)
    rng = np.random.default_rng(1)
    s, p = rng.uniform((30, -110), (45, -80), (200, 2)), rng.uniform((25, -115), (50, -75), (60, 2))
    sites = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(s)], "gid long, latitude double, longitude double")
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "point long, latitude double, longitude double")
    got = {(r.point, r.rank): r.gid for r in spatial.nearest(points, sites, 3).collect()}
    want = np.argsort(np.hypot(*(p[:, None] - s[None]).transpose(2, 0, 1)), 1)[:, :3]
    assert all(got[i, k + 1] == want[i, k] for i in range(60) for k in range(3))
    a, b = np.radians(p)[:, None], np.radians(s)[None]
    great = 2 * np.arcsin(np.sqrt(np.sin((b[..., 0] - a[..., 0]) / 2) ** 2 + np.cos(a[..., 0]) * np.cos(b[..., 0]) * np.sin((b[..., 1] - a[..., 1]) / 2) ** 2))
    far = {r.point: r.gid for r in spatial.nearest(points, sites, 1, "haversine").collect()}
    assert all(far[i] == great[i].argmin() for i in range(60))


@pytest.mark.parametrize("metric", ["planar", "haversine"])
@pytest.mark.parametrize("k", [1, 4])
def test_nearest_of_crowded_sites(spark, monkeypatch, metric, k):
    """Ranges of a few sites, most of them in one place, some equal, on both sides of the antimeridian."""
    rng = np.random.default_rng(8)
    s = np.concatenate([rng.normal((10, 20), 1e-3, (300, 2)), rng.uniform((-89, -180), (89, 180), (100, 2)), np.tile([[10.0, 20.0]], (40, 1))])
    p = np.concatenate([rng.normal((10, 20), 2e-3, (80, 2)), rng.uniform((-90, -180), (90, 180), (120, 2)), [[0.0, 180.0], [0.0, -180.0], [90.0, 0.0]]])
    sites = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(s)], "gid long, latitude double, longitude double")
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "point long, latitude double, longitude double")
    direct = {(r.point, r.rank): (r.gid, r.distance) for r in spatial.nearest(points, sites, k, metric).collect()}
    for name, value in {"ARRAY_SITES": 1, "RANGE_SITES": 16, "RANGE_POINTS": 30}.items():
        monkeypatch.setattr(spatial, name, value)
    ranged = {(r.point, r.rank): (r.gid, r.distance) for r in spatial.nearest(points, sites, k, metric).collect()}
    assert len(direct) == len(p) * k and ranged == direct


def test_ranges_have_bounded_populations(spark, monkeypatch):
    """However crowded the sites, no range has many more than its share."""
    sizes = []
    made = spatial._compared

    monkeypatch.setattr(spatial, "RANGE_SITES", 64)
    rng = np.random.default_rng(8)
    s = np.concatenate([rng.normal((10, 20), 1e-3, (3000, 2)), rng.uniform((-80, -180), (80, 180), (200, 2))])
    sites = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(s)], "gid long, latitude double, longitude double")

    def counting(k, metric):
        def count(asked, sites):
            return made(k, metric)(asked, sites).select(["point", "distance"]).append_column("gid", pa.array([sites.num_rows] * asked.num_rows))

        return count

    monkeypatch.setattr(spatial, "_compared", counting)
    points = sites.select(F.col("gid").alias("point"), F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"))
    sizes = [r.gid for r in spatial.nearest(points, sites, 1).collect()]
    assert len(sizes) >= 3200 and max(sizes) <= 100


@pytest.mark.parametrize("k", [1, 3])
def test_points_at_one_place_ask_once(spark, monkeypatch, k):
    """Many points at few places; every place is compared with its sites once, and sites of ranges that none asks for with none."""
    for name, value in {"ARRAY_SITES": 1, "RANGE_SITES": 8, "CUT_SITES": 100}.items():
        monkeypatch.setattr(spatial, name, value)
    rng = np.random.default_rng(3)
    s = np.concatenate([rng.normal((10, 20), 1e-3, (400, 2)), np.repeat(rng.uniform((-80, -180), (80, 180), (20, 2)), 5, 0)])
    p = np.tile(rng.uniform((-80, -180), (80, 180), (7, 2)), (30, 1))
    sites = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(s)], "gid long, latitude double, longitude double")
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "point long, latitude double, longitude double")
    compared, met = spatial._compared, spark.sparkContext.accumulator(0)

    def counting(k, metric):
        inner = compared(k, metric)
        return lambda asked, sites: met.add(len(set(asked["point"].to_pylist()) - set(range(7)))) or inner(asked, sites)

    monkeypatch.setattr(spatial, "_compared", counting)
    got = {(r.point, r["rank"]): r.gid for r in spatial.nearest(points, sites, k).collect()}
    want = np.argsort(np.hypot(*(p[:, None] - s[None]).transpose(2, 0, 1)), 1, kind="stable")[:, :k]
    assert got == {(i, r + 1): want[i, r] for i in range(len(p)) for r in range(k)} and met.value == 0


def test_series_at_places(spark, facts, meta):
    rows = spatial.series_at(facts, meta, "windspeed_80m", 41.1, -104.2).collect()
    assert len(rows) == 48 and all(r.windspeed_80m == 10 + r.ts.hour for r in rows)
    places = spark.createDataFrame([("a", 40.2, -105.0), ("b", 40.1, -104.9), ("c", 43.0, -102.0)], "name string, latitude double, longitude double")
    out = spatial.table_at(facts, meta, "windspeed_80m", places, point="name")
    assert {(r["name"], r.gid) for r in out.collect()} == {("a", 0), ("b", 0), ("c", 3)} and out.count() == 3 * 48


def test_bias_correction_warns_and_gives_means(spark, facts):
    table = spark.createDataFrame([(0, 2.0, 0.0), (1, 1.0, -100.0)], "gid long, scalar double, adder double")
    with pytest.warns(ResourceWarning, match="2 sites"):
        out, means = derive.bias_corrected(facts, table, "linear_wind", means=["windspeed_80m"], check=True, dataset="windspeed_80m")
    assert {r.gid: r.windspeed_80m_mean for r in means.collect()} == {0: 23.0, 1: 0.0, 2: 31.5, 3: 41.5} and out.count() == 192
    assert derive.bias_corrected(facts, table, lambda f, t: f.limit(1))[0].count() == 1
    with pytest.raises(KeyError):
        derive.bias_corrected(facts, table, "nope")


def test_lookup_errors(spark, meta):
    point = spark.createDataFrame([(0, 40.1, -104.9)], "point long, latitude double, longitude double")
    assert spatial.lookup(point, meta).first().gid == 0
    with pytest.raises(ResourceValueError):
        spatial.lookup(point.withColumn("latitude", F.lit(70.0)), meta)


@pytest.mark.parametrize("limit", [10**6, 1])
def test_threshold_of_sites_at_one_place(spark, monkeypatch, limit):
    """A site at another's place has a nearest one at distance 0; three in one place do not drop out."""
    monkeypatch.setattr(spatial, "ARRAY_SITES", limit)
    rows = [(7, 1.0, 1.0), (3, 1.0, 1.0), (5, 1.0, 1.0), (1, 2.0, 2.0), (2, 2.0, 2.0)]
    threshold = lambda rows: spark.range(1).select(spatial.distance_threshold(spark.createDataFrame(rows, "gid long, latitude double, longitude double"))).first()[0]
    assert threshold(rows) == 0
    assert threshold([*rows, (9, 1.0, 4.0)]) == pytest.approx(5**0.5 * 1.05 * 2**0.5 / 2)


@pytest.mark.parametrize("limit", [10**6, 1])
def test_weights_of_sites_at_one_place(spark, monkeypatch, limit):
    """Each of six sites at one place is its own nearest, if the targets are the sites."""
    monkeypatch.setattr(spatial, "ARRAY_SITES", limit)
    sites = spark.createDataFrame([(i, 40.0 + i // 6, -100.0) for i in range(8)], "gid long, latitude double, longitude double")
    targets = sites.withColumnRenamed("gid", "target")
    weights = spatial.regrid_weights(sites, targets, own=True)
    assert {(r.target, r.gid, r.weight) for r in weights.where("weight > 0").collect()} == {(i, i, 1.0) for i in range(8)} and weights.count() == 32
    assert {(r.target, r.gid) for r in spatial.regrid_weights(sites, targets).where("weight > 0").collect()} == {(i, i // 6 * 6) for i in range(8)}


def test_regrid(spark):
    sites = spark.createDataFrame([(i, float(i // 4), float(i % 4)) for i in range(16)], "gid long, latitude double, longitude double")
    targets = spark.createDataFrame([(0, 1.0, 1.0), (1, 0.5, 0.5)], "target long, latitude double, longitude double")
    values = sites.select("gid", F.lit(0).alias("ts"), F.col("gid").cast("double").alias("v"))
    got = {r.target: r.v for r in spatial.regrid(values, spatial.regrid_weights(sites, targets), "v").collect()}
    assert got[0] == 5 and got[1] == pytest.approx(2.5, abs=1e-3)


def test_regrid_paths_agree(spark, monkeypatch, tmp_path):
    """The packed and the joined way, with null values, absent facts, repeated ones and unknown sites."""
    sites = spark.createDataFrame([(i, float(i // 4), float(i % 4)) for i in range(16)], "gid long, latitude double, longitude double")
    targets = spark.createDataFrame([(f"t{i}", i * 0.37, i * 0.29) for i in range(9)], "target string, latitude double, longitude double")
    facts = spark.createDataFrame([(g, dt.date(2020, 1, d), None if g % 5 == d else float(g * d)) for g in range(20) for d in (1, 2, 3) if g % 7 != d] + [(1, dt.date(2020, 1, 1), 5.0)], "gid long, ts date, v double")
    cache = str(tmp_path / "weights")
    packed = {(r.target, r.ts): r.v for r in spatial.regrid_onto(facts, sites, targets, "v", cache=cache).collect()}
    assert spatial.stored_weights(spark, cache).count() == 36
    monkeypatch.setattr(spatial, "regrid_weights", None)  # the second call reads what the first has stored
    monkeypatch.setattr(spatial, "PACKED_WEIGHTS", 0)
    joined = {(r.target, r.ts): r.v for r in spatial.regrid_onto(facts, sites, targets, "v", cache=cache).collect()}
    assert packed.keys() == joined.keys() and len(packed) == 27
    assert all(packed[k] == (None if v is None else pytest.approx(v)) for k, v in joined.items())


def test_raster(spark):
    sites = spark.range(120).selectExpr("id AS gid", "30 + floor(id / 10) * 0.5 AS latitude", "-100 + id % 10 * 0.5 AS longitude").withColumn("latitude", F.col("latitude").cast("double")).withColumn("longitude", F.col("longitude").cast("double"))
    out = {(r.row, r.col): r.gid for r in spatial.raster(sites, (31.0, -99.0), (4, 3)).collect()}
    assert out[3, 0] == 22 and out[0, 2] == 54 and len(out) == 12
    assert spatial.raster(sites, (30.0, -100.0), (12, 10), max_step=5).count() == 120
    with pytest.raises(ResourceValueError):
        spatial.raster(sites, (31.0, -99.0), (40, 30))


def test_power_law_by_selection_and_site(facts):
    whole = derive.with_dataset(facts, "windspeed_120m", WIND).where("gid = 1 AND hour(ts) = 5").first().windspeed_120m
    a, b = facts.agg(F.avg("windspeed_80m"), F.avg("windspeed_100m")).first()
    assert whole == pytest.approx(15 * 1.5 ** (math.log(b / a) / math.log(1.25)))
    own = derive.with_dataset(facts, "windspeed_120m", WIND, per="site").where("gid = 1 AND hour(ts) = 5").first().windspeed_120m
    assert own != pytest.approx(whole)


def test_bias_tables(spark, facts):
    table = spark.createDataFrame([(1, 1.0, 2.0)], "gid long, adder double, scalar double")
    out = {r.gid: r.m for r in derive.linear_wind_bias(facts, table, "windspeed_80m").groupBy("gid").agg(F.max("windspeed_80m").alias("m")).collect()}
    assert out[1] == 67 and out[2] == 43
    knots = spark.createDataFrame([(2, "[0, 50, 100]", "[0, 25, 50]", "[0, 25, 50]")], "gid long, params_oh string, params_mh string, params_mf string")
    mapped = derive.mapped_wind_bias(facts, knots, "windspeed_80m", denominator_min=0.01).groupBy("gid").agg(F.max("windspeed_80m").alias("m")).collect()
    assert {r.gid: r.m for r in mapped}[2] == pytest.approx(86)


def test_site_model_wind(facts, meta):
    rows = facts.withColumns({"temperature_80m": F.lit(300.0), "pressure_80m": F.lit(1e5), "winddirection_80m": F.lit(10.0), "t_idx": F.expr("CAST(row_number() OVER (PARTITION BY gid ORDER BY ts) - 1 AS long)")})
    with pytest.warns(Warning):
        table = site_model.site_table(site_model.loaded(rows, "windpower", WIND, 90), meta)
    r = table.where("gid = 0").orderBy("ts").first()
    assert r.Temperature == pytest.approx(26.85, abs=0.1) and r.Pressure == pytest.approx(0.987, abs=0.01) and r.Speed == pytest.approx((7 + 7 * 1.1 + 1) / 2)


def test_stream_equals_batch(spark, facts, tmp_path):
    from aeolith.streaming.stats import windowed_stats

    facts.select("gid", "ts", "windspeed_80m").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("gid long, ts timestamp_ntz, windspeed_80m double").parquet(f"{tmp_path}/in")
    q = windowed_stats(stream, "windspeed_80m", "1 day").writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, windowed_stats(facts, "windspeed_80m", "1 day").collect()))


def test_spectrum(spark):
    df = spark.createDataFrame([(0, 5, [[1.0, 2.0], [3.0, 4.0]])], "gid long, ts long, s array<array<double>>")
    assert [tuple(r)[2:] for r in select.spectrum(df, "s", [0.1, 0.2], [90, 180]).collect()] == [(0.1, 90.0, 1.0), (0.1, 180.0, 2.0), (0.2, 90.0, 3.0), (0.2, 180.0, 4.0)]


def test_h5_source_is_importable_without_its_library():
    from aeolith.sources import h5

    assert h5.H5Source.name() == "resource_h5"


def test_more_site_heights_than_a_list_takes(spark):
    """1500 sites, each of its own height, against the column of that height; between, beyond and at stored heights."""
    n = 1500
    facts = spark.range(n).select(F.col("id").alias("gid"), F.lit(4.0).alias("windspeed_40m"), F.lit(6.0).alias("windspeed_80m"), F.lit(7.0).alias("windspeed_100m"), F.lit(350.0).alias("winddirection_40m"), F.lit(20.0).alias("winddirection_80m"))
    hubs = spark.range(n).select(F.col("id").alias("gid"), (F.col("id") * 0.1 + 10).alias("height"))
    for variable in ("windspeed", "winddirection"):
        out = {r.gid: r.hub for r in derive.at_site_heights(facts, variable, hubs, WIND, "hub").collect()}
        assert len(out) == n and None not in out.values()
        some = [0, 150, 299, 300, 301, 499, 500, 501, 599, 600, 601, 700, 899, 900, 901, 1499]
        with pytest.warns():
            want = facts.limit(1).select(*[Catalog.of(facts, WIND).column(f"{variable}_{round(i * 0.1 + 10, 1):g}m", per="row").alias(f"c{i}") for i in some]).first()
        assert [out[i] for i in some] == pytest.approx(list(want))


@pytest.mark.parametrize(("weights", "facts"), [(10**6, 10**6), (7, 5), (1, 1)])
def test_regrid_in_blocks(spark, monkeypatch, weights, facts):
    """More weights than go to all tasks, in one or many blocks: the rows of the packed way, and no join of facts with each target's weights."""
    sites = spark.createDataFrame([(i, float(i // 4), float(i % 4)) for i in range(16)], "gid long, latitude double, longitude double")
    targets = spark.createDataFrame([(i, i % 9 * 0.37, i % 9 * 0.29) for i in range(40)], "target long, latitude double, longitude double")
    rows = [(g, None if d == 3 else dt.date(2020, 1, d), None if g % 5 == d else float(g * d)) for g in range(20) for d in (1, 2, 3, 4) if g % 7 != d]
    table = spark.createDataFrame([*rows, rows[1]], "gid long, ts date, v double")
    table_of_weights = spatial.regrid_weights(sites, targets).cache()
    packed = {(r.target, r.ts): r.v for r in spatial.regrid(table, table_of_weights, "v").collect()}
    for name, value in {"PACKED_WEIGHTS": 100, "BLOCK_WEIGHTS": weights, "BLOCK_FACTS": facts}.items():
        monkeypatch.setattr(spatial, name, value)
    out = spatial.regrid(table, table_of_weights, "v")
    found = out.collect()
    blocks = {(r.target, r.ts): r.v for r in found}
    assert len(found) == len(packed) == 160 and packed.keys() == blocks.keys()
    assert all(packed[k] == (None if v is None else pytest.approx(v)) for k, v in blocks.items())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate" not in plan.split("MapInArrow")[0]


def test_nearest_paths_agree_across_the_antimeridian(spark, monkeypatch):
    sites = spark.createDataFrame([(i, -60.0 + 7.3 * (i % 17), -180.0 + 360.0 * ((i * 37) % 64) / 64) for i in range(64)] + [(64, 10.0, 179.95), (65, 10.0, -179.9)], "gid long, latitude double, longitude double")
    points = spark.createDataFrame([(i, -50.0 + 5.1 * (i % 20), -179.99 + 11.7 * i) for i in range(30)] + [(30, 10.0, 179.99), (31, 10.0, -179.99), (32, None, 0.0)], "point long, latitude double, longitude double")
    for metric in ("planar", "haversine"):
        both = []
        for limit in (2048, 1):
            monkeypatch.setattr(spatial, "ARRAY_SITES", limit)
            both.append(sorted((r.point, r["rank"], r.gid, round(r.distance, 9)) for r in spatial.nearest(points, sites, 3, metric).collect()))
        assert both[0] == both[1] and len(both[0]) == 96


def test_weighted_statistics_like_numpy(spark):
    rows = [(1, f"2012-0{m}-01 0{h}:00:00", float(m + h), float(h)) for m in (1, 2) for h in range(4)] + [(1, "2012-01-02 00:00:00", None, 5.0), (1, "2012-01-02 01:00:00", 5.0, None)]
    f = spark.createDataFrame(rows, "gid long, ts string, x double, w double").withColumn("ts", F.to_timestamp_ntz("ts"))

    def heaviest(x, w):
        return F.max_by(x, w)

    got = stats.weighted_stats(f, "x", ["w"], ["mean", "std", heaviest], "all")
    one = got.where("month IS NULL AND hour IS NULL").first()
    x, w = np.array([m + h for m in (1, 2) for h in range(4)], float), np.array([0, 1, 2, 3] * 2, float)
    mean = np.average(x, weights=w)
    assert one["mean"] == pytest.approx(mean) and one["std"] == pytest.approx(np.sqrt(np.average((x - mean) ** 2, weights=w)))
    assert got.where("month = 2 AND hour IS NULL").first()["heaviest"] == 5.0
    with pytest.raises(KeyError):
        stats.weighted_stats(f, "x", ["w"], ["unknown"])
    assert stats.weighted_stats(f.limit(0), "x", ["w"], period="monthly").count() == 0


def test_parametric_mapping_without_a_future(spark, facts):
    sites = facts.select("gid").distinct()
    table = sites.select("gid", F.lit("[2, 0, 8]").alias("params_oh"), F.lit("[2, 0, 10]").alias("params_mh"))
    f = facts.select("gid", "ts", F.col("windspeed_80m").alias("v")).where("v < 30")
    got = derive.mapped_wind_bias(f, table, "v", dist="weibull_min").join(f.withColumnRenamed("v", "old"), ["gid", "ts"])
    # of two Weibull distributions of one shape, quantiles are in the ratio of their scales
    assert got.where(F.abs(F.col("v") - F.col("old") * 0.8) > 1e-6).count() == 0
    assert got.where("old = 0").first()["v"] == 0
    same = derive.mapped_wind_bias(f, table.withColumn("params_mf", F.lit(None).cast("string")), "v", dist="weibull_min")
    assert same.exceptAll(derive.mapped_wind_bias(f, table, "v", dist="weibull_min")).count() == 0


def test_site_model_from_files_and_resolutions(spark, facts, meta):
    v = F.col("windspeed_80m")
    wind = facts.select("gid", "ts", v.alias("windspeed"), v.alias("winddirection"))
    air = facts.select("gid", "ts", (v / 2).alias("temperature"), F.lit(1.0).alias("pressure"))
    whole = site_model.loaded(wind.join(air, ["gid", "ts"]), "windpower")
    split = site_model.loaded_files([wind, air], "windpower", check=True)
    assert split.columns == whole.columns and split.exceptAll(whole).count() == 0 and split.count() == facts.count()
    # every second hour of two sites, the others take the nearest of them
    low = air.where("gid % 2 = 0 AND hour(ts) % 2 = 0")
    got = site_model.loaded_resolutions(wind, meta, low, meta.where("gid % 2 = 0"), "windpower")
    assert got.count() == facts.count() and got.where("temperature IS NULL OR pressure IS NULL").count() == 0
    at = got.where("gid = 2 AND hour(ts) = 5").first()
    assert at["temperature"] == pytest.approx((24 + 26) / 4) and at["windspeed"] == 25


def test_roughness_of_sites_and_warnings_of_exponents(spark, facts, meta):
    rows = facts.withColumn("inversemoninobukhovlength_2m", F.lit(0.01))
    rough = meta.withColumn("z0", F.lit(0.1))
    got = derive.with_dataset(rows, "windspeed_40m", WIND, meta=rough)
    want = derive.with_dataset(rows.withColumn("roughness_length", F.lit(0.1)), "windspeed_40m", WIND).drop("roughness_length")
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    own = rows.withColumn("roughness_length", F.lit(0.2))
    assert derive.with_roughness(own, rough) is own and derive.with_roughness(rows, meta) is rows
    steep = facts.withColumn("windspeed_100m", F.col("windspeed_80m") * 3)
    with pytest.warns(ExtrapolationWarning, match="shear exponents"):
        derive.with_dataset(steep, "windspeed_120m", WIND, per="site", check=True)


def test_depths_by_site(spark):
    """Each site at a depth of its own equals the model of all sites at that depth."""
    rows = spark.range(4).select(F.col("id").alias("gid"), F.lit(dt.datetime(2012, 1, 1)).cast("timestamp_ntz").alias("ts"), *[(F.col("id") + h / 10).alias(f"{v}_{h}m") for v in ("temperature", "potential_MW") for h in (1500, 2500)])
    depths = spark.createDataFrame([(0, 1500.0), (1, 2000.0), (2, 3500.0)], "gid long, height double")
    out = {r.gid: r for r in site_model.loaded(rows, "geothermal", heights_by_site=depths).collect()}
    assert sorted(out) == [0, 1, 2]
    for gid, depth in ((0, 1500), (1, 2000)):
        one = site_model.loaded(rows, "geothermal", height=depth).where(f"gid = {gid}").first()
        assert out[gid].temperature == pytest.approx(one.temperature) == pytest.approx(gid + depth / 10) and out[gid]["potential_MW"] == pytest.approx(one["potential_MW"])
    assert out[2].temperature == pytest.approx(352)
    assert {r.gid: r.height for r in site_model.with_heights(rows.select("gid"), depths).collect()} == {0: 1500, 1: 2000, 2: 3500, 3: None}
    assert site_model.with_heights(rows.select("gid"), 90).first().height == 90


def test_wind_model_with_icing_precipitation_and_heads(facts, meta, tmp_path):
    rows = facts.withColumns({"temperature_80m": F.lit(20.0), "pressure_80m": F.lit(1.0), "winddirection_80m": F.lit(10.0), "relativehumidity_2m": F.lit(120.0), "precipitationrate_0m": F.lit(0.5)})
    with pytest.warns(ResourceWarning, match="192 values of rh at 4 sites"):
        table = site_model.loaded(rows, "windpower", WIND, 80, icing=True, precipitation=True, check=True)
    assert {(r.rh, r.precipitationrate) for r in table.collect()} == {(99.9, 0.5)}
    with pytest.raises(ResourceKeyError):
        site_model.loaded(rows.drop("relativehumidity_2m"), "windpower", WIND, 80, icing=True)
    shown = site_model.wind_titles(site_model.site_table(table), 80)
    assert {"Wind Speed 80m", "Pressure 80m", "Relative Humidity 2m"} <= set(shown.columns)
    heads = site_model.wind_heads(shown, 80, {"Wind Speed 80m": "m/s"})
    sink.write_site_files(shown, meta, f"file://{tmp_path}", True, heads).collect()
    lines = open(f"{tmp_path}/0.csv").read().splitlines()
    names = lines[1].split(",")
    assert dict(zip(names, lines[2].split(","), strict=True))["Wind Speed 80m"] == "m/s" and set(lines[3].split(",")) == {"80"} and len(lines) == 4 + 48


def test_writers_check_shapes_and_tell_of_absent_datasets(facts, meta, tmp_path):
    times = facts.select("ts").distinct()
    with pytest.raises(ValueError, match="places"):
        sink.write_profiles(facts.where("gid < 3"), f"{tmp_path}/short", meta=meta, times=times)
    sink.write_profiles(facts, f"{tmp_path}/whole", meta=meta, times=times)
    with pytest.warns(ResourceWarning, match="ghi"):
        out = sink.subset(facts, meta.where("gid = 1"), ["windspeed_80m", "ghi"])
    assert out.columns == ["gid", "ts", "windspeed_80m"] and out.count() == 48
