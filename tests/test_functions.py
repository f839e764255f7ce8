import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeolith.functions import heights, irradiance, quantiles, scaling, solar, units


def one(spark, column, **values):
    row = [tuple(values.values())] if values else [(0,)]
    return spark.createDataFrame(row, list(values) or ["x"]).select(column).first()[0]


def test_unscale_divides_without_adder_and_multiplies_with(spark):
    assert one(spark, scaling.unscale(F.col("x"), 100), x=1234) == pytest.approx(12.34)
    assert one(spark, scaling.unscale(F.col("x"), 0.5, 3), x=10) == pytest.approx(8.0)
    assert one(spark, scaling.unscale(F.col("x")), x=7) == 7


def test_to_stored_rounds_half_to_even_and_guards_types(spark):
    assert one(spark, scaling.to_stored(F.col("x"), "smallint", 10), x=0.25) == 2
    with pytest.raises(ValueError):
        scaling.to_stored(F.col("x"), "float", 10)
    with pytest.raises(ValueError):
        scaling.to_stored(F.col("x"), "int")
    with pytest.raises(ValueError):
        scaling.converted(F.col("x"), "int", "float")
    with pytest.raises(ValueError):
        scaling.converted(F.col("x"), "float", "int")


def test_smallest_integer_looks_at_both_ends():
    assert scaling.smallest_integer(-40_000, 5).simpleString() == "int"
    assert scaling.smallest_integer(-5, 32_766).simpleString() == "smallint"


@pytest.mark.parametrize("height", [80, 90, 100, 130])
def test_linear_height(spark, height):
    got = one(spark, heights.linear(F.col("a"), 80, F.col("b"), 100, height), a=5.0, b=7.0)
    assert got == pytest.approx(5 + (height - 80) / 20 * 2)


def test_power_law_by_row_is_bounded(spark):
    steep = one(spark, heights.power_law_by_row(F.col("a"), 80, F.col("b"), 100, 120), a=1.0, b=9.0)
    assert steep == pytest.approx(1.0 * (120 / 80) ** 0.6)
    calm = one(spark, heights.power_law_by_row(F.col("a"), 80, F.col("b"), 100, 120), a=0.0, b=0.0)
    assert calm == pytest.approx(0.001 * 1.5**0.06)


def test_circular_turns_the_short_way(spark):
    assert one(spark, heights.shortest_turn(F.col("a"), F.col("b")), a=350.0, b=10.0) == pytest.approx(20)
    assert one(spark, heights.shortest_turn(F.col("a"), F.col("b")), a=10.0, b=350.0) == pytest.approx(-20)
    assert one(spark, heights.circular(F.col("a"), 80, F.col("b"), 100, 90, "low"), a=350.0, b=10.0) == pytest.approx(0, abs=1e-9)
    assert one(spark, heights.circular(F.col("a"), 80, F.col("b"), 100, 90), a=350.0, b=10.0) == pytest.approx(20)


def test_stability_is_zero_at_neutral_and_continuous(spark):
    assert one(spark, heights.stability(F.col("z")), z=0.0) == pytest.approx(0)
    near = [one(spark, heights.stability(F.col("z")), z=z) for z in (-1e-6, 1e-6)]
    assert near == pytest.approx([0, 0], abs=1e-4)
    assert one(spark, heights.monin_obukhov(F.col("v"), 80, 40, F.lit(0.1), F.lit(0.0)), v=8.0) == pytest.approx(8 * math.log(400) / math.log(800))


def test_sun_is_high_at_noon_on_the_equator(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2020-03-20 12:00:00' AS noon, TIMESTAMP_NTZ '2020-03-20 00:00:00' AS night")
    z = df.select(solar.zenith(F.col("noon"), F.lit(0.0), F.lit(0.0)), solar.zenith(F.col("night"), F.lit(0.0), F.lit(0.0))).first()
    assert z[0] < 3 and z[1] > 170
    p = df.select(solar.sun_position(F.col("noon"), F.lit(40.0), F.lit(-105.0)).alias("p")).select("p.*").first()
    assert p.zenith == pytest.approx(90 - p.apparent_elevation) and 0 <= p.azimuth <= 180


def test_fill_missing_and_corrections(spark):
    got = irradiance.fill_missing(None, F.lit(500.0), F.lit(100.0), F.lit(60.0))["ghi"]
    assert one(spark, got) == pytest.approx(350)
    with pytest.raises(ValueError):
        irradiance.fill_missing(None, None, F.lit(1.0), F.lit(0.0))
    new = irradiance.linear_correction(F.col("g"), F.col("n"), F.col("h"), F.lit(2.0), F.lit(0.0))
    row = spark.createDataFrame([(300.0, 400.0, 100.0), (50.0, 0.0, 50.0), (0.0, 0.0, 0.0)], "g double, n double, h double").select(new["ghi"].alias("g"), new["dni"].alias("n"), new["dhi"].alias("h")).collect()
    assert [tuple(r) for r in row] == [(600.0, 800.0, 200.0), (100.0, 0.0, 100.0), (0.0, 0.0, 0.0)]


@pytest.mark.parametrize("sampling", ["linear", "log", "invlog"])
def test_grids(sampling):
    g = quantiles.grid(20, sampling)
    assert g[0] == 0 and g[-1] == pytest.approx(1) and sorted(g) == g
    if sampling != "linear":
        even = np.linspace(0, 1, 20)
        assert (np.array(g)[1:-1] < even[1:-1]).all() == (sampling == "log")
    with pytest.raises(KeyError):
        quantiles.grid(3, "odd")


def test_interpolate_like_numpy(spark):
    xs, ys = [0.0, 1.0, 1.0, 2.0], [0.0, 0.3, 0.6, 1.0]
    for x in (-1.0, 0.0, 0.5, 1.0, 1.7, 2.0, 9.0):
        got = one(spark, quantiles.interpolate(F.col("x"), F.col("xs"), F.col("ys")), x=x, xs=xs, ys=ys)
        assert got == pytest.approx(float(np.interp(x, xs, ys))), x


def test_delta_mapping_options(spark):
    oh, mh, mf = [float(x) for x in range(0, 50)], [float(x) * 0.5 for x in range(0, 50)], [float(x) * 0.8 for x in range(0, 50)]

    def numpy_version(x, relative, zero=None, least=None, bounds=None):
        g = np.linspace(0, 1, 50)
        q = np.interp(x, mf, g)
        o, m = np.interp(q, g, oh), np.interp(q, g, mh)
        if relative:
            m = zero if m == 0 and zero is not None else m
            m = max(m, least) if least is not None else m
            d = x / m
        else:
            d = x - m
        d = min(max(d, bounds[0]), bounds[1]) if bounds else d
        return o * d if relative else o + d

    for x in (3.3, 17.0, 39.2, 60.0):
        for kw, args in (({}, {}), ({"bounds": (0.5, 1.2)}, {"delta_range": (0.5, 1.2)}), ({"least": 5.0}, {"denominator_min": 5.0})):
            got = one(spark, quantiles.delta_mapping(F.col("x"), F.col("a"), F.col("b"), F.col("c"), True, **args), x=x, a=oh, b=mh, c=mf)
            assert got == pytest.approx(numpy_version(x, True, **kw))
        got = one(spark, quantiles.delta_mapping(F.col("x"), F.col("a"), F.col("b"), F.col("c"), False), x=x, a=oh, b=mh, c=mf)
        assert got == pytest.approx(numpy_version(x, False))
    assert one(spark, quantiles.mapped_wind(F.col("x"), F.col("a"), F.col("b"), F.col("c"), denominator_min=0.01), x=0.0, a=oh, b=mh, c=mf) == 0


@pytest.mark.parametrize(("name", "shape"), [("weibull_min", [2.0]), ("expon", []), ("uniform", []), ("gumbel_r", []), ("logistic", [])])
def test_distributions_invert(spark, name, shape):
    q = one(spark, quantiles.parametric_cdf(name, quantiles.parametric_ppf(name, F.lit(0.37), *shape, 1.0, 3.0), *shape, 1.0, 3.0))
    assert q == pytest.approx(0.37)


@pytest.mark.parametrize(("name", "shape", "ends"), [("weibull_min", [2.0], (1.0, np.inf)), ("expon", [], (1.0, np.inf)), ("uniform", [], (1.0, 4.0)), ("gumbel_r", [], (-np.inf, np.inf)), ("logistic", [], (-np.inf, np.inf))])
def test_distributions_end(spark, name, shape, ends):
    assert tuple(one(spark, quantiles.parametric_ppf(name, F.col("q"), *shape, 1.0, 3.0), q=q) for q in (0.0, 1.0)) == ends


def test_mapping_beyond_the_last_quantile_is_no_number(spark):
    """1 - exp(-38.4) is 1 in double precision: both quantiles are infinite, and inf * (x / inf) is no number, not 0."""
    got = one(spark, quantiles.mapped_wind(F.col("x"), F.col("a"), F.col("b"), F.col("c"), dist="weibull_min"), x=560.0, a=[2.0, 0.0, 63.0], b=[2.0, 0.0, 83.0], c=[2.0, 0.0, 90.0])
    assert np.isnan(got)


def test_units(spark):
    def unit(x, v, t, m, lo):
        return one(spark, units.normalised(F.lit(x), v, t, lambda limit: F.lit(m) > limit, F.lit(lo)))

    assert unit(101325.0, "pressure", "windpower", 1e5, 1e5) == pytest.approx(1, abs=1e-3)
    assert unit(100000.0, "surface_pressure", "csp", 1e5, 9e4) == pytest.approx(1000)
    assert unit(100.0, "surface_pressure", "csp", 100.0, 90.0) == pytest.approx(1000)
    assert unit(300.0, "temperature", "pv", 290.0, 250.0) == pytest.approx(26.85)
    assert unit(300.0, "temperature", "geothermal", 290.0, 250.0) == 300
    assert one(spark, units.clamped(F.lit(140.0), "windspeed", "windpower")) == 120


def test_dates(spark):
    import datetime as dt

    from aeolith.functions import dates

    assert dates.date_of("20120229") == dt.date(2012, 2, 29)
    for bad in ("2012022", "19000101", "20121301"):
        with pytest.raises(ValueError):
            dates.date_of(bad)
    assert one(spark, dates.date_from_int(F.col("x")), x=20120301) == dt.date(2012, 3, 1)
    assert one(spark, dates.time_in_name(F.col("p")), p="/a/out_2010-07-04_05:06:07.parquet") == dt.datetime(2010, 7, 4, 5, 6, 7)
    assert one(spark, dates.time_in_name(F.col("p"), "%Y%m%d"), p="/a/x_20100704.parquet") == dt.datetime(2010, 7, 4)
    assert one(spark, dates.time_in_name(F.col("p")), p="/a/none.parquet") is None


@pytest.mark.parametrize("sampling", ["linear", "log", "invlog"])
def test_quantiles_both_ways_like_numpy(spark, sampling):
    rng = np.random.default_rng(3)
    for n in (2, 3, 16, 50, 200) if sampling == "invlog" else (1, 2, 3, 16, 50, 200):
        values = sorted(float(x) for x in rng.integers(0, max(2, n), n))  # with equal knots
        g = quantiles.grid(n, sampling)
        xs = [-1.0, *values, *rng.uniform(0, n, 20).tolist(), n + 1.0]
        qs = [0.0, 1.0, -0.5, 1.5, *g, *rng.uniform(0, 1, 20).tolist()]
        rows = spark.createDataFrame([(x, q, values) for x, q in zip(xs + xs[: len(qs)], qs, strict=False)], "x double, q double, v array<double>")
        got = rows.select("x", "q", quantiles.quantile_of(F.col("x"), F.col("v"), sampling).alias("of"), quantiles.value_at(F.col("q"), F.col("v"), sampling).alias("at")).collect()
        # at a knot that is repeated the last one counts
        last = [max(i for i, v in enumerate(values) if v <= x) if x >= values[0] else -1 for x in (r.x for r in got)]
        of = [g[0] if i < 0 else g[-1] if i == n - 1 else g[i] + (r.x - values[i]) * (g[i + 1] - g[i]) / (values[i + 1] - values[i]) for i, r in zip(last, got, strict=True)]
        assert [r.of for r in got] == pytest.approx(of, abs=1e-9)
        assert [r["at"] for r in got] == pytest.approx([float(np.interp(r.q, g, values)) for r in got], abs=1e-6)
    nothing = rows.select(quantiles.value_at(F.lit(None).cast("double"), F.col("v"), sampling).alias("a"), quantiles.quantile_of(F.lit(1.0), F.lit(None).cast("array<double>"), sampling).alias("b")).first()
    assert nothing.a is None and nothing.b is None


def test_draws_follow_their_distribution(spark):
    values = [0.0, 1.0, 4.0, 9.0]
    got = np.array([r.x for r in spark.range(4000).select(quantiles.random_from(F.array(*[F.lit(v) for v in values]), 5).alias("x")).collect()])
    assert abs((got < 1).mean() - 1 / 3) < 0.03 and abs((got < 4).mean() - 2 / 3) < 0.03 and got.min() >= 0 and got.max() <= 9
