"""Quantile grids, empirical distributions and quantile delta mapping."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def grid(n: int, sampling: str = "linear", base: float = 10) -> list[float]:
    """n quantiles from 0 to 1: even, dense near 0 (log) or dense near 1 (invlog)."""
    kind = sampling.casefold()
    even = [i / (n - 1) for i in range(n)] if n > 1 else [0.0] * n
    if kind == "linear":
        return even
    if kind not in ("log", "invlog"):
        raise KeyError(f"unknown sampling: {sampling}")
    dense = [(base**x - 1) / (base - 1) for x in even]
    return dense if kind == "log" else sorted(1 - x for x in dense)


def knots(value: Column, n: int = 50, sampling: str = "linear", base: float = 10, decimals: int | None = None) -> Column:
    """An aggregate: the value at each quantile of the grid, exactly, as an array; zeros where there is no value."""
    exact = F.percentile(F.nanvl(value.cast("double"), F.lit(None)), F.array(*[F.lit(q) for q in grid(n, sampling, base)]))
    out = F.coalesce(exact, F.array_repeat(F.lit(0.0), n))
    return out if decimals is None else F.transform(out, lambda x: F.bround(x, decimals))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


#: Halving steps, the largest first: lists of up to 65,535 knots.
_STEPS = [1 << i for i in reversed(range(16))]


def knots_below(x: Column, xs: Column) -> Column:
    """How many of the sorted knots are at most x, by halving: as many steps as their number has binary digits."""
    digits = F.length(F.bin(F.size(xs)))
    steps = F.slice(F.array(*[F.lit(s) for s in _STEPS]), -digits, digits)
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(xs, at + s - 1) <= x, at + s).otherwise(at))


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """ys over the sorted knots xs at x: the ends hold outside, the last of equal knots counts."""
    return _between(x, xs, F.size(xs), lambda i: F.get(ys, i))


def _between(x: Column, xs: Column, n: Column, y: Callable[[Column], Column]) -> Column:
    def line(x: Column, at: Column) -> Column:
        x0, x1, y0, y1 = F.get(xs, at - 1), F.get(xs, at), y(at - 1), y(at)
        inside = y0 + (x - x0) * (y1 - y0) / (x1 - x0)
        return F.when(x.isNull() | xs.isNull(), None).when(at <= 0, y(F.lit(0))).when(at >= n, y(n - 1)).otherwise(inside)

    return bound(x, lambda x: bound(knots_below(x, xs), lambda at: line(x, at)))


def quantile_of(x: Column, values: Column, sampling: str = "linear", base: float = 10) -> Column:
    """The empirical distribution function given by the values at the quantile grid."""
    n = F.size(values)
    return _between(x, values, n, lambda i: _grid_at(i, n, sampling, base))


def value_at(q: Column, values: Column, sampling: str = "linear", base: float = 10) -> Column:
    """Its inverse.  The place of a quantile in the grid follows from its formula, so nothing is searched."""
    n = F.size(values)

    def line(q: Column, at: Column) -> Column:
        g0, g1 = _grid_at(at, n, sampling, base), _grid_at(at + 1, n, sampling, base)
        y0, y1 = F.get(values, at), F.get(values, at + 1)
        return F.when(q.isNull() | values.isNull(), None).when(q >= 1, F.get(values, n - 1)).when((q <= 0) | (n < 2), F.get(values, F.lit(0))).otherwise(y0 + (q - g0) * (y1 - y0) / (g1 - g0))

    # rounding may give the part beside the right one, whose line meets it where both end
    part = lambda q: F.greatest(F.lit(0), F.least(n - 2, F.floor(_share_of(q, sampling, base) * (n - 1)).cast("int")))
    return bound(q, lambda q: bound(part(q), lambda at: line(q, at)))


def _dense(x: Column, base: float) -> Column:
    return (F.pow(F.lit(float(base)), x) - 1) / (base - 1)


def _grid_at(i: Column, n: Column, sampling: str, base: float) -> Column:
    """The i-th of ``grid(n)``, counted from 0."""
    kind, even = sampling.casefold(), i / F.greatest(n - 1, F.lit(1))
    if kind == "linear":
        return even
    if kind not in ("log", "invlog"):
        raise KeyError(f"unknown sampling: {sampling}")
    return _dense(even, base) if kind == "log" else 1 - _dense(1 - even, base)


def _share_of(q: Column, sampling: str, base: float) -> Column:
    """How far along the grid a quantile lies, from 0 to 1."""
    kind = sampling.casefold()
    if kind == "linear":
        return q
    inverse = lambda x: F.log(1 + x * (base - 1)) / F.lit(math.log(base))
    return inverse(q) if kind == "log" else 1 - inverse(1 - q)


#: Numbers of shape parameters of the distributions in closed form.
SHAPES = {"uniform": 0, "expon": 0, "weibull_min": 1, "gumbel_r": 0, "logistic": 0}


def _parameters(p: Sequence[Column | float]) -> list[Column]:
    return [x if isinstance(x, Column) else F.lit(float(x)) for x in p]


def parameters_of(name: str, values: Column) -> list[Column]:
    """The parameters of a distribution from an array: shape, if it has one, place, scale."""
    if name not in SHAPES:
        raise KeyError(f"unknown distribution: {name}")
    return [F.get(values, F.lit(i)) for i in range(SHAPES[name] + 2)]


def parametric_cdf(name: str, x: Column, *p: Column | float) -> Column:
    """Distribution functions in closed form; the last two parameters are place and scale."""
    *shape, loc, scale = _parameters(p)
    z = (x - loc) / scale
    forms = {
        "uniform": lambda: F.greatest(F.lit(0.0), F.least(F.lit(1.0), z)),
        "expon": lambda: F.when(z < 0, 0.0).otherwise(1 - F.exp(-z)),
        "weibull_min": lambda: F.when(z <= 0, 0.0).otherwise(1 - F.exp(-F.pow(F.greatest(z, F.lit(0.0)), shape[0]))),
        "gumbel_r": lambda: F.exp(-F.exp(-z)),
        "logistic": lambda: 1 / (1 + F.exp(-z)),
    }
    if name not in forms:
        raise KeyError(f"unknown distribution: {name}")
    return forms[name]()


def _log(x: Column) -> Column:
    """The logarithm with its limits: Spark's own is null at 0 and below."""
    return F.when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan)).otherwise(F.log(x))


def parametric_ppf(name: str, q: Column, *p: Column | float) -> Column:
    """Their inverses; at quantiles 0 and 1 the ends of the distribution, which may be infinite."""
    *shape, loc, scale = _parameters(p)
    forms = {
        "uniform": lambda: q,
        "expon": lambda: -_log(1 - q),
        "weibull_min": lambda: F.pow(-_log(1 - q), 1 / shape[0]),
        "gumbel_r": lambda: -_log(-_log(q)),
        "logistic": lambda: F.when(q == 1, F.lit(math.inf)).otherwise(_log(q / (1 - q))),
    }
    if name not in forms:
        raise KeyError(f"unknown distribution: {name}")
    return forms[name]() * scale + loc


def delta_mapping(
    x: Column, observed: Column, modelled: Column, future: Column | None = None, relative: bool = True, sampling: str = "linear", base: float = 10, denominator_min: float | None = None, denominator_zero: float | None = None, delta_range: tuple[float, float] | None = None, dist: str = "empirical"
) -> Column:
    """Quantile delta mapping.

    Distributions are arrays: values at the quantile grid if empirical, else the
    parameters of ``dist``.  The modelled one stands in for a future that is not given.
    """
    future = modelled if future is None else F.coalesce(future, modelled)
    if dist == "empirical":
        q = quantile_of(x, future, sampling, base)
        at = lambda q, values: value_at(q, values, sampling, base)
    else:
        q = parametric_cdf(dist, x, *parameters_of(dist, future))
        at = lambda q, values: parametric_ppf(dist, q, *parameters_of(dist, values))

    def shifted(both: Column) -> Column:
        target, model = both["target"], both["model"]
        if relative:
            if denominator_zero is not None:
                model = F.when(model == 0, float(denominator_zero)).otherwise(model)
            if denominator_min is not None:
                model = F.greatest(model, F.lit(float(denominator_min)))
            delta = F.try_divide(x, model)
        else:
            delta = x - model
        if delta_range is not None:
            delta = F.greatest(F.lit(float(min(delta_range))), F.least(F.lit(float(max(delta_range))), delta))
        return target * delta if relative else target + delta

    both = bound(q, lambda q: F.struct(at(q, observed).alias("target"), at(q, modelled).alias("model")))
    return bound(both, shifted)


def mapped_wind(x: Column, observed: Column, modelled: Column, future: Column | None = None, **options) -> Column:
    """Wind speeds: zeros are mapped as 0.01 and stay zero, nothing falls below 0."""
    out = delta_mapping(F.when(x == 0, 0.01).otherwise(x), observed, modelled, future, **options)
    return F.when(x == 0, 0.0).otherwise(F.greatest(F.lit(0.0), out))


def mapped_irradiance(ghi: Column, dni: Column, ghi_knots: tuple[Column, Column, Column], dni_knots: tuple[Column, Column, Column], **options) -> tuple[Column, Column]:
    """ghi and dni each by its own mapping; zeros are mapped as 1.  Store both before ``irradiance.corrected`` makes dhi of them."""
    return tuple(delta_mapping(F.when(x == 0, 1.0).otherwise(x), *k, **options) for x, k in ((ghi, ghi_knots), (dni, dni_knots)))


def random_from(values: Column, seed: int, sampling: str = "linear", base: float = 10) -> Column:
    """Draws from an empirical distribution."""
    return value_at(F.rand(seed), values, sampling, base)
