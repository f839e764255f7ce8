"""Derived datasets whose formula needs the whole selection, and site-wise corrections."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeolith.errors import ExtrapolationWarning, ResourceWarning
from aeolith.functions import heights, irradiance, quantiles, units
from aeolith.functions.scaling import clean
from aeolith.sources.catalog import Catalog, ResourceSpec, parse_name

from . import selection


def with_roughness(facts: DataFrame, meta: DataFrame | None) -> DataFrame:
    """facts with roughness_length: a dataset of their own, or else z0 of their sites."""
    if "roughness_length" in facts.columns or meta is None or "z0" not in meta.columns:
        return facts
    return facts.join(meta.select("gid", F.col("z0").cast("double").alias("roughness_length")), "gid", "left")


def with_dataset(facts: DataFrame, name: str, spec: ResourceSpec, per: str = "selection", meta: DataFrame | None = None, check: bool = False) -> DataFrame:
    """facts with a stored or derived dataset of that name.

    The exponent of the power law comes from the means of the whole selection, of
    each site or of each row; a selection's is one row, joined by broadcast.  The
    surface layer takes roughness from the facts, or else from z0 in ``meta``.  With
    ``check`` exponents of a selection or of sites are computed at once, and a warning
    tells how many lie outside the bounds that hold for rows.
    """
    if name in facts.columns:
        return facts
    if meta is not None and name.startswith("windspeed_") and "inversemoninobukhovlength_2m" in facts.columns:
        rough = with_roughness(facts, meta)
        if rough is not facts:
            return with_dataset(rough, name, spec, per, None, check).drop("roughness_length")
    catalog = Catalog.of(facts, spec)
    variable, height = parse_name(name, spec.unit)
    known = catalog.heights().get(variable, {})
    if variable == "windspeed" and height is not None and len(known) > 1 and per != "row":
        (low, high), outside = catalog.nearest(variable, height)
        layer = height < low and {"inversemoninobukhovlength_2m", "roughness_length"} <= set(facts.columns)
        if outside and not layer:
            a, b = F.col(known[low]), F.col(known[high])
            keys = ["gid"] if per == "site" else []
            means = facts.groupBy(*keys).agg(F.avg(clean(a.cast("double"))).alias("__low"), F.avg(clean(b.cast("double"))).alias("__high"))
            exponents = means.select(*keys, heights.shear_exponent(F.col("__low"), low, F.col("__high"), high).alias("__alpha"))
            if check:
                strange = exponents.where(~F.col("__alpha").between(*heights.SHEAR_BOUNDS)).count()
                if strange:
                    warnings.warn(f"{strange} shear exponents of {name} are outside {heights.SHEAR_BOUNDS}", ExtrapolationWarning, stacklevel=2)
            joined = facts.join(exponents, "gid") if keys else facts.join(F.broadcast(exponents))
            return joined.withColumn(name, catalog.column(name, per, F.col("__alpha"))).drop("__alpha")
    return facts.withColumn(name, catalog.column(name, per))


def at_site_heights(facts: DataFrame, variable: str, heights_by_site: DataFrame, spec: ResourceSpec, alias: str) -> DataFrame:
    """The variable at a height of each site's own, from (gid, height), by one expression over the stored heights.

    Heights count as in ``Catalog.column`` with ``per="row"``; a null height gives null.
    Sites without a height go.
    """
    return all_at_site_heights(facts, {alias: variable}, heights_by_site, spec)


def all_at_site_heights(facts: DataFrame, variables: dict[str, str], heights_by_site: DataFrame, spec: ResourceSpec) -> DataFrame:
    """at_site_heights() of several variables, by their new names, with one join."""
    height = F.col("__height")
    new = {alias: F.when(height.isNotNull(), _at_height(facts, variable, height, spec)) for alias, variable in variables.items()}
    out = facts.join(heights_by_site.select("gid", F.col("height").cast("double").alias("__height")), "gid")
    return out.withColumns(new).drop("__height")


def _at_height(facts: DataFrame, variable: str, height: Column, spec: ResourceSpec) -> Column:
    catalog = Catalog.of(facts, spec)
    known = catalog.heights().get(variable, {})
    levels = sorted(known)
    if len(levels) < 2:
        if len(levels) == 1 and spec.lapse and variable in heights.LAPSE_RATES:
            value = F.when(height == levels[0], F.col(f"`{known[levels[0]]}`")).otherwise(heights.lapse(F.col(f"`{known[levels[0]]}`"), levels[0], height, variable))
        else:
            value = catalog.column(f"{variable}_{levels[0] if levels else 0:g}{spec.unit}", per="row")
    else:
        value = F.lit(None)
        for i in reversed(range(len(levels) - 1)):
            between = _between(variable, levels[i], levels[i + 1], known, height, levels, facts.columns)
            # the two nearest heights, of equally near ones the lower
            last = i + 2 == len(levels)
            value = between if last else F.when(F.abs(height - levels[i]) <= F.abs(height - levels[i + 2]), between).otherwise(value)
        for level in levels:
            value = F.when(height == level, F.col(f"`{known[level]}`")).otherwise(value)
    return value


def _between(variable: str, low: float, high: float, known: dict[float, str], height: Column, levels: list[float], columns: Sequence[str]) -> Column:
    a, b = F.col(f"`{known[low]}`"), F.col(f"`{known[high]}`")
    if variable == "winddirection":
        return heights.circular(a, low, b, high, height)
    inside = heights.linear(a, low, b, high, height)
    if variable != "windspeed":
        return inside
    beyond = heights.power_law_by_row(a, low, b, high, height)
    if {"inversemoninobukhovlength_2m", "roughness_length"} <= set(columns):
        layer = heights.monin_obukhov(a, low, height, F.col("roughness_length"), F.col("inversemoninobukhovlength_2m"))
        beyond = F.when(height < low, layer).otherwise(beyond)
    return F.when((height < levels[0]) | (height > levels[-1]), beyond).otherwise(inside)


def in_model_units(facts: DataFrame, variables: Sequence[str], technology: str, check: bool = False) -> DataFrame:
    """Units by the median and least value of the selection, then valid ranges.

    Whether the median exceeds a limit follows from counts and the values next to the
    limit: one aggregated row, joined by broadcast.  With ``check`` values outside their
    ranges are counted at once, and a warning tells of each variable that has some.
    """
    marks: dict[str, Column] = {}
    values, strange = {}, []
    for i, v in enumerate(variables):

        def above(limit: float, v: str = v, i: int = i) -> Column:
            name = f"__above_{i}_{limit:g}"
            marks[name] = selection.median_above(F.col(v), limit).alias(name)
            return F.col(name)

        marks[f"__least_{i}"] = F.min(v).alias(f"__least_{i}")
        base = parse_name(v)[0]
        value = units.normalised(F.col(v), base, technology, above, F.col(f"__least_{i}"))
        values[v] = units.clamped(value, base, technology)
        outside = value != values[v]
        strange += [F.count_if(outside).alias(f"n_{i}"), F.count_distinct(F.when(outside, F.col("gid"))).alias(f"sites_{i}"), F.min(value).alias(f"low_{i}"), F.max(value).alias(f"high_{i}")]
    marked = facts.join(F.broadcast(facts.agg(*marks.values())))
    if check and strange:
        r = marked.agg(*strange).first()
        for i, v in enumerate(variables):
            if r[f"n_{i}"]:
                warnings.warn(f"{r[f'n_{i}']} values of {v} at {r[f'sites_{i}']} sites are outside the range of {technology}: {r[f'low_{i}']} to {r[f'high_{i}']}", ResourceWarning, stacklevel=2)
    return marked.withColumns(values).drop(*marks)


def with_factors(facts: DataFrame, factors: DataFrame, columns: Sequence[str]) -> DataFrame:
    """facts left-joined with columns of a table of sites; a column of the same name gives way."""
    table = factors.select("gid", *[F.col(c).alias(f"__{c}") for c in columns])
    return facts.join(table, "gid", "left")


def linear_wind_bias(facts: DataFrame, factors: DataFrame, dataset: str) -> DataFrame:
    """Sites without factors keep their values."""
    joined = with_factors(facts, factors, ["scalar", "adder"])
    new = irradiance.linear_wind_correction(F.col(dataset), F.col("__scalar"), F.col("__adder"))
    return joined.withColumn(dataset, F.when(F.col("__scalar").isNull(), F.col(dataset)).otherwise(new)).drop("__scalar", "__adder")


def linear_irradiance_bias(facts: DataFrame, factors: DataFrame) -> DataFrame:
    joined = with_factors(facts, factors, ["scalar", "adder"])
    new = irradiance.linear_correction(F.col("ghi"), F.col("dni"), F.col("dhi"), F.col("__scalar"), F.col("__adder"))
    kept = {c: F.when(F.col("__scalar").isNull(), F.col(c)).otherwise(x) for c, x in new.items()}
    return joined.withColumns(kept).drop("__scalar", "__adder")


def mapped_wind_bias(facts: DataFrame, table: DataFrame, dataset: str, **options) -> DataFrame:
    """Quantile delta mapping by site with params_oh, params_mh and, if given, params_mf, arrays or their JSON."""
    names = [n for n in ("params_oh", "params_mh", "params_mf") if n != "params_mf" or n in table.columns]
    joined = with_factors(facts, parsed(table, names), names)
    new = quantiles.mapped_wind(F.col(dataset).cast("double"), *[F.col(f"__{n}") for n in names], **options)
    return joined.withColumn(dataset, F.when(F.col("__params_oh").isNull(), F.col(dataset)).otherwise(new)).drop(*[f"__{n}" for n in names])


def mapped_irradiance_bias(facts: DataFrame, table: DataFrame, **options) -> DataFrame:
    names = [f"{v}_params_{p}" for v in ("ghi", "dni") for p in ("oh", "mh", "mf")]
    joined = with_factors(facts, parsed(table, names), names)
    k = [F.col(f"__{n}") for n in names]
    # one column for each mapping: inside a larger expression Spark gives its lambda variables wrong values
    both = quantiles.mapped_irradiance(F.col("ghi"), F.col("dni"), tuple(k[:3]), tuple(k[3:]), **options)
    joined = joined.withColumns({"__g": both[0], "__d": both[1]})
    new = irradiance.corrected(F.col("ghi"), F.col("dni"), F.col("dhi"), F.col("__g"), F.col("__d"))
    kept = {c: F.when(F.col(f"__{names[0]}").isNull(), F.col(c)).otherwise(x) for c, x in new.items()}
    return joined.withColumns(kept).drop("__g", "__d", *[f"__{n}" for n in names])


def parsed(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """JSON lists as arrays."""
    kinds = dict(table.dtypes)
    return table.withColumns({c: F.from_json(c, "array<double>") for c in columns if kinds.get(c) == "string"})


#: Corrections by name: facts and a table of sites to facts.
CORRECTIONS = {"linear_wind": linear_wind_bias, "linear_irradiance": linear_irradiance_bias, "mapped_wind": mapped_wind_bias, "mapped_irradiance": mapped_irradiance_bias}


def bias_corrected(facts: DataFrame, table: DataFrame, method: str | Callable[..., DataFrame], means: Sequence[str] = (), check: bool = False, **options) -> tuple[DataFrame, DataFrame | None]:
    """(facts corrected by a table of sites, the sites' means of some datasets after that).

    ``method`` is a name of ``CORRECTIONS`` or a function of facts, table and options.
    Sites that the table lacks keep their values; with ``check`` they are counted, and a
    warning tells how many there are.
    """
    if isinstance(method, str) and method not in CORRECTIONS:
        raise KeyError(f"unknown correction: {method}")
    if check:
        lone = facts.select("gid").distinct().join(table.select("gid"), "gid", "left_anti").count()
        if lone:
            warnings.warn(f"{lone} sites have no bias factors and stay as they are", ResourceWarning, stacklevel=2)
    out = (CORRECTIONS[method] if isinstance(method, str) else method)(facts, table, **options)
    after = out.groupBy("gid").agg(*[F.avg(clean(F.col(m).cast("double"))).alias(f"{m}_mean") for m in means]) if means else None
    return out, after


def curtail(facts: DataFrame, shares: DataFrame, dataset: str) -> DataFrame:
    """Wind speed times a share by time, or by time and site."""
    keys = ["gid", "ts"] if "gid" in shares.columns else ["ts"]
    joined = facts.join(shares.select(*keys, F.col("share").alias("__share")), keys, "left")
    return joined.withColumn(dataset, units.curtailed(F.col(dataset), F.coalesce("__share", F.lit(1.0)))).drop("__share")
