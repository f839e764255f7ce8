"""Input tables of site models: variables resolved, rolled to local time, in model units and ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeolith.errors import ResourceKeyError
from aeolith.functions import irradiance, solar, units
from aeolith.operators.derive import all_at_site_heights, in_model_units, with_dataset
from aeolith.operators.ordered import roll_to_local
from aeolith.operators.spatial import with_low_resolution
from aeolith.sources.catalog import INDEX, PRESETS, Catalog, ResourceSpec
from aeolith.sources.scan import by_dataset

#: Variables each kind of model needs.
VARIABLES = {
    "pv": ("dni", "dhi", "ghi", "wind_speed", "air_temperature"),
    "csp": ("dni", "dhi", "ghi", "wind_speed", "air_temperature", "dew_point", "surface_pressure"),
    "windpower": ("temperature", "pressure", "windspeed", "winddirection"),
    "geothermal": ("temperature", "potential_MW"),
    "wave": ("significant_wave_height", "energy_period"),
}
#: Names of the columns in the tables.
TITLES = {
    "dni": "DNI", "dhi": "DHI", "ghi": "GHI", "wind_speed": "Wind Speed", "air_temperature": "Temperature", "temperature": "Temperature", "pressure": "Pressure",
    "windspeed": "Speed", "winddirection": "Direction", "significant_wave_height": "wave_height", "energy_period": "wave_period", "surface_albedo": "Surface Albedo",
}


def resolve(facts: DataFrame, variable: str, spec: ResourceSpec, height: float | None = None, clearsky: bool = False) -> DataFrame:
    """facts with ``variable``: by its name, its alias, or either at a height."""
    wanted = [f"clearsky_{variable}"] if clearsky and variable in ("dni", "dhi", "ghi") else [variable, units.ALIASES.get(variable, variable)]
    names = [*wanted, *([f"{w}_{height:g}{spec.unit}" for w in wanted] if height is not None else [])]
    for name in names:
        if name in facts.columns:
            return facts if name == variable else facts.withColumn(variable, F.col(f"`{name}`"))
    for name in names[len(wanted) :]:
        try:
            found = with_dataset(facts, name, spec)
        except ResourceKeyError:
            continue
        return found.withColumn(variable, F.col(f"`{name}`"))
    raise ResourceKeyError(f"{variable} is not among the data")


def loaded(facts: DataFrame, technology: str, spec: ResourceSpec | None = None, height: float | None = None, clearsky: bool = False, bifacial: bool = False, wind_direction: bool = True, extra: Sequence[str] = (), meta: DataFrame | None = None, heights_by_site: DataFrame | None = None, precipitation: bool = False, icing: bool = False, check: bool = False) -> DataFrame:
    """gid, ts and the variables of a technology in its units and ranges.

    One of dni, dhi and ghi may be missing where ``meta`` gives coordinates.
    ``heights_by_site`` (gid, height) takes the place of ``height`` where hub heights
    or depths differ; sites that it lacks go.  Wind models may have precipitationrate
    and, for icing, rh.  ``check`` warns of values outside their ranges.
    """
    base = "windpower" if technology in ("wind", "windpower") else technology if technology in VARIABLES else "csp" if technology in units.MILLIBAR else "pv"
    spec = spec or PRESETS[{"windpower": "wind", "wave": "wave", "geothermal": "geothermal"}.get(base, "solar")]
    names = [v for v in VARIABLES[base] if v != "winddirection" or wind_direction] + (["surface_albedo"] if bifacial else []) + list(extra)
    if height is not None and base == "windpower":
        height = Catalog.of(facts, spec).wind_height(height)
    out, missing, fixed = facts, [], {"precipitationrate": "precipitationrate_0m"} if precipitation else {}
    if icing:
        fixed["rh"] = "relativehumidity_2m"
    for v, stored in fixed.items():
        if stored not in facts.columns:
            raise ResourceKeyError(f"{stored} is not among the data")
        out = out.withColumn(v, F.col(stored))
    if heights_by_site is not None:
        known = Catalog.of(facts, spec).heights()
        out = all_at_site_heights(out, {v: v for v in names if v in known and v not in facts.columns}, heights_by_site, spec)
    names += fixed
    for v in names:
        try:
            out = resolve(out, v, spec, height, clearsky)
        except ResourceKeyError:
            if v not in ("dni", "dhi", "ghi") or meta is None:
                raise
            missing.append(v)
    if missing:
        parts = {v: None if v in missing else F.col(v) for v in ("ghi", "dni", "dhi")}
        out = out.join(meta.select("gid", "latitude", "longitude"), "gid")
        zenith = solar.zenith(F.col("ts"), F.col("latitude"), F.col("longitude"))
        out = out.withColumns(irradiance.fill_missing(parts["ghi"], parts["dni"], parts["dhi"], zenith))
    return in_model_units(out.select("gid", "ts", *(["t_idx"] if "t_idx" in facts.columns else []), *names), names, technology, check)


def loaded_files(parts: Sequence[DataFrame], technology: str, check: bool = False, **options) -> DataFrame:
    """loaded() from files that hold different datasets of the same sites and times."""
    return loaded(by_dataset(parts, check), technology, **options)


def loaded_resolutions(facts: DataFrame, sites: DataFrame, low: DataFrame, low_sites: DataFrame, technology: str, **options) -> DataFrame:
    """loaded() with the datasets that only a coarser source has, from its nearest site, interpolated in time."""
    more = [c for c in low.columns if c not in (*facts.columns, *INDEX)]
    return loaded(with_low_resolution(facts, sites, low, low_sites, more), technology, **options)


def means(table: DataFrame) -> DataFrame:
    """Mean of each variable and site; irradiance also as daily sums."""
    names = [c for c in table.columns if c not in ("gid", "ts", "t_idx")]
    out = table.groupBy("gid").agg(*[F.avg(c).alias(c) for c in names])
    return out.withColumns({f"{c}_daily": irradiance.daily_irradiation(F.col(c)) for c in names if c in ("dni", "dhi", "ghi")})


def with_heights(meta: DataFrame, heights: float | DataFrame) -> DataFrame:
    """Metadata of the sites of a model with their height: one for all, or by (gid, height)."""
    if isinstance(heights, DataFrame):
        return meta.drop("height").join(heights.select("gid", "height"), "gid", "left")
    return meta.withColumn("height", F.lit(float(heights)))


def wind_titles(table: DataFrame, height: float) -> DataFrame:
    """site_table() of a wind model with the height in the names of its columns."""
    names = {"Pressure": f"Pressure {height:g}m", "Temperature": f"Temperature {height:g}m", "Speed": f"Wind Speed {height:g}m", "Direction": f"Wind Direction {height:g}m", "rh": "Relative Humidity 2m"}
    return table.withColumnsRenamed({a: b for a, b in names.items() if a in table.columns})


def wind_heads(table: DataFrame, height: float, units_of: dict[str, str]) -> list[list[str]]:
    """The two rows above the values of a wind file: the unit of each column (of a time's, its name) and the height."""
    columns = [c for c in table.columns if c not in ("gid", "ts")]
    return [[units_of.get(c, c.lower()) for c in columns], [f"{height:g}"] * len(columns)]


def site_table(table: DataFrame, timezones: DataFrame | None = None, steps_per_hour: int = 1, time_columns: bool = True) -> DataFrame:
    """The table as models read it: values rolled to local time (where ``t_idx`` is there), time in columns."""
    names = [c for c in table.columns if c not in ("gid", "ts", "t_idx")]
    if timezones is not None:
        table = roll_to_local(table, names, timezones, steps_per_hour)
    time = [F.year("ts").alias("Year"), F.month("ts").alias("Month"), F.day("ts").alias("Day"), F.hour("ts").alias("Hour"), F.minute("ts").alias("Minute")] if time_columns else []
    return table.select("gid", "ts", *time, *[F.col(v).alias(TITLES.get(v, v)) for v in names])
