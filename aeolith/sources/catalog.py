"""What a table of time series holds: names, heights, attributes."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeolith.errors import ExtrapolationWarning, ResourceKeyError, ResourceValueError, ResourceWarning
from aeolith.functions import heights as H

#: Columns that index the facts, and so are no dataset.
INDEX = ("gid", "ts", "t_idx", "year", "latitude", "longitude", "timezone", "elevation", "country", "state", "county")


@dataclass(frozen=True)
class ResourceSpec:
    """How a kind of data names its attributes, and which variables change with height."""

    name: str
    scale_attributes: tuple[str, ...] = ("scale_factor",)
    adder_attributes: tuple[str, ...] = ("add_offset",)
    unit_attributes: tuple[str, ...] = ("units",)
    by_height: tuple[str, ...] = ()
    unit: str = "m"
    lapse: bool = True

    def attribute(self, attributes: dict[str, object], names: Sequence[str], default: object) -> object:
        """The first of several attribute names that is there."""
        return next((attributes[n] for n in names if n in attributes), default)

    def scale(self, attributes: dict[str, object]) -> float:
        return float(self.attribute(attributes, self.scale_attributes, 1))

    def adder(self, attributes: dict[str, object]) -> float:
        return float(self.attribute(attributes, self.adder_attributes, 0))

    def units(self, attributes: dict[str, object]) -> str | None:
        return self.attribute(attributes, self.unit_attributes, None)


GENERIC = ResourceSpec("generic")
SOLAR = ResourceSpec("solar", ("scale_factor", "psm_scale_factor"), ("add_offset", "psm_add_offset"), ("units", "psm_units"), ("temperature", "windspeed"))
WIND = ResourceSpec("wind", by_height=("temperature", "pressure", "windspeed", "winddirection"))
WAVE = ResourceSpec("wave")
GEOTHERMAL = ResourceSpec("geothermal", by_height=("temperature", "potential_MW"), lapse=False)
PRESETS = {s.name: s for s in (GENERIC, SOLAR, WIND, WAVE, GEOTHERMAL)}


def parse_name(name: str, unit: str = "m") -> tuple[str, float | None]:
    """(variable, height) of a name such as windspeed_100m; without height: (name, None)."""
    found = re.fullmatch(rf"(.+?)_(-?\d+(?:\.\d+)?){unit}", name)
    return (found[1], float(found[2])) if found else (name, None)


@dataclass(frozen=True)
class Catalog:
    """The datasets of a frame of facts."""

    columns: tuple[str, ...]
    spec: ResourceSpec = GENERIC
    attributes: dict[str, dict[str, object]] = field(default_factory=dict)

    @classmethod
    def of(cls, facts: DataFrame, spec: ResourceSpec = GENERIC, attributes: dict[str, dict[str, object]] | None = None) -> Catalog:
        stored = {f.name: dict(f.metadata) for f in facts.schema.fields if f.metadata}
        return cls(tuple(facts.columns), spec, {**stored, **(attributes or {})})

    @property
    def datasets(self) -> list[str]:
        return [c for c in self.columns if c not in INDEX]

    def in_group(self, group: str) -> Catalog:
        """Names below a group, without its prefix."""
        prefix = group.rstrip("/") + "/"
        return replace(self, columns=tuple(c.removeprefix(prefix) for c in self.columns if c in INDEX or c.startswith(prefix)))

    @property
    def groups(self) -> list[str]:
        return sorted({c.rsplit("/", 1)[0] for c in self.columns if "/" in c})

    def heights(self) -> dict[str, dict[float, str]]:
        """For each variable its heights and the names as they are spelled."""
        out: dict[str, dict[float, str]] = {}
        for name in self.datasets:
            variable, height = parse_name(name, self.spec.unit)
            if height is not None:
                out.setdefault(variable, {})[height] = name
        return out

    def nearest(self, variable: str, height: float) -> tuple[list[float], bool]:
        """The two nearest heights in order, and whether the height lies outside all."""
        known = sorted(self.heights().get(variable, {}))
        if not known:
            raise ResourceKeyError(f"{variable} has no heights")
        outside = not known[0] <= height <= known[-1]
        if outside and len(known) > 1:
            warnings.warn(f"{height} is outside the heights of {variable}: {known}", ExtrapolationWarning, stacklevel=2)
        return sorted(sorted(known, key=lambda h: (abs(h - height), h))[:2]), outside

    def properties(self, name: str) -> dict[str, object]:
        """Attributes of a dataset, of the nearest height where the name is derived."""
        if name in self.columns:
            return self.attributes.get(name, {})
        variable, height = parse_name(name, self.spec.unit)
        if variable in self.columns:
            return self.attributes.get(variable, {})
        known = self.heights().get(variable)
        if known and height is not None:
            return self.attributes.get(known[min(known, key=lambda h: abs(h - height))], {})
        raise ResourceKeyError(name)

    def column(self, name: str, per: str = "selection", alpha: Column | None = None, forced_height: float | None = None) -> Column:
        """The column of a stored or derived dataset.

        Order: the name itself; the variable without heights; the height as stored;
        one stored height (lapse rate if the variable has one, else as it is, with a
        warning); otherwise between or beyond heights.  Wind speed below the heights
        follows the surface layer where roughness and stability are known and the
        power law elsewhere, above them the power law, inside them a line.
        """
        if name in self.columns:
            return F.col(f"`{name}`")
        variable, height = parse_name(name, self.spec.unit)
        known = self.heights().get(variable)
        if not known:
            if variable in self.columns:
                return F.col(f"`{variable}`")
            raise ResourceKeyError(name)
        if height is None:
            raise ResourceKeyError(name)
        if forced_height is not None:
            height = forced_height
        if height in known:
            return F.col(f"`{known[height]}`")
        if len(known) == 1:
            (only, column), *_ = known.items()
            if self.spec.lapse and variable in H.LAPSE_RATES:
                return H.lapse(F.col(f"`{column}`"), only, height, variable)
            warnings.warn(f"{variable} has one height, {only}; it is used for {height}", ResourceWarning, stacklevel=2)
            return F.col(f"`{column}`")
        (low, high), outside = self.nearest(variable, height)
        a, b = F.col(f"`{known[low]}`"), F.col(f"`{known[high]}`")
        if variable == "winddirection":
            return H.circular(a, low, b, high, height)
        if variable == "windspeed" and outside:
            if height < low and {"inversemoninobukhovlength_2m", "roughness_length"} <= set(self.columns):
                return H.monin_obukhov(a, low, height, F.col("roughness_length"), F.col("inversemoninobukhovlength_2m"))
            if per == "row":
                return H.power_law_by_row(a, low, b, high, height)
            if alpha is None:
                raise ResourceValueError("the exponent of a selection is an aggregate: use operators.derive.with_dataset")
            return H.power_law(a, low, alpha, height)
        return H.linear(a, low, b, high, height)

    def wind_height(self, height: float) -> float:
        """The hub height: the only height of wind speed where there is but one."""
        known = list(self.heights().get("windspeed", {}))
        if len(known) == 1 and known[0] != height:
            warnings.warn(f"wind speed has the height {known[0]} alone", ResourceWarning, stacklevel=2)
            return known[0]
        return height


def coordinate_columns(columns: Iterable[str]) -> tuple[str, str]:
    """The latitude and longitude columns, in any case; none or several are an error."""
    found = []
    for names in (("lat", "latitude"), ("lon", "long", "longitude")):
        hits = [c for c in columns if c.lower() in names]
        if len(hits) != 1:
            raise ResourceKeyError(f"one column of {names} is needed, found {hits}")
        found.append(hits[0])
    return found[0], found[1]


def describe(facts: DataFrame, spec: ResourceSpec = GENERIC) -> DataFrame:
    """One row a dataset: its type, scale, adder, units and other attributes as JSON."""
    import json

    catalog = Catalog.of(facts, spec)
    kinds = dict(facts.dtypes)
    rows = [(d, kinds[d], spec.scale(catalog.attributes.get(d, {})), spec.adder(catalog.attributes.get(d, {})), spec.units(catalog.attributes.get(d, {})), json.dumps(catalog.attributes.get(d, {}), sort_keys=True)) for d in catalog.datasets]
    return facts.sparkSession.createDataFrame(rows, "dataset string, dtype string, scale_factor double, adder double, units string, attributes string")
