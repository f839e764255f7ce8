"""Labelled datasets over files: variables by site and time, by site or by time alone, with coordinates and attributes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolith.errors import ResourceKeyError, ResourceRuntimeError

from .catalog import GENERIC, ResourceSpec, coordinate_columns
from .scan import normalised

KEYS = ("gid", "ts")


class Variable(NamedTuple):
    """``table`` has the columns ``dims`` and the values; attributes are those on which its files agree."""

    dims: tuple[str, ...]
    kind: str
    attributes: dict[str, object]
    table: DataFrame


class Labelled:
    """Variables by name.  Plans are only put together here: nothing is read before a result is asked for."""

    def __init__(self, variables: dict[str, Variable], coordinates: DataFrame | None = None):
        self.variables, self.coordinates = variables, coordinates

    def __getitem__(self, name: str) -> DataFrame:
        return self.variable(name).table

    def variable(self, name: str) -> Variable:
        if name not in self.variables:
            raise ResourceKeyError(f"{name} is not in {sorted(self.variables)}")
        return self.variables[name]

    def table(self, *names: str, coordinates: bool = False) -> DataFrame:
        """Variables side by side by all their dimensions: one by site or time alone repeats along the others.

        Those of most dimensions come first and set the rows; variables by site only and by
        time only, without one of both, are an error.
        """
        order = sorted(names, key=lambda n: -len(self.variable(n).dims))
        dims = self.variable(order[0]).dims
        if any(not set(self.variable(n).dims) <= set(dims) for n in order):
            raise ResourceRuntimeError(f"{list(names)} share no dimensions")
        out = reduce(lambda a, n: a.join(self[n], list(self.variable(n).dims), "full" if self.variable(n).dims == dims else "left"), order[1:], self[order[0]])
        if coordinates:
            if self.coordinates is None or "gid" not in dims:
                raise ResourceKeyError("no coordinates of these variables")
            out = out.join(self.coordinates, "gid", "left")
        return out.select(*dims, *names, *([c for c in self.coordinates.columns if c != "gid"] if coordinates else []))


def _same_attributes(name: str, files: Sequence[tuple[str, dict[str, object]]], ignored: Sequence[str]) -> dict[str, object]:
    """What the files say of a variable, without how each stores it; files that say different things are an error."""
    out: dict[str, tuple[object, str]] = {}
    for path, attributes in files:
        for key, value in attributes.items():
            if key in ignored:
                continue
            known, where = out.setdefault(key, (value, path))
            if known != value:
                raise ResourceRuntimeError(f"{key} of {name} is {known!r} in {where} and {value!r} in {path}")
    return {k: v for k, (v, _) in out.items()}


def open_files(spark: SparkSession, paths: Sequence[str], spec: ResourceSpec = GENERIC, meta: DataFrame | None = None) -> Labelled:
    """The variables of all files as one labelled dataset.

    The key columns of a file tell the dimensions of its variables.  Each file's values
    are unscaled by its own attributes, which its footer holds, so files may store one
    variable differently; other attributes, and dimensions, must agree.  Several files
    of a variable are parts of it: their rows are put together.
    """
    found: dict[str, list[tuple[str, tuple[str, ...], str, dict[str, object], DataFrame]]] = {}
    for path in paths:
        raw = spark.read.parquet(path)
        dims = tuple(k for k in KEYS if k in raw.columns)
        if not dims:
            raise ResourceRuntimeError(f"{path} has neither sites nor times")
        physical = normalised(raw, spec)
        for field in raw.schema.fields:
            if field.name not in (*KEYS, "t_idx", "year"):
                found.setdefault(field.name, []).append((path, dims, physical.schema[field.name].dataType.simpleString(), dict(field.metadata), physical.select(*dims, field.name)))
    storage = {*spec.scale_attributes, *spec.adder_attributes, "chunks", "dtype", "fill_value"}
    variables = {}
    for name, parts in found.items():
        dims, kinds = {p[1] for p in parts}, {p[2] for p in parts}
        if len(dims) > 1:
            raise ResourceRuntimeError(f"{name} has dimensions {sorted(dims)}")
        attributes = _same_attributes(name, [(p[0], p[3]) for p in parts], storage)
        # whole numbers beside fractions: values are what they are, the type is the wider
        kind = kinds.pop() if len(kinds) == 1 else "double"
        tables = [p[4].select(*p[1], F.col(name).cast(kind).alias(name, metadata=attributes)) for p in parts]
        variables[name] = Variable(parts[0][1], kind, attributes, reduce(DataFrame.unionByName, tables))
    coordinates = None
    if meta is not None:
        coordinates = meta.select("gid", *[F.col(c).alias(n) for c, n in zip(coordinate_columns(meta.columns), ("latitude", "longitude"), strict=True)])
    return Labelled(variables, coordinates)

