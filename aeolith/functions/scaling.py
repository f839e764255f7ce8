"""Stored integers to physical values and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, IntegralType, LongType, ShortType

#: Widths of the integer types that scaled values may be stored in.
INTEGER_TYPES = {"tinyint": ByteType(), "smallint": ShortType(), "int": IntegerType(), "bigint": LongType()}
_BYTES = {"tinyint": 1, "smallint": 2, "int": 4, "float": 4, "bigint": 8, "double": 8}


def unscale(raw: Column, scale: float = 1, adder: float = 0) -> Column:
    """raw / scale where the adder is 0, raw * scale + adder elsewhere; both rules are those of the stored format."""
    if scale == 1 and adder == 0:
        return raw
    value = raw.cast("double")
    return (value / F.lit(float(scale)) if adder == 0 else value * F.lit(float(scale)) + F.lit(float(adder))).cast("float")


def to_stored(value: Column, kind: str, scale: float = 1, source_is_float: bool = True) -> Column:
    """Half-even rounded value * scale; a fractional target with a scale, and a fractional value for an integer target without one, are errors."""
    if kind not in INTEGER_TYPES:
        if scale != 1:
            raise ValueError("a scale factor needs an integer type")
        return value.cast(kind)
    if source_is_float and scale == 1:
        raise ValueError("float values need a scale factor to be stored as integers")
    return F.bround(value * F.lit(scale)).cast(kind)


def converted(value: Column, source: str, target: str, scale: float | None = None) -> Column:
    """Type conversion on re-layout: float to integer needs a scale, integer to float is an error, a wider type of the same family is ignored."""
    was_integer, is_integer = source in INTEGER_TYPES, target in INTEGER_TYPES
    if was_integer and not is_integer:
        raise ValueError(f"{source} values are not stored as {target}")
    if not was_integer and is_integer:
        if scale is None:
            raise ValueError("float values need a scale factor to be stored as integers")
        return F.bround(value * F.lit(scale)).cast(target)
    return value if _BYTES[target] > _BYTES[source] else value.cast(target)


def clean(value: Column) -> Column:
    """NaN as null, which aggregates pass over."""
    return F.nanvl(value, F.lit(None))


def smallest_integer(least: int, most: int) -> IntegralType:
    """The type a metadata column of integers shrinks to."""
    return ShortType() if -32768 <= least and most < 32767 else IntegerType()
