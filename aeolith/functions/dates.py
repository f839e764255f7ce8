"""Dates from whole numbers, and times inside file names."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = {"Y": 4, "m": 2, "d": 2, "H": 2, "M": 2, "S": 2}
_SPARK = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss"}


def date_of(value: int | str) -> dt.date:
    """A date written as YYYYMMDD, after 1970."""
    text = str(int(value))
    if len(text) != 8 or int(text[:4]) <= 1970:
        raise ValueError(f"{value} is no date written as YYYYMMDD")
    return dt.datetime.strptime(text, "%Y%m%d").date()


def date_from_int(value: Column) -> Column:
    """The same for a column; null where it is no date."""
    return F.try_to_date(value.cast("string"), "yyyyMMdd")


def time_pattern(time_format: str) -> str:
    """The regular expression of a strftime format of %Y, %m, %d, %H, %M and %S."""
    parts = re.split(r"(%[YmdHMS])", time_format)
    return "".join(rf"\d{{{_DIGITS[p[1]]}}}" if re.fullmatch(r"%[YmdHMS]", p) else re.escape(p) for p in parts)


def time_in_name(path: Column, time_format: str = "%Y-%m-%d_%H:%M:%S") -> Column:
    """The time in the last part of a path, without zone; null where there is none."""
    text = F.regexp_extract(F.element_at(F.split(path, "/"), -1), f"({time_pattern(time_format)})", 1)
    spark_format = "".join(_SPARK[p[1]] if re.fullmatch(r"%[YmdHMS]", p) else "".join(f"'{c}'" if c.isalpha() else c for c in p) for p in re.split(r"(%[YmdHMS])", time_format))
    return F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit(spark_format)).cast("timestamp_ntz")
