"""Irradiance components and their corrections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _floor(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def cos_zenith(ghi: Column, dni: Column, dhi: Column) -> Column:
    """From the closure ghi = dni cos + dhi; null where dni is 0."""
    return F.try_divide(ghi - dhi, dni)


def fill_missing(ghi: Column | None, dni: Column | None, dhi: Column | None, zenith_degrees: Column) -> dict[str, Column]:
    """The component that is missing, from the two others; none is below 0."""
    given = [x is not None for x in (ghi, dni, dhi)]
    if sum(given) < 2:
        raise ValueError("at least two of ghi, dni and dhi are needed")
    cos = F.cos(F.radians(zenith_degrees))
    if ghi is None:
        ghi = _floor(dni * cos + dhi)
    elif dni is None:
        dni = _floor(F.coalesce(F.nanvl(F.try_divide(ghi - dhi, cos), F.lit(0.0)), F.lit(0.0)))
    elif dhi is None:
        dhi = _floor(ghi - dni * cos)
    return {"ghi": ghi, "dni": dni, "dhi": dhi}


def corrected(ghi: Column, dni: Column, dhi: Column, new_ghi: Column, new_dni: Column) -> dict[str, Column]:
    """Components after a correction of ghi and dni: zeros stay zero, dhi follows from the old cosine."""
    cos = cos_zenith(ghi, dni, dhi)
    g = F.when(ghi == 0, 0.0).otherwise(_floor(new_ghi))
    d = F.when(dni == 0, 0.0).otherwise(_floor(new_dni))
    h = F.when(dhi == 0, 0.0).when(dni == 0, g).otherwise(_floor(g - d * cos))
    return {"ghi": g, "dni": d, "dhi": h}


def linear_correction(ghi: Column, dni: Column, dhi: Column, scalar: Column, adder: Column) -> dict[str, Column]:
    return corrected(ghi, dni, dhi, ghi * scalar + adder, dni * scalar + adder)


def linear_wind_correction(speed: Column, scalar: Column, adder: Column) -> Column:
    return _floor(speed * scalar + adder)


def daily_irradiation(mean: Column) -> Column:
    """kWh a square metre and day from a mean in W."""
    return mean / 1000 * 24
