"""Units, valid ranges and curtailment of site-model inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Valid ranges by technology.
_PV = {"dni": (0.0, 1360.0), "dhi": (0.0, 1360.0), "ghi": (0.0, 1360.0), "wind_speed": (0, 120), "air_temperature": (-200, 100)}
_CSP = {**_PV, "dew_point": (-200, 100), "surface_pressure": (300, 1100)}
_WIND = {"windspeed": (0, 120), "winddirection": (0, 360), "pressure": (0.5, 1.099), "temperature": (-200, 100), "rh": (0.1, 99.9), "relativehumidity_2m": (0.1, 99.9)}
_WAVE = {"significant_wave_height": (0, 20.5), "energy_period": (0, 9.75)}
_GEOTHERMAL = {"temperature": (-200, 1000), "potential_MW": (0, 1_000_000)}
RANGES = {
    "windpower": _WIND, "wind": _WIND, "pv": _PV, "pvwattsv5": _PV, "pvwattsv7": _PV, "pvwattsv8": _PV, "pvsamv1": _PV, "csp": _CSP, "tcsmoltensalt": _CSP,
    "troughphysicalheat": _CSP, "lineardirectsteam": _CSP, "solarwaterheat": _CSP, "wave": _WAVE, "geothermal": _GEOTHERMAL,
}
#: Names that stand for each other.
ALIASES = {"wind_speed": "windspeed", "air_temperature": "temperature"}
ATMOSPHERES_PER_PASCAL = 9.86923e-6
#: Technologies that take pressure in millibars.
MILLIBAR = ("csp", "troughphysicalheat", "lineardirectsteam", "solarwaterheat")


def normalised(value: Column, variable: str, technology: str, above: Callable[[float], Column], least: Column) -> Column:
    """Units as the models take them, judged by the median and minimum of the whole selection.

    ``above(limit)`` tells whether the median exceeds a limit.  Pressure: wind models
    take atmospheres, thermal ones millibars.  Temperature: degrees C, from kelvin;
    geothermal temperatures are left alone.
    """
    if "pressure" in variable:
        if technology == "windpower":
            return F.when(above(1e3), value * ATMOSPHERES_PER_PASCAL).otherwise(value)
        if technology in MILLIBAR:
            # kilopascals first, then pascals by the median after that
            kilo = least < 200
            return F.when(kilo & above(7e3), value / 10).when(kilo, value * 10).when(above(7e4), value / 100).otherwise(value)
        return value
    if "temperature" in variable and "geothermal" not in technology:
        return F.when(above(200), value - 273.15).otherwise(value)
    return value


def clamped(value: Column, variable: str, technology: str) -> Column:
    bounds = RANGES[technology].get(variable)
    return value if bounds is None else F.greatest(F.lit(float(bounds[0])), F.least(F.lit(float(bounds[1])), value))


def curtailed(speed: Column, share: Column) -> Column:
    return speed * share
