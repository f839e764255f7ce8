"""Variables at heights between or beyond the stored ones."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lapse of temperature (degrees C / km) and pressure (Pa / km), bounds of the shear exponent.
LAPSE_RATES = {"temperature": 6.56, "pressure": 11_109.0}
SHEAR_BOUNDS = (0.06, 0.6)


def height_column(height: float | Column) -> Column:
    return height if isinstance(height, Column) else F.lit(float(height))


def linear(low: Column, h_low: float, high: Column, h_high: float, height: float | Column) -> Column:
    """The straight line through both values, at any height."""
    slope = (high - low) / F.lit(float(h_high - h_low))
    return slope * height_column(height) + (high - slope * F.lit(float(h_high)))


def shear_exponent(low: Column, h_low: float, high: Column, h_high: float) -> Column:
    return F.log(high / low) / F.lit(math.log(h_high / h_low))


def power_law(low: Column, h_low: float, alpha: Column, height: float | Column) -> Column:
    return low * F.pow(F.lit(height / h_low), alpha)


def power_law_by_row(low: Column, h_low: float, high: Column, h_high: float, height: float | Column) -> Column:
    """Each value with its own exponent, within bounds; zeros count as 0.001."""
    a, b = (F.when(x == 0, 0.001).otherwise(x) for x in (low, high))
    alpha = F.greatest(F.lit(SHEAR_BOUNDS[0]), F.least(F.lit(SHEAR_BOUNDS[1]), shear_exponent(a, h_low, b, h_high)))
    return power_law(a, h_low, alpha, height)


def stability(zeta: Column) -> Column:
    """The stability function of Monin-Obukhov similarity: Paulson and convective forms blended below 0, one form above."""
    z = F.when(zeta < 0, zeta).otherwise(F.lit(-1.0))
    x = F.pow(1 - 16 * z, F.lit(0.25))
    paulson = F.lit(math.pi / 2) - 2 * F.atan(x) + F.log(F.pow(1 + x, F.lit(2)) * (1 + F.pow(x, F.lit(2))) / 8)
    y = F.pow(1 - 10 * z, F.lit(1 / 3))
    root = math.sqrt(3)
    convective = 1.5 * F.log(F.pow(y, F.lit(2)) + y + 1 / 3) - F.lit(root) * F.atan(2 * y + 1 / root) + F.lit(math.pi / root)
    # the blend below 0: (paulson + zeta^2 convective) / (1 + zeta^2)
    unstable = (paulson + F.pow(z, F.lit(2)) * convective) / (1 + F.pow(z, F.lit(2)))
    s = F.when(zeta >= 0, zeta).otherwise(F.lit(0.0))
    stable = -6.1 * F.log(s + F.pow(1 + F.pow(s, F.lit(2.5)), F.lit(0.4)))
    return F.when(zeta < 0, unstable).otherwise(stable)


def monin_obukhov(value: Column, h_value: float, height: float | Column, roughness: Column, inverse_length: Column) -> Column:
    """A wind speed carried from one height to another through the surface layer."""

    def profile(h: float | Column) -> Column:
        return F.log(height_column(h) / roughness) - stability(height_column(h) * inverse_length) + stability(roughness * inverse_length)

    return value * profile(height) / profile(h_value)


def shortest_turn(start: Column, end: Column) -> Column:
    """The signed turn in degrees, the short way."""
    da = F.pmod(end - start, F.lit(360.0))
    return F.pmod(2 * da, F.lit(360.0)) - da


def circular(low: Column, h_low: float, high: Column, h_high: float, height: float | Column, anchored: str = "high") -> Column:
    """Directions between two heights.

    ``anchored="high"`` adds the turn for the share of the way to the higher value,
    as stored results were made; ``"low"`` interpolates.
    """
    share = (height - h_low) / (h_high - h_low)
    base = high if anchored == "high" else low
    return F.pmod(base + shortest_turn(low, high) * F.lit(share), F.lit(360.0))


def lapse(value: Column, h_value: float, height: float | Column, variable: str) -> Column:
    return value + F.lit((h_value - height) / 1000 * LAPSE_RATES[variable])
