"""Mass, m/z and tolerance expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: mass of a proton, and of the neutron between carbon isotopes
PROTON = 1.00727646677
ISOTOPE_GAP = 1.0033548378


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` of doubles as IEEE 754 has it: infinite or NaN where ``b`` is 0, in place of an error."""
    by_zero = F.when(b == 0, F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).when(a == 0, F.lit(float("nan"))))
    return F.coalesce(F.try_divide(a, b), by_zero)


def neutral_mass(mz: Column, charge: Column) -> Column:
    """m/z and charge to neutral mass; an unknown charge counts as 1."""
    z = F.coalesce(charge, F.lit(1))
    return mz * F.abs(z) - z * PROTON


def mass_charge_ratio(mass: Column, charge: Column) -> Column:
    """Neutral mass and charge to m/z."""
    z = F.coalesce(charge, F.lit(1))
    return (mass + z * PROTON) / F.abs(z)


def ppm_error(found: Column, query: Column) -> Column:
    """Relative error of ``found``, with the query in the denominator."""
    return (found - query) / query


def within(found: Column, query: Column, tolerance: float) -> Column:
    """Whether ``found`` is inside the inclusive relative tolerance of ``query``."""
    return F.abs(found - query) <= query * tolerance


def to_dalton(mass: Column, tolerance: float) -> Column:
    return mass * tolerance


def to_ppm(mass: Column, tolerance: float) -> Column:
    return F.lit(tolerance) / mass


def charge_range(low: int, high: int) -> list[int]:
    """Charges from the larger absolute value down, with the sign of the polarity."""
    sign = -1 if low < 0 else 1
    a, b = sorted((abs(low), abs(high)))
    return [sign * z for z in range(b, a - 1, -1)]
