"""Scores of an observed against a theoretical envelope.

Each score is an aggregate over the peak pairs of a fit: use it in
``groupBy(fit).agg(...)`` with one row for each (observed, expected) pair.
Minimising scores say how far apart the two are, maximising ones how much
signal agrees.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from massloom.functions.mass import ratio

EPS = 1e-4


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation of two columns; NaN where one is constant, for which Spark's own raises an error."""
    return ratio(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))


def g_test(obs: Column, theo: Column) -> Column:
    """2 sum o ln(o / e)."""
    return 2 * F.sum(obs * F.log(obs / theo))


def share(value: Column, fit: list[str]) -> Column:
    """A peak's part of its fit's total; the input of the scaled G-test."""
    return value / F.sum(value).over(W.partitionBy(*fit))


def chi_square(obs: Column, theo: Column) -> Column:
    return F.sum(F.pow(obs - theo, 2) / theo)


def least_squares(obs: Column, theo: Column) -> Column:
    """Squared differences over squared theory, each side divided by its largest peak before."""
    return F.sum(F.pow(obs - theo, 2)) / F.sum(F.pow(theo, 2))


def of_largest(value: Column, fit: list[str]) -> Column:
    return value / F.max(value).over(W.partitionBy(*fit))


def dot_product(obs: Column, theo: Column) -> Column:
    return F.sum(obs * theo)


def msdeconv_term(obs_mz: Column, obs: Column, snr: Column, theo_mz: Column, theo: Column, tolerance: float = 0.02) -> Column:
    """One peak's part of the MSDeconV score: sqrt(theory) x mass accuracy x abundance agreement.

    A signal-to-noise ratio under 1 gives 0; accuracy falls linearly to 0 at
    the tolerance; too little signal costs in proportion, too much by a root. A
    peak without signal agrees with nothing.
    """
    error = F.abs(obs_mz - theo_mz)
    accuracy = F.when(error <= tolerance, 1 - error / tolerance).otherwise(0.0)
    lacking = F.when(obs < theo, 1 - ratio(theo - obs, obs))
    excess = F.sqrt(F.greatest(1 - ratio(obs - theo, obs), F.lit(0.0)))
    agreement = F.greatest(F.coalesce(lacking, excess), F.lit(0.0))
    return F.when(snr < 1, 0.0).otherwise(F.sqrt(theo) * accuracy * agreement)


def msdeconv(*columns: Column, tolerance: float = 0.02) -> Column:
    return F.sum(msdeconv_term(*columns, tolerance=tolerance))


def penalized(score: Column, scaled_g: Column, factor: float = 1.0) -> Column:
    """MSDeconV reduced by the absolute scaled G-test."""
    return score * (1 - factor * F.abs(scaled_g))


def xrea_parts(intensity: Column, scan: list[str], tie: list[Column]) -> Column:
    """Running total of the ascending intensities of a scan."""
    return F.sum(intensity).over(W.partitionBy(*scan).orderBy(intensity, *tie).rowsBetween(W.unboundedPreceding, 0))
