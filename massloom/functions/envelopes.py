"""Isotopic patterns and envelopes as expressions over arrays of (mz, intensity)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from massloom.functions.mass import ISOTOPE_GAP


def total(pattern: Column) -> Column:
    return F.aggregate(pattern, F.lit(0.0), lambda s, p: s + p["intensity"])


def normalize(pattern: Column) -> Column:
    """Divide by the total."""
    return scale_raw(pattern, F.lit(1.0) / total(pattern))


def scale_raw(pattern: Column, factor: Column) -> Column:
    return F.transform(pattern, lambda p: F.struct(p["mz"].alias("mz"), (p["intensity"] * factor).alias("intensity")))


def shift(pattern: Column, offset: Column) -> Column:
    return F.transform(pattern, lambda p: F.struct((p["mz"] + offset).alias("mz"), p["intensity"].alias("intensity")))


def truncate_after(pattern: Column, threshold: float = 0.95) -> Column:
    """The prefix that reaches ``threshold`` of the total, the crossing peak included, normalised."""
    before = lambda i: F.aggregate(F.slice(pattern, 1, i), F.lit(0.0), lambda s, p: s + p["intensity"])
    return normalize(F.filter(pattern, lambda p, i: before(i) < threshold))


def ignore_below(pattern: Column, least: float = 0.001) -> Column:
    """Drop peaks under ``least``, never the first two, and normalise."""
    return normalize(F.filter(pattern, lambda p, i: (i < 2) | (p["intensity"] >= least)))


def drop_last_peak(pattern: Column) -> Column:
    """Without the last peak, the others scaled by one less its share."""
    kept = F.slice(pattern, 1, F.greatest(F.size(pattern) - 1, F.lit(0)))
    return scale_raw(kept, F.lit(1.0) - F.element_at(pattern, -1)["intensity"])


def base_peak_index(pattern: Column) -> Column:
    heights = F.transform(pattern, lambda p: p["intensity"])
    return F.array_position(heights, F.array_max(heights)) - 1


def poisson_pattern(mass: Column, peaks: int, charge: int = 1, factor: float = 1800.0) -> Column:
    """Poisson approximation of an isotopic pattern: peak k has weight L**k e**-L / k! with L = mass / factor."""
    rate = mass / F.lit(factor)
    return F.transform(
        F.sequence(F.lit(0), F.lit(peaks - 1)),
        lambda k: F.struct((mass + k * (ISOTOPE_GAP / charge)).alias("mz"), (F.pow(rate, k) * F.exp(-rate) / F.factorial(k)).alias("intensity")),
    )


def a_to_a2_ratio(envelope: Column) -> Column:
    """First peak over third, 0 for envelopes of fewer than three."""
    return F.when(F.size(envelope) < 3, F.lit(0.0)).otherwise(F.get(envelope, 0)["intensity"] / F.get(envelope, 2)["intensity"])


def most_abundant_mz(envelope: Column) -> Column:
    return F.get(envelope, base_peak_index(envelope).cast("int"))["mz"]


def average_mz(envelope: Column) -> Column:
    """Intensity-weighted mean m/z."""
    return F.aggregate(envelope, F.lit(0.0), lambda s, p: s + p["mz"] * p["intensity"]) / total(envelope)


def drop_placeholders(peaks: Column) -> Column:
    return F.filter(peaks, lambda p: (p["intensity"] > 1) & (p["mz"] > 1))


def find_nearest(peaks: Column, mz: Column) -> Column:
    """The peak nearest to ``mz``, the lower on ties."""
    return F.array_min(F.transform(peaks, lambda p: F.struct(F.abs(p["mz"] - mz).alias("error"), p["mz"].alias("mz"), p["intensity"].alias("intensity"))))
