"""Deconvolution against known compositions, and of features instead of peaks."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from massloom.functions.mass import ISOTOPE_GAP, PROTON
from massloom.operators.isotopes import isotopic_variants, peaks_of
from massloom.operators.joins import range_join

#: Compositions that may travel with every task.
MOST_COMPOSITIONS = 100_000


def nearest(sorted_mz: np.ndarray, want: np.ndarray) -> np.ndarray:
    right = np.clip(np.searchsorted(sorted_mz, want), 0, len(sorted_mz) - 1)
    left = np.maximum(right - 1, 0)
    return np.where(np.abs(sorted_mz[left] - want) <= np.abs(sorted_mz[right] - want), left, right)


def envelope_score(obs_mz, obs, theo_mz, theo, tolerance: float = 0.02) -> float:
    """MSDeconV reduced by the scaled G-test, for one envelope."""
    accuracy = np.maximum(0, 1 - np.abs(obs_mz - theo_mz) / tolerance)
    agree = np.where(obs < theo, 1 - (theo - obs) / obs, np.sqrt(np.maximum(0, 1 - (obs - theo) / obs)))
    o, t = obs / obs.sum(), theo / theo.sum()
    return float((np.sqrt(theo) * accuracy * np.maximum(0, agree)).sum() * (1 - abs(2 * (o * np.log(o / t)).sum())))


def composition_theory(compositions: list[tuple[str, dict[str, int]]], charges: Iterable[int], truncate: float = 0.95) -> list[tuple[int, str, int, int, float, float]]:
    """(number, name, charge, k, m/z, share) of each isotope of each composition at each charge, up to ``truncate`` of the abundance."""
    if len(compositions) > MOST_COMPOSITIONS:
        raise ValueError(f"more than {MOST_COMPOSITIONS} compositions; give them in blocks and join the results")
    out = []
    for number, (name, c) in enumerate(compositions):
        x, p = isotopic_variants(c, peaks_of(c))
        keep = np.concatenate([[0.0], np.cumsum(p)[:-1]]) < truncate
        x, p = x[keep], p[keep] / p[keep].sum()
        out += [(number, name, z, k, float((x[k] + z * PROTON) / z), float(p[k])) for z in charges for k in range(len(x))]
    return out


def composition_members(peaks: DataFrame, theory: list[tuple], tolerance: float) -> DataFrame:
    """One row for each peak of each fit of a composition that two peaks or more of a spectrum match: the members that the solvers in rounds take.

    ``peaks`` has scan_id, n, mz, intensity and snr, ``theory`` is of
    :func:`composition_theory`. All spectra are searched at once by a tolerance
    join on m/z; the nearest peak within tolerance counts, the first on ties.
    A fit's number is negative, so it never meets one of an averagine.
    """
    want = peaks.sparkSession.createDataFrame(theory, "number long, name string, charge int, k int, want double, weight double")
    pairs = range_join(want, peaks.select("scan_id", "n", "mz", "intensity", "snr"), "want", "mz", tolerance)
    near = F.min_by(F.struct("n", "mz", "intensity", "snr", "want", "weight"), F.struct(F.abs(F.col("mz") - F.col("want")), F.col("n")))
    hit = pairs.groupBy("scan_id", "number", "name", "charge", "k").agg(near.alias("p")).select("scan_id", "number", "name", "charge", "p.*")
    fit = -((F.col("scan_id") * MOST_COMPOSITIONS + F.col("number")) * 16 + F.col("charge")) - 1
    return hit.withColumn("found", F.count("*").over(W.partitionBy("scan_id", "number", "charge"))).filter("found > 1").withColumn("fit", fit).drop("found")


def fit_composition(mz, intensity, composition: dict[str, int], charge: int, tolerance: float = 2e-5, truncate: float = 0.95, shift: float = 0.0):
    """(score, used peak indices, first m/z, theoretical total) of one composition at one charge, or None.

    The pattern is moved to the peak found at its first m/z; a fit that misses
    more than half of the isotopes is rejected.
    """
    x, p = isotopic_variants(composition, 16)
    keep = np.concatenate([[0.0], np.cumsum(p)[:-1]]) < truncate
    x, p = (x[keep] + shift + charge * PROTON) / abs(charge), p[keep] / p[keep].sum()
    first = int(nearest(mz, x[:1])[0])
    if abs(mz[first] - x[0]) <= x[0] * tolerance:
        x = x + mz[first] - x[0]
    at = nearest(mz, x)
    hit = np.abs(mz[at] - x) <= x * tolerance
    if hit.sum() * 2 < len(x) or not hit.any():
        return None
    obs = np.where(hit, intensity[at], 1.0)
    theo = p * obs.sum()
    return envelope_score(np.where(hit, mz[at], x), obs, x, theo), at[hit], float(x[0]), float(theo.sum())


def fit_compositions(mz, intensity, compositions: list[tuple[str, dict[str, int]]], charges: Iterable[int] = range(1, 9), minimum_score: float = 5.0, **how) -> list[tuple]:
    """(name, charge, first m/z, intensity, score) of the best fits that share no peak: score falling, then name and charge."""
    order = np.argsort(mz, kind="stable")
    mz, intensity = mz[order], intensity[order]
    fits = []
    for name, c in compositions:
        for z in charges:
            f = fit_composition(mz, intensity, c, z, **how) if len(mz) else None
            if f and f[0] >= minimum_score:
                fits.append((-f[0], name, z, f))
    taken: set[int] = set()
    out = []
    for _, name, z, (score, used, first, total) in sorted(fits, key=lambda f: f[:3]):
        if taken.isdisjoint(used.tolist()):
            taken.update(used.tolist())
            out.append((name, z, first, total, score))
    return out


def deconvolute_compositions(peaks: DataFrame, compositions: list[tuple[str, dict[str, int]]], **how) -> DataFrame:
    """(scan_id, name, charge, mz, intensity, score) for peaks (scan_id, mz, intensity) and a bounded list of compositions."""
    if len(compositions) > MOST_COMPOSITIONS:
        raise ValueError(f"more than {MOST_COMPOSITIONS} compositions; give them in blocks and join the results")

    def kernel(key, table):
        found = fit_compositions(table.column("mz").to_numpy(), table.column("intensity").to_numpy(), compositions, **how)
        cols = list(zip(*found, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
        return pa.table([pa.array([key[0].as_py()] * len(found), pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["scan_id", "name", "charge", "mz", "intensity", "score"])

    return peaks.select("scan_id", "mz", "intensity").groupBy("scan_id").applyInArrow(kernel, "scan_id long, name string, charge int, mz double, intensity double, score double")


def deconvolute_features(mz, start, end, intensity, pattern, charges: Iterable[int] = range(1, 9), tolerance: float = 2e-5, minimum_score: float = 10.0, most_missing: int = 1) -> list[tuple]:
    """(neutral mass, charge, start, end, intensity, score, members) of features that form isotopic series.

    ``pattern(mass)`` gives the expected shares. Members must overlap the first
    feature in time; of several at one place the one with the longest overlap
    counts. Bounds are the latest start and the earliest end of the members.
    """
    order = np.argsort(mz, kind="stable")
    mz, start, end, intensity = mz[order], start[order], end[order], intensity[order]
    fits = []
    for i in range(len(mz)):
        for z in charges:
            mass = mz[i] * z - z * PROTON
            p = pattern(mass)
            want = mz[i] + np.arange(len(p)) * ISOTOPE_GAP / z
            members, obs, missing = [i], [intensity[i]], 0
            for w in want[1:]:
                lo, hi = np.searchsorted(mz, w * (1 - tolerance), "left"), np.searchsorted(mz, w * (1 + tolerance), "right")
                shared = np.minimum(end[lo:hi], end[i]) - np.maximum(start[lo:hi], start[i])
                if len(shared) and shared.max() >= 0:
                    members.append(int(lo + np.argmax(shared)))
                    obs.append(intensity[members[-1]])
                else:
                    members.append(-1)
                    obs.append(1.0)
                    missing += 1
            if missing > most_missing or (missing == len(p) - 1 and z > 1):
                continue
            obs = np.array(obs)
            own = [m for m in members if m >= 0]
            found = np.where(np.array(members) >= 0, mz[members], want)
            score = envelope_score(found, obs, want, p * obs.sum())
            if score >= minimum_score:
                fits.append((-score, -z, float(mz[i]), mass, float(start[own].max()), float(end[own].min()), float(obs.sum()), own))
    taken: set[int] = set()
    out = []
    for s, z, _, mass, a, b, total, own in sorted(fits, key=lambda f: f[:3]):
        if taken.isdisjoint(own):
            taken.update(own)
            out.append((mass, -z, a, b, total, -s, [int(order[m]) for m in own]))
    return out


def greedy_disjoint(fits: list[tuple[float, frozenset]]) -> list[int]:
    """Indices of the fits taken by falling score, none sharing a member with one before."""
    taken: set = set()
    out = []
    for i in sorted(range(len(fits)), key=lambda i: (-fits[i][0], i)):
        if taken.isdisjoint(fits[i][1]):
            taken |= fits[i][1]
            out.append(i)
    return sorted(out)


def overlapping_groups(fits: list[tuple[float, frozenset]]) -> list[list[int]]:
    """The fits in groups that share no member with one another."""
    group, root = list(range(len(fits))), {}

    def find(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    for i, (_, members) in enumerate(fits):
        for m in members:
            group[find(i)] = find(root.setdefault(m, i))
    out: dict[int, list[int]] = {}
    for i in range(len(fits)):
        out.setdefault(find(i), []).append(i)
    return list(out.values())


def best_disjoint(fits: list[tuple[float, frozenset]]) -> list[int]:
    """Indices of the disjoint fits of the greatest total score: exact, by branch and bound in each overlapping group.

    The cost may double with each fit of a group; :func:`greedy_disjoint` is
    the one for large groups.
    """
    chosen: list[int] = []
    for members in overlapping_groups(fits):
        order = sorted(members, key=lambda i: (-fits[i][0], i))
        rest = np.concatenate([np.cumsum([fits[i][0] for i in order][::-1])[::-1], [0.0]])
        best: tuple[float, list[int]] = (-1.0, [])
        open_sets: list[tuple[int, float, frozenset, list[int]]] = [(0, 0.0, frozenset(), [])]
        while open_sets:
            k, score, used, own = open_sets.pop()
            if score > best[0]:
                best = (score, own)
            if k == len(order) or score + rest[k] <= best[0]:
                continue
            s, peaks = fits[order[k]]
            open_sets.append((k + 1, score, used, own))
            if used.isdisjoint(peaks):
                open_sets.append((k + 1, score + s, used | peaks, [*own, order[k]]))
        chosen += best[1]
    return sorted(chosen)
