"""Per-group Arrow kernels: what is inherently sequential inside one spectrum or one chain.

Each function is for ``groupBy(key).applyInArrow``; the key must bound the
group (a scan, a chain of masses), so that no task gathers more than that.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.functions.mass import ISOTOPE_GAP, PROTON
from massloom.operators import leaders
from massloom.operators.isotopes import AVERAGINES, whole_pattern
from massloom.operators.ordered import sessionize
from massloom.plans.store import materialize

#: Daltons from one kept pattern to the next.
STEP = 50.0


def truncated_pattern(name: str, step: int, truncate: float, known: dict) -> np.ndarray:
    """The whole pattern at ``step`` times STEP Da, cut once ``truncate`` of all its abundance is before; kept in ``known``."""
    key = name, step, truncate
    if key not in known:
        p = whole_pattern(AVERAGINES[name], step * STEP)
        p = p[np.concatenate([[0.0], np.cumsum(p)[:-1]]) < truncate]
        known[key] = p / p.sum()
    return known[key]


def theories(mz, charge, truncate, averagine, known=None):
    """(abundances, which of them count) of every peak as first isotope at one charge, as many as the heaviest needs."""
    known = {} if known is None else known
    steps, row = np.unique(np.maximum(np.round((mz * charge - charge * PROTON) / STEP).astype(int), 1), return_inverse=True)
    found = [truncated_pattern(averagine, int(s), truncate, known) for s in steps]
    sizes = np.array([len(p) for p in found], dtype=int)
    table = np.zeros((len(found), sizes.max(initial=1)))
    for k, p in enumerate(found):
        table[k, : len(p)] = p
    return table[row], np.arange(table.shape[1]) < sizes[row][:, None]


def match_isotopes(mz, charge, width, tolerance):
    """(nearest peak, whether it is within tolerance, its error) for each isotope of every peak as the first one."""
    want = mz[:, None] + np.arange(width) * ISOTOPE_GAP / charge
    right = np.clip(np.searchsorted(mz, want), 0, len(mz) - 1)
    left = np.maximum(right - 1, 0)
    at = np.where(np.abs(mz[left] - want) <= np.abs(mz[right] - want), left, right)
    error = np.abs(mz[at] - want)
    return at, error <= want * tolerance, error


def score_fits(at, near, error, intensity, snr, charge, p, kept, least):
    """PenalizedMSDeconV of the fits given by row: (scores, matched peaks, theory)."""
    hit = kept & near & (intensity[at] >= least)
    obs = np.where(hit, intensity[at], np.where(kept, 1.0, 0.0))
    theo = p * obs.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        accuracy = np.maximum(0, 1 - np.where(hit, error, 0) / 0.02)
        agree = np.where(obs < theo, 1 - (theo - obs) / obs, np.sqrt(np.maximum(0, 1 - (obs - theo) / obs)))
        term = np.where(kept & (np.where(hit, snr[at], 1) >= 1), np.sqrt(theo) * accuracy * np.maximum(0, agree), 0)
        o, t = obs / obs.sum(axis=1, keepdims=True), theo / theo.sum(axis=1, keepdims=True)
        g = 2 * np.where(kept, o * np.log(o / t), 0).sum(axis=1)
    score = term.sum(axis=1) * (1 - np.abs(g))
    missed = (kept & ~hit).sum(axis=1)
    usable = hit[:, 0] & (missed <= 1) & (((hit.sum(axis=1)) > 1) | (charge == 1))
    return np.where(usable, score, -1.0), np.where(hit, at, -1), theo


def deconvolute_spectrum(mz, intensity, snr, charges=range(1, 9), tolerance=2e-5, minimum_score=10.0, truncate=0.8, averagine="peptide", least=5.0, iterations=10, convergence=1e-3, known=None):
    """Peaks of one spectrum to (mass, charge, intensity, score, m/z, isotopes).

    In each round all fits are scored, the best that share no peak are taken
    (score, then charge descending, then m/z), their theory is subtracted, and
    the rounds end when the signal changes by less than ``convergence``.
    A pattern has as many isotopes as ``truncate`` of its whole abundance
    takes, at any mass.
    """
    order = np.argsort(mz, kind="stable")
    mz, intensity, snr = mz[order], intensity[order].astype(float).copy(), snr[order]
    out = []
    theory = {z: theories(mz, z, truncate, averagine, known) for z in charges}
    places = {z: match_isotopes(mz, z, theory[z][0].shape[1], tolerance) for z in charges}
    state: dict[int, tuple] = {}
    changed = np.ones(len(mz), dtype=bool)
    for _ in range(iterations):
        begin, before = intensity.sum(), intensity.copy()
        fits = []
        for z in charges:
            (at, near, error), (p, kept) = places[z], theory[z]
            # after the first round only fits over peaks that it changed can score otherwise
            rows = np.flatnonzero((changed[at] & near).any(axis=1)) if z in state else np.arange(len(mz))
            new = score_fits(at[rows], near[rows], error[rows], intensity, snr, z, p[rows], kept[rows], least)
            if z not in state:
                state[z] = new
            else:
                for old, fresh in zip(state[z], new, strict=True):
                    old[rows] = fresh
            score, used, theo = state[z]
            for i in np.flatnonzero(score >= minimum_score):
                fits.append((-round(float(score[i]), 9), -z, float(mz[i]), int(i), used[i], theo[i]))
        fits.sort(key=lambda f: f[:4])
        taken: set[int] = set()
        for s, z, first, _, used, theo in fits:
            own = [int(k) for k in used if k >= 0]
            if taken.intersection(own):
                continue
            taken.update(own)
            out.append((first * -z + z * PROTON, -z, float(theo.sum()), -s, first, len(own)))
            for k, t in zip(used, theo, strict=True):
                if k >= 0:
                    rest = intensity[k] - t
                    intensity[k] = 1.0 if rest < 0 or t > 0.7 * intensity[k] else rest
        changed = intensity != before
        if not taken or (begin - intensity.sum()) / (intensity.sum() + 1) < convergence:
            break
    return out


def deconvolute(peaks: DataFrame, **how) -> DataFrame:
    """(scan_id, neutral_mass, charge, intensity, score, mz, n_isotopes) for peaks (scan_id, mz, intensity, snr)."""

    known: dict = {}  # a task's own from where the kernel arrives

    def kernel(key, table):
        found = deconvolute_spectrum(*(table.column(c).to_numpy() for c in ("mz", "intensity", "snr")), known=known, **how)
        cols = list(zip(*found, strict=True)) or [[]] * 6
        kinds = (pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32())
        return pa.table([pa.array([key[0].as_py()] * len(found), pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["scan_id", "neutral_mass", "charge", "intensity", "score", "mz", "n_isotopes"])

    return peaks.select("scan_id", "mz", "intensity", "snr").groupBy("scan_id").applyInArrow(kernel, "scan_id long, neutral_mass double, charge int, intensity double, score double, mz double, n_isotopes int")


def pick_peaks(mz: np.ndarray, intensity: np.ndarray, minimum: float = 1.0) -> list[tuple[float, float, float]]:
    """(m/z, height, full width at half maximum) of the local maxima of a profile, by a parabola through three points."""
    out = []
    for i in np.flatnonzero((intensity[1:-1] > intensity[:-2]) & (intensity[1:-1] >= intensity[2:]) & (intensity[1:-1] >= minimum)) + 1:
        a, b, c = intensity[i - 1 : i + 2]
        bend = a - 2 * b + c
        shift = 0.0 if bend == 0 else 0.5 * (a - c) / bend
        step = mz[i + 1] - mz[i] if shift > 0 else mz[i] - mz[i - 1]
        height = b - 0.25 * (a - c) * shift
        lo = i
        while lo > 0 and intensity[lo] > height / 2:
            lo -= 1
        hi = i
        while hi < len(mz) - 1 and intensity[hi] > height / 2:
            hi += 1

        def cross(p: int, q: int, half: float = height / 2) -> float:
            d = intensity[q] - intensity[p]
            return float(mz[p]) if d == 0 else float(mz[p] + (mz[q] - mz[p]) * (half - intensity[p]) / d)

        out.append((float(mz[i] + shift * step), float(height), cross(hi - 1, hi) - cross(lo, lo + 1)))
    return out


def average_profiles(profiles: list[tuple[np.ndarray, np.ndarray]], dx: float, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spectra resampled to one grid by linear interpolation and averaged, with weights if given."""
    low, high = min(x[0] for x, _ in profiles), max(x[-1] for x, _ in profiles)
    grid = np.arange(low, high + dx / 2, dx)
    stack = np.array([np.interp(grid, x, y, left=0, right=0) for x, y in profiles])
    return grid, np.average(stack, axis=0, weights=weights)


def average_regular(profiles: DataFrame, key: str, values: str, parts: int) -> DataFrame:
    """(key, step, intensity): the mean by key of profiles of unit steps, interpolated at ``parts`` points a step.

    Each profile gives its own grid points; their sums combine before the
    shuffle, so a key may have any number of profiles.
    """
    y, at = F.col(values), F.col("step")
    lower, part = F.floor(at / parts).cast("int"), (at % parts) / F.lit(float(parts))
    grid = profiles.filter(F.size(values) > 0).select(key, values, F.explode(F.sequence(F.lit(0), (F.size(values) - 1) * parts)).alias("step"))
    value = F.get(y, lower) * (1 - part) + F.coalesce(F.get(y, lower + 1), F.lit(0.0)) * part
    return grid.select(key, "step", value.alias("v")).groupBy(key, "step").agg(F.avg("v").alias("intensity"))


def number_chains(rows: DataFrame, by: list[str], order: list, breaks) -> DataFrame:
    """The rows with the number of their ``chain`` in the order given; a chain never reaches over a change of the ``by`` columns."""
    changed = F.lit(False)
    for c in by:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_prev.{c}"))
    return sessionize(rows, [], [*by, *order], changed | F.coalesce(breaks, F.lit(False)), "chain")


def in_chains(rows: DataFrame, by: list[str], order: list, breaks, then: list) -> DataFrame:
    """The rows numbered by chain in the order given, each chain whole in one partition and sorted by ``then``.

    Chains never reach over a change of the ``by`` columns. They are found in
    ranges of the whole order, so no task holds more than its range, however
    few values ``by`` has.
    """
    return number_chains(rows, by, order, breaks).repartition("chain").sortWithinPartitions("chain", *then)


def trace_features(points: DataFrame, tolerance: float = 1e-5, by: tuple[str, ...] = ()) -> DataFrame:
    """Assign peaks (id, mz, time, intensity) to features in time order: the nearest running mean within tolerance, else a new one.

    Runs of masses without a gap above twice the tolerance are independent and
    are traced each for itself, many in one stream: (by, chain, id, feature).
    """
    rows = points.select(*by, "id", "mz", "time", "intensity")
    gap = (F.col("mz") - F.col("_prev.mz")) / F.col("mz") > 2 * tolerance
    chains = in_chains(rows, list(by), ["mz", "id"], gap, ["time", "mz", "id"]).select(*by, "chain", "id", "mz", "intensity")
    k = len(by)

    def kernel(batches):
        chain, means, owner, total, center = None, [], [], [], []
        for b in batches:
            feature = []
            for c, mz, y in zip(*(b.column(i).to_pylist() for i in (k, k + 2, k + 3)), strict=True):
                if c != chain:
                    chain, means, owner, total, center = c, [], [], [], []
                reach, best = mz * tolerance, None
                i = bisect_left(means, mz - reach)
                while i < len(means) and means[i] <= mz + reach:
                    if best is None or (abs(means[i] - mz), owner[i]) < best[:2]:
                        best = (abs(means[i] - mz), owner[i], i)
                    i += 1
                if best is None or best[0] > reach:
                    f, at = len(total), mz
                    total.append(y)
                    center.append(mz)
                else:
                    _, f, i = best
                    total[f] += y
                    at = center[f] = center[f] + ((mz - center[f]) * y / total[f] if total[f] else 0)
                    del means[i], owner[i]
                i = bisect_left(means, at)
                means.insert(i, at)
                owner.insert(i, f)
                feature.append(f)
            yield pa.record_batch([*b.columns[: k + 2], pa.array(feature, pa.int32())], [*by, "chain", "id", "feature"])

    kinds = dict(points.dtypes)
    return chains.mapInArrow(kernel, ", ".join([*(f"{c} {kinds[c]}" for c in by), "chain long, id long, feature int"]))


def cluster_scans(scans: DataFrame, tolerance: float = 1e-5, similarity: float = 0.1, by: tuple[str, ...] = ()) -> DataFrame:
    """Greedy clusters of scans (scan_id, mass, tic, bins, values): in order of falling signal a scan joins the cluster whose first member is most similar.

    Only scans of one chain of precursor masses, and of equal ``by`` columns,
    can meet; within a chain a scan is held against the clusters within
    tolerance of its mass alone. Chains are found without the spectra, which
    are shuffled once; one of more than LONG scans is cut into cells of mass.
    Returns (by, chain, scan_id, cluster, similarity).
    """
    held = materialize(scans.select(*by, "scan_id", "mass", "tic", F.col("bins").cast("array<long>"), F.col("values").cast("array<double>"), F.monotonically_increasing_id().alias("_row")), "scans")
    gap = (F.col("_prev.mass") - F.col("mass")) / F.col("mass") > tolerance
    chains = materialize(number_chains(held.select(*by, "scan_id", "mass", "_row"), list(by), [F.desc("mass"), "scan_id"], gap).select("_row", "mass", "chain"), "chains")
    long = materialize(chains.groupBy("chain").agg(F.count("*").alias("n"), F.max("mass").alias("top")).filter(F.col("n") > leaders.LONG).drop("n"), "long-chains")
    rows = held.join(chains.select("_row", "chain"), "_row")
    short = rows.join(F.broadcast(long), "chain", "left_anti").select(*by, "chain", "scan_id", "mass", "tic", "bins", "values")
    k = len(by)

    def kernel(batches):
        chain, first, made = None, None, 0
        for b in batches:
            clusters, scores = [], []
            for c, mass, bins, values in zip(*(b.column(i).to_pylist() for i in (k, k + 2, k + 4, k + 5)), strict=True):
                if c != chain:
                    chain, first, made = c, leaders.Leaders(tolerance, similarity), 0
                v, norm = leaders.vector(bins, values)
                best = min(first.like(mass, v, norm), default=None)
                if best is None:
                    best = (-1.0, made)
                    first.add(mass, made, v, norm)
                    made += 1
                clusters.append(best[1])
                scores.append(-best[0])
            yield pa.record_batch([*b.columns[: k + 2], pa.array(clusters, pa.int32()), pa.array(scores, pa.float64())], [*by, "chain", "scan_id", "cluster", "similarity"])

    kinds = dict(scans.dtypes)
    found = short.repartition("chain").sortWithinPartitions("chain", F.desc("tic"), "scan_id").mapInArrow(kernel, ", ".join([*(f"{c} {kinds[c]}" for c in by), "chain long, scan_id long, cluster int, similarity double"]))
    if long.isEmpty():
        return found
    clusters = leaders.cluster_long(rows.join(F.broadcast(long), "chain"), tolerance, similarity)
    named = held.select(*by, "scan_id", "_row").join(chains.select("_row", "chain"), "_row").join(clusters, "_row")
    return found.unionByName(named.select(*by, "chain", "scan_id", "cluster", "similarity"))


def iterative_clusters(scans: DataFrame, tolerance: float = 1e-5, similarities: tuple[float, ...] = (0.1, 0.4, 0.7)) -> DataFrame:
    """(scan_id, cluster): clusters made at the first similarity are clustered again at each higher one; singles are done.

    ``cluster`` is the smallest scan_id of the members.
    """
    scans = materialize(scans, "spectra")
    rows = scans.withColumn("group", F.lit(0).cast("long"))
    for s in similarities:
        members = materialize(cluster_scans(rows, tolerance, s, ("group",)), "cluster-members")
        first = members.groupBy("group", "chain", "cluster").agg(F.min("scan_id").alias("first"))
        named = members.join(first, ["group", "chain", "cluster"]).select("scan_id", F.col("first").alias("group"))
        rows = scans.join(named, "scan_id")
    return named.select("scan_id", F.col("group").alias("cluster"))
