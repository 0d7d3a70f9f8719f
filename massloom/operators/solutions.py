"""Which of the fits that share peaks are kept: by falling score in layers, with subtraction, and the heaviest path.

Fits of different spectra never share a peak, so the fits of one spectrum come
together, some hundreds, are solved in one pass and leave: each of these is one
shuffle by ``scan_id``, however many rounds a spectrum takes.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def laid(fits: DataFrame) -> DataFrame:
    """The fits (scan_id, fit, peaks, score, ...) with ``cluster``, the smallest number of those that share peaks with one another, directly or not, and ``layer``.

    Fits go by falling score, the lower number on ties, each into the first
    layer where it shares no peak with one before. Layer 0 is the greedy solution.
    """
    schema = StructType(list(fits.schema.fields)).add("cluster", "long").add("layer", "integer")

    def kernel(spectrum: pa.Table) -> pa.Table:
        fit, peaks, score = (spectrum.column(c).to_pylist() for c in ("fit", "peaks", "score"))
        group, owner, taken, layer = list(range(len(fit))), {}, {}, [0] * len(fit)

        def find(i: int) -> int:
            while group[i] != i:
                group[i] = i = group[group[i]]
            return i

        for i in sorted(range(len(fit)), key=lambda i: fit[i]):  # roots are the smallest of their group
            for p in peaks[i]:
                a, b = find(i), find(owner.setdefault(p, i))
                group[max(a, b, key=fit.__getitem__)] = min(a, b, key=fit.__getitem__)
        for i in sorted(range(len(fit)), key=lambda i: (not math.isnan(score[i]), -score[i], fit[i])):
            used = set().union(*(taken.get(p, ()) for p in peaks[i]))
            layer[i] = next(k for k in range(len(used) + 1) if k not in used)
            for p in peaks[i]:
                taken.setdefault(p, set()).add(layer[i])
        cluster = [fit[find(i)] for i in range(len(fit))]
        return spectrum.append_column("cluster", pa.array(cluster, pa.int64())).append_column("layer", pa.array(layer, pa.int32()))

    return fits.groupBy("scan_id").applyInArrow(kernel, schema)


def of_links(rows: DataFrame) -> DataFrame:
    """Fits from their links (scan_id, fit, n, score), one row for each peak."""
    return rows.groupBy("scan_id", "fit").agg(F.collect_set("n").alias("peaks"), F.max("score").alias("score"))


def layers(rows: DataFrame) -> DataFrame:
    """(scan_id, fit, layer) of links (scan_id, fit, n, score): :func:`laid`."""
    return laid(of_links(rows)).select("scan_id", "fit", "layer")


def greedy_rounds(rows: DataFrame) -> DataFrame:
    """(scan_id, fit): fits by falling score, the lower number on ties, where no better one taken shares a peak; ``rows`` are links."""
    return layers(rows).filter("layer = 0").select("scan_id", "fit")


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def terms(mz: np.ndarray, obs: np.ndarray, snr: np.ndarray, want: np.ndarray, theo: np.ndarray) -> np.ndarray:
    """:func:`massloom.functions.scoring.msdeconv_term` over arrays, for signals above 0."""
    accuracy = np.where((error := np.abs(mz - want)) <= 0.02, 1 - error / 0.02, 0.0)
    agreement = np.where(obs < theo, 1 - (theo - obs) / obs, np.sqrt(np.maximum(1 - (obs - theo) / obs, 0.0)))
    return np.where(snr < 1, 0.0, np.sqrt(theo) * accuracy * np.maximum(agreement, 0.0))


def solve_with_subtraction(members: DataFrame, rounds: int = 10, least: float = 0.0) -> DataFrame:
    """(scan_id, fit, round, score, signal, n_peaks): fits taken best first, each subtracted before others are scored again.

    ``members`` has scan_id, fit, n, want, mz, snr, intensity and weight (the
    share of the pattern), one row for each peak of each fit. In a round every
    fit is scored from the signal that is left: fits of fewer than two peaks
    with signal, or of a score not above ``least``, drop out; those that are
    best on all their peaks are taken and their theory is subtracted. A peak
    that would go below zero, or lose over 0.7 of its signal, is spent: its
    signal becomes 1 and it counts as missed from then on. At most ``rounds``
    rounds are made; what is left after them stays unsolved.
    """
    names = ["fit", "round", "score", "signal", "n_peaks"]

    def kernel(spectrum: pa.Table) -> pa.Table:
        scan, rows = spectrum.column("scan_id")[0].as_py(), spectrum.sort_by([("fit", "ascending"), ("want", "ascending")])
        fit, n, want, mz, snr, weight, y = (rows.column(c).to_numpy() for c in ("fit", "n", "want", "mz", "snr", "weight", "intensity"))
        out = []
        for number in range(rounds):
            live = y > 1
            fit, n, want, mz, snr, weight, y = (c[live] for c in (fit, n, want, mz, snr, weight, y))
            if not len(fit):
                break
            names_of, f = np.unique(fit, return_inverse=True)
            found, theory = np.bincount(f), weight * np.bincount(f, y)[f]
            several = found[f] > 1
            score = half_up(np.bincount(f, np.where(several, terms(mz, y, snr, want, theory), 0.0)) + 1e-9, 5)
            stays = several & (score[f] > least)
            fit, n, want, mz, snr, weight, y, theory, f = (c[stays] for c in (fit, n, want, mz, snr, weight, y, theory, f))
            if not len(fit):
                break
            place = np.empty(len(names_of), dtype=np.int64)
            place[np.lexsort((names_of, -score))] = np.arange(len(names_of))
            peaks, p = np.unique(n, return_inverse=True)
            best = np.full(len(peaks), len(names_of))
            np.minimum.at(best, p, place[f])
            lost = np.bincount(f, best[p] != place[f], len(names_of)) > 0
            takes = ~lost[f]
            took = np.unique(f[takes])
            out.append((names_of[took], np.full(len(took), number, dtype=np.int32), score[took], np.bincount(f, theory, len(names_of))[took], np.bincount(f, minlength=len(names_of))[took]))
            spent = np.full(len(peaks), -1.0)
            np.maximum.at(spent, p[takes], theory[takes])
            less = spent[p]
            rest = y - less
            y = np.where(less < 0, y, np.where((rest < 0) | (less > 0.7 * y), 1.0, half_up(rest, 6)))
            fit, n, want, mz, snr, weight, y = (c[~takes] for c in (fit, n, want, mz, snr, weight, y))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.array([], dtype=t) for t in (np.int64, np.int32, float, float, np.int64)]
        return pa.table({"scan_id": np.full(len(columns[0]), scan, dtype=np.int64), **dict(zip(names, columns, strict=True))})

    known = members.select("scan_id", "fit", "n", "want", "mz", F.col("snr").cast("double"), "weight", F.col("intensity").cast("double"))
    return known.groupBy("scan_id").applyInArrow(kernel, "scan_id long, fit long, round int, score double, signal double, n_peaks long")


def heaviest_paths(fits: DataFrame) -> DataFrame:
    """(scan_id, fit, weight): in each spectrum the fits of greatest total score whose m/z ranges [lo, hi] do not overlap, and that total.

    Weighted interval scheduling over each spectrum's stream of fits by end: a
    fit is taken if its score and the best total that ends before it exceed
    the best total without it. Totals are whole millionths, so that no order of
    summing matters. Streams follow each other in a partition; what
    is held is one spectrum's totals.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, ends, total, rows = None, [], [0], []

        def chosen() -> pa.RecordBatch:
            k, out = len(rows), []
            while k:
                fit, before, takes = rows[k - 1]
                if takes:
                    out.append(fit)
                k = before if takes else k - 1
            return pa.record_batch([pa.array([scan] * len(out), pa.int64()), pa.array(out, pa.int64()), pa.array([total[-1] / 1e6] * len(out), pa.float64())], ["scan_id", "fit", "weight"])

        for b in batches:
            for s, hi, lo, fit, score in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s != scan:
                    if rows:
                        yield chosen()
                    scan, ends, total, rows = s, [], [0], []
                before = bisect_left(ends, lo)  # fits that end before this one starts
                takes = total[before] + score > total[-1]
                rows.append((fit, before, takes))
                ends.append(hi)
                total.append(total[before] + score if takes else total[-1])
        if rows:
            yield chosen()

    ordered = fits.select("scan_id", "hi", "lo", F.col("fit").cast("long"), F.round(F.col("score") * 1e6).cast("long").alias("score")).repartition("scan_id").sortWithinPartitions("scan_id", "hi", "lo", "fit")
    return ordered.mapInArrow(kernel, "scan_id long, fit long, weight double")
