"""Features in three dimensions, merging of features by falling signal, and fragments of overlapping isolation windows.

What depends on its neighbours alone is cut into chains first: runs in a global
order without a gap above the reach of a match. Chains are found in ranges of
the order, however few values a charge or a window has, and each is then gone
through in its own stream.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.operators.joins import interval_join
from massloom.operators.ordered import next_where, sessionize


def chain_ids(rows: DataFrame, by: list[str], order: list, breaks: Column, name: str) -> DataFrame:
    """The rows with ``name``, the number of their chain in the whole order: a new one where ``breaks`` holds against ``_prev`` or a ``by`` column changes."""
    changed = F.lit(False)
    for c in by:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_prev.{c}"))
    return sessionize(rows, [], [*by, *order], changed | F.coalesce(breaks, F.lit(False)), name)


def trace_in_drift(points: DataFrame, tolerance: float = 1e-5, drift: float = 0.1) -> DataFrame:
    """(chain, id, feature, charge, mass, drift, time, intensity): peaks (all but the first and third) assigned to features in time order.

    A peak joins the feature of its charge whose mean mass is nearest, within
    ``tolerance`` of the peak's, and whose mean drift time lies within
    ``drift``; the earlier feature on ties. Else it begins one. Means are
    weighted by intensity. Rows of one time go by mass, then id; a peak
    without mass, charge or drift time is left out.

    Peaks are cut into chains by mass, those by drift time and those by mass
    again, so a dense charge does not come to one task.
    """
    rows = points.select("id", "charge", "mass", "drift", "time", "intensity").dropna(subset=["charge", "mass", "drift"])
    apart = (F.col("mass") - F.col("_prev.mass")) / F.col("mass") > 2 * tolerance
    far = F.col("drift") - F.col("_prev.drift") > 2 * drift
    rows = chain_ids(rows, ["charge"], ["mass", "id"], apart, "c1")
    rows = chain_ids(rows, ["c1"], ["drift", "id"], far, "c2")
    rows = chain_ids(rows, ["c2"], ["mass", "id"], apart, "chain").select("chain", "id", "mass", "drift", "time", "intensity", "charge")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, means, owner, drifts, total = None, [], [], [], []
        for b in batches:
            feature = []
            for c, mass, at, y in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 5)), strict=True):
                if c != chain:
                    chain, means, owner, drifts, total = c, [], [], [], []
                reach, best = mass * tolerance, None
                i = bisect_left(means, mass - reach)
                while i < len(means) and means[i] <= mass + reach:
                    found = (abs(means[i] - mass), owner[i], i)
                    if abs(drifts[owner[i]] - at) <= drift and (best is None or found < best):
                        best = found
                    i += 1
                if best is None:
                    f, mean = len(total), mass
                    drifts.append(at)
                    total.append(y)
                else:
                    _, f, i = best
                    total[f] += y
                    share = y / total[f] if total[f] else 0.0
                    mean = means[i] + (mass - means[i]) * share
                    drifts[f] += (at - drifts[f]) * share
                    del means[i], owner[i]
                i = bisect_left(means, mean)
                means.insert(i, mean)
                owner.insert(i, f)
                feature.append(f)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(feature, pa.int32()), *(b.column(k) for k in (6, 2, 3, 4, 5))], ["chain", "id", "feature", "charge", "mass", "drift", "time", "intensity"])

    kinds = dict(rows.dtypes)
    carried = ", ".join(f"{c} {kinds[c]}" for c in ("charge", "mass", "drift", "time", "intensity"))
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "chain").sortWithinPartitions("chain", "time", "mass", "id").mapInArrow(kernel, f"chain long, id long, feature int, {carried}")


def merge_by_signal(features: DataFrame, tolerance: float = 1e-5, by: tuple[str, ...] = ()) -> DataFrame:
    """(id, merged): features (id, value, start, end, total) in order of falling total, absorbed by the first that overlaps.

    A feature is absorbed by the one of lowest centre, of those merged so far,
    whose centre lies within ``tolerance`` of its value and whose time it
    overlaps; the centre then moves to the mean weighted by total and the time
    grows. Else it stands for itself. ``merged`` is the id of the absorber. Equal totals go
    by id; features of different ``by`` columns never meet.
    """
    rows = features.select(*by, "id", "value", "start", "end", F.coalesce("total", F.lit(0.0)).alias("total")).dropna(subset=["value"])
    apart = (F.col("value") - F.col("_prev.value")) / F.col("value") > tolerance
    chains = chain_ids(rows, list(by), ["value", "id"], apart, "chain").select("chain", "id", "value", "start", "end", "total")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, centres, held = None, [], []  # held: [id, start, end, total], in order of centre
        for b in batches:
            merged = []
            for c, i, value, start, end, total in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if c != chain:
                    chain, centres, held = c, [], []
                k = bisect_left(centres, value - value * tolerance)
                while k < len(centres) and centres[k] <= value + value * tolerance and not (held[k][1] <= end and start <= held[k][2]):
                    k += 1
                if k < len(centres) and centres[k] <= value + value * tolerance:
                    own, s, e, y = held.pop(k)
                    centre = centres.pop(k)
                    centre += (value - centre) * total / (y + total) if y + total else 0.0
                    own = [own, min(s, start), max(e, end), y + total]
                else:
                    own, centre = [i, start, end, total], value
                k = bisect_left(centres, centre)
                centres.insert(k, centre)
                held.insert(k, own)
                merged.append(own[0])
            yield pa.record_batch([b.column(1), pa.array(merged, pa.int64())], ["id", "merged"])

    return chains.repartition("chain").sortWithinPartitions("chain", F.desc("total"), "id").mapInArrow(kernel, "id long, merged long")


def window_atoms(windows: DataFrame, width: float) -> DataFrame:
    """(atom_lo, atom_hi, windows): the m/z ranges between neighbouring bounds of isolation windows (window, lo, hi), with the windows that cover each.

    ``width`` is near the usual width of a window; it changes the cost alone.
    """
    spans = windows.select("window", "lo", "hi").distinct()
    bounds = spans.select(F.explode(F.array("lo", "hi")).alias("atom_lo")).distinct()
    atoms = next_where(bounds, ["atom_lo"], F.lit(True), "atom_lo", "atom_hi").dropna()
    pairs = interval_join(atoms, spans, ("atom_lo", "atom_hi"), ("lo", "hi"), width).filter("lo <= atom_lo and atom_hi <= hi")
    return pairs.groupBy("atom_lo", "atom_hi").agg(F.sort_array(F.collect_set("window")).alias("windows"))


def assign_to_atoms(seen: DataFrame, atoms: DataFrame, key: list[str]) -> DataFrame:
    """(key, atom_lo, atom_hi, windows): the atoms that a fragment can come from, given the windows that hold it.

    ``seen`` has the key and ``window``, ``atoms`` is of :func:`window_atoms`. An
    atom qualifies if all of its windows hold the fragment, and stays if no
    other that qualifies has all of its windows and more.
    """
    kept = atoms_of_held(seen.groupBy(*key).agg(F.collect_set("window").alias("held")), atoms, key)
    return kept.select(*key, "atom_lo", "atom_hi", "windows")


def atoms_of_held(fragments: DataFrame, atoms: DataFrame, key: list[str]) -> DataFrame:
    """Each fragment, a row for each key with the windows ``held`` that hold it, once for each atom of :func:`assign_to_atoms`.

    Atoms are looked up by their first window; those of a fragment are compared with each other in its row.
    """
    others = [c for c in fragments.columns if c not in [*key, "held"]]
    able = fragments.withColumn("first", F.explode("held")).join(atoms.withColumn("first", F.col("windows")[0]), "first").filter(F.size(F.array_except("windows", "held")) == 0)
    found = able.groupBy(*key).agg(*[F.first(c).alias(c) for c in others], F.collect_list(F.struct("atom_lo", "atom_hi", "windows")).alias("able"))
    wider = lambda x: lambda y: (F.size(y["windows"]) > F.size(x["windows"])) & (F.size(F.array_except(x["windows"], y["windows"])) == 0)
    kept = F.filter("able", lambda x: ~F.exists("able", wider(x)))
    return found.withColumn("atom", F.explode(kept)).select(*key, *others, "atom.*")
