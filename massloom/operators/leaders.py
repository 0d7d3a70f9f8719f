"""Greedy clusters in long chains of masses: first members by cells of mass in rounds, then every row beside the first members near it."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massloom.operators.ordered import ordered_blocks
from massloom.plans.store import discard, materialize

#: Rows from which on a chain is cut into cells, and a cell's rows into parts.
LONG = 1000

#: Width of a cell, as a multiple of how far masses can lie apart and be near.
CELL = 8

HELD = "_row long, scan_id long, mass double, tic double, bins array<long>, values array<double>"


def vector(bins, values) -> tuple[dict, float]:
    v = dict(zip(bins, values, strict=True))
    return v, sum(x * x for x in v.values()) ** 0.5


class Leaders:
    """First members of clusters, in order of their masses."""

    def __init__(self, tolerance: float, similarity: float) -> None:
        self.tolerance, self.similarity = tolerance, similarity
        self.masses: list[float] = []
        self.held: list[tuple] = []

    def add(self, mass: float, number: int, v: dict, norm: float) -> None:
        i = bisect_left(self.masses, mass)
        self.masses.insert(i, mass)
        self.held.insert(i, (number, v, norm))

    def like(self, mass: float, v: dict, norm: float) -> Iterator[tuple[float, int]]:
        """(-similarity, number) of those near in mass that are similar enough."""
        i = bisect_left(self.masses, mass * (1 - 2 * self.tolerance))
        while i < len(self.masses) and self.masses[i] <= mass * (1 + 2 * self.tolerance):
            number, head, size = self.held[i]
            if abs(mass - self.masses[i]) <= self.masses[i] * self.tolerance and norm and size:
                s = sum(x * head.get(x_bin, 0.0) for x_bin, x in v.items()) / (norm * size)
                if s > self.similarity:
                    yield -s, number
            i += 1


def in_cells(rows: DataFrame, tolerance: float) -> DataFrame:
    """``cell`` of each row, counted from the chain's ``top`` mass down, and ``cells``, all those with masses that may be near it."""
    reach = max(-math.log1p(-min(tolerance, 1 - 1e-12)) * (1 + 1e-6), 1e-9)
    depth = F.coalesce(F.log("top") - F.log("mass"), F.lit(0.0))
    at = lambda x: F.greatest(F.floor(x / (CELL * reach)), F.lit(0))
    return rows.withColumn("cell", at(depth)).withColumn("cells", F.sequence(at(depth - reach), at(depth + reach)))


def first_copies(rows: DataFrame, similarity: float) -> DataFrame:
    """Rows without later copies of one chain, mass and spectrum.

    A copy is as similar to all others as the first is, and to the first
    itself, so it is never a first member. Rows that are not similar to
    themselves (no signal, for one) are all kept.
    """
    square = F.aggregate("values", F.lit(0.0), lambda total, x: total + x * x)
    plain = (F.col("mass") > 0) & square.between(1e-200, 1e200) & ~F.isnan("tic") & F.col("tic").isNotNull() & F.lit(similarity < 1 - 1e-9)
    alone = F.when(F.coalesce(plain, F.lit(False)), F.lit(None).cast("long")).otherwise(F.col("_row"))
    key = ["chain", "top", "mass", "bins", "values"]
    found = rows.groupBy(*key, alone.alias("_alone")).agg(F.min(F.struct((-F.col("tic")).alias("less"), "scan_id", "_row")).alias("_first"))
    return found.select(*key, (-F.col("_first.less")).alias("tic"), "_first.scan_id", "_first._row")


def first_members(rows: DataFrame, tolerance: float, similarity: float) -> DataFrame:
    """The first members of all clusters.

    Cells are gone through side by side, each with the rows beyond its border
    that are near. Of those it does not see what else is near them, so they
    and what hangs on them stay open for the next round, in which they are
    known from their own cells. The first open row of all is settled in
    every round, so the rounds end.
    """

    def kernel(batches):
        place = None
        for b in batches:
            kept, first = [], []
            for i, (chain, cell, home, known, mass, bins, values) in enumerate(zip(*(b.column(c).to_pylist() for c in ("chain", "_at", "cell", "first", "mass", "bins", "values")), strict=True)):
                if (chain, cell) != place:
                    place, heads, unsure = (chain, cell), Leaders(tolerance, similarity), Leaders(tolerance, similarity)
                v, norm = vector(bins, values)
                if not known and any(heads.like(mass, v, norm)):
                    continue
                known = known or (home == cell and not any(unsure.like(mass, v, norm)))
                (heads if known else unsure).add(mass, 0, v, norm)
                if home == cell:
                    kept.append(i)
                    first.append(known)
            out = b.take(pa.array(kept, pa.int64()))
            yield pa.record_batch([*(out.column(c) for c in columns), pa.array(first, pa.bool_())], [*columns, "first"])

    columns = ["chain", "cell", "cells", "_row", "scan_id", "mass", "tic", "bins", "values"]
    known = in_cells(first_copies(rows, similarity), tolerance).select(*columns, F.lit(False).alias("first"))
    before = None
    while True:
        seen = known.withColumn("_at", F.explode("cells")).repartition("chain", "_at").sortWithinPartitions("chain", "_at", F.desc("tic"), "scan_id", "_row")
        known = materialize(seen.mapInArrow(kernel, f"chain long, cell long, cells array<long>, {HELD}, first boolean"), "first-members")
        if before is not None:
            discard(before)
        if known.filter("NOT first").isEmpty():
            return known.drop("first")
        before = known


def numbered(heads: DataFrame) -> DataFrame:
    """First members with their place in the order of their chain, from 0, as ``number``."""
    b = ordered_blocks(heads.select("chain", "tic", "scan_id", "_row"), ["chain", F.desc("tic"), "scan_id", "_row"])
    n = b.groupBy("chain", "_block").agg(F.count("*").alias("_count"))
    before = n.select("chain", "_block", (F.sum("_count").over(W.partitionBy("chain").orderBy("_block")) - F.col("_count")).alias("_before"))
    own = b.withColumn("_own", F.row_number().over(W.partitionBy("_block", "chain").orderBy("_n")))
    return heads.join(own.join(before, ["chain", "_block"]).select("_row", (F.col("_own") + F.col("_before") - 1).cast("int").alias("number")), "_row")


def cluster_long(rows: DataFrame, tolerance: float, similarity: float) -> DataFrame:
    """(_row, cluster, similarity) of the rows (chain, top, _row, scan_id, mass, tic, bins, values) of long chains.

    A cell's rows are dealt over as many parts as LONG asks, but no more than
    let its first members, which every part gets, stay fewer than its rows.
    """
    heads = numbered(first_members(rows, tolerance, similarity)).withColumn("_at", F.explode("cells"))
    held = in_cells(rows, tolerance).withColumn("_at", F.col("cell"))
    sizes = held.groupBy("chain", "_at").agg(F.count("*").alias("n")).join(heads.groupBy("chain", "_at").agg(F.count("*").alias("h")), ["chain", "_at"])
    parts = sizes.select("chain", "_at", F.least(F.ceil(F.col("n") / LONG), F.floor(F.col("n") / F.col("h"))).alias("parts")).filter("parts > 1")
    deal = lambda df, part: df.join(F.broadcast(parts), ["chain", "_at"], "left").withColumn("part", part)
    count: Column = F.coalesce("parts", F.lit(1))
    columns = ["chain", "_at", "part", "number", "_row", "scan_id", "mass", "tic", "bins", "values"]
    all_rows = deal(held, F.pmod(F.xxhash64("_row"), count)).withColumn("number", F.lit(None).cast("int")).select(*columns)
    both = all_rows.unionByName(deal(heads, F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).select(*columns))
    dealt = both.repartition("chain", "_at", "part").sortWithinPartitions("chain", "_at", "part", F.desc("tic"), "scan_id", "_row", F.asc_nulls_last("number"))

    def kernel(batches):
        place = own = None
        for b in batches:
            row, cluster, score = [], [], []
            for chain, at, part, number, r, mass, bins, values in zip(*(b.column(c).to_pylist() for c in ("chain", "_at", "part", "number", "_row", "mass", "bins", "values")), strict=True):
                if (chain, at, part) != place:
                    place, own, leaders = (chain, at, part), None, Leaders(tolerance, similarity)
                v, norm = vector(bins, values)
                if number is not None:  # comes right before its own row
                    leaders.add(mass, number, v, norm)
                    own = r, number
                    continue
                less, best = (-1.0, own[1]) if own and own[0] == r else min(leaders.like(mass, v, norm))
                row.append(r)
                cluster.append(best)
                score.append(-less)
            yield pa.record_batch([pa.array(row, pa.int64()), pa.array(cluster, pa.int32()), pa.array(score, pa.float64())], ["_row", "cluster", "similarity"])

    return dealt.mapInArrow(kernel, "_row long, cluster int, similarity double")
