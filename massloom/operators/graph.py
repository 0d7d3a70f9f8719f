"""Graph operators over edge tables."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.plans.store import discard, materialize


#: A vertex is a hub from this many edges on, and from one in so many of all edges: there are few hubs, however large the graph.
HUB, HUB_SHARE = 1000, 1 << 16


def lookup(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """``rows`` with what ``table`` holds for their key, each key once; rows of ``hot`` keys meet it by broadcast, so that they need not gather in one task."""
    if hot is None:
        return rows.join(table, key)
    hot = F.broadcast(hot)
    few = F.broadcast(table.join(hot, key))
    return rows.join(few, key).unionByName(rows.join(hot, key, "left_anti").join(table, key))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id for every id that an edge touches: ``(id, component)``.

    Minimum-label hooking with pointer jumping. Each round every vertex takes
    the smallest label of its neighbours, then labels jump to their own
    label's label, so the rounds needed grow with the logarithm of the longest
    path. Labels are aggregated with a combinable ``min``; a vertex with very
    many neighbours never gathers them in one task. Each round is cut through
    a table in the shared folder.

    Self loops are kept as single vertices, null ends are dropped, and an
    empty edge table gives an empty result.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).dropna()
    both = materialize(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    label = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")), "cc-label")
    limit = max(HUB, both.count() // HUB_SHARE)
    hubs = materialize(both.groupBy("b").agg(F.count("*").alias("c")).filter(F.col("c") > limit).select("b"), "cc-hubs")
    hot = None if hubs.isEmpty() else hubs
    for _ in range(max_rounds):
        seen = lookup(both, label.select(F.col("a").alias("b"), "l"), "b", hot).groupBy("a").agg(F.min("l").alias("m"))
        hooked = label.join(seen, "a").select("a", F.least("l", "m").alias("n"), "l")
        common = None
        if hot is not None:  # labels that many vertices have by now, and the hubs
            hooked = materialize(hooked, "cc-hooked")
            common = hooked.groupBy("n").agg(F.count("*").alias("c")).filter(F.col("c") > limit).select("n")
        up = hooked.select(F.col("a").alias("n"), F.col("n").alias("r"))
        jumped = lookup(hooked, up, "n", common).select("a", F.least("r", "n").alias("n"), "l")
        # a label that fell tells its old root too, else two trees meet one step a round
        roots = jumped.groupBy(F.col("l").alias("a")).agg(F.min("n").alias("t"))
        nxt = materialize(jumped.join(roots, "a", "left").select("a", F.least("n", F.coalesce("t", "n")).alias("l"), F.col("l").alias("was")), "cc-label")
        moved = nxt.filter("l <> was").limit(1).count()
        discard(label, *([] if common is None else [hooked]))
        label = nxt.select("a", "l")
        if not moved:
            break
    else:
        raise RuntimeError(f"labels still move after {max_rounds} rounds")
    discard(both, hubs)
    return label.select(F.col("a").alias("id"), F.col("l").alias("component"))


#: Cells of values whose members may be near those of a cell, and of pairs of values, each pair of cells once; the cell itself is the first.
CELLS, CELLS_2 = [(0, 0), (1, 0), (2, 0)], [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1), (2, -1), (2, 0), (2, 1)]


def linking_edges(features: DataFrame, cell: Column, near: Callable, may: Callable, by: list[str] | None = None, bridge: float = 0.0, also: tuple[str, float] | None = None) -> DataFrame:
    """(a, b): some of the pairs of features that are near in value and overlap in time, enough to connect what all of them connect.

    ``features`` has id, value, s and e, and the ``by`` columns that both of a
    pair share; ``bridge`` stretches the times. ``near(x, i, y, j)`` tells
    whether values x <= y of ids i and j are near, ``may(x, y)`` whether they
    could be under any ids; near values hold for closer ones of the same ids.
    ``cell`` numbers the values so that all of one cell are near each other and
    none is near one of three cells off. ``also`` names a second value that may
    differ by so much; its cells are as wide, and the pair has to be near in both.

    All features of a cell that last at one time are near each other. So one
    that starts then needs one link to its own cell and one to each other cell
    that has a near one: links grow as the features do, where pairs grow as
    their square. A cell goes by in order of start, what is held is what lasts.
    """
    by, cells = by or [], CELLS_2 if also else CELLS
    reach = also[1] if also else 0.0

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, lasting = None, []
        for batch in batches:
            pairs = []
            for *g, off, i, v, s, e, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    group, lasting = g, [[] for _ in cells]  # for each cell off: [(value, id, end, second value)], by value
                for k, held in enumerate(lasting):
                    if off and k:
                        continue  # such links are made where one of the cells is the first
                    up = k >= off  # the held ones are higher, but where only the second cell is another
                    level = cells[k][0] == cells[off][0]
                    at = 0 if up else len(held) - 1
                    while 0 <= at < len(held):
                        w, j, end, y = held[at]
                        if end + bridge < s:
                            del held[at]
                            at -= 0 if up else 1
                            continue
                        if (level or (near(v, i, w, j) if up else near(w, j, v, i))) and abs(x - y) <= reach:
                            pairs.append((i, j))
                            break
                        if not level and not (may(v, w) if up else may(w, v)):
                            break
                        at += 1 if up else -1
                own = lasting[off]
                own.insert(bisect_left(own, (v, i)), (v, i, e, x))
            yield pa.record_batch([pa.array([min(p) for p in pairs], pa.int64()), pa.array([max(p) for p in pairs], pa.int64())], ["a", "b"])

    second = F.col(also[0]).cast("double") if also else F.lit(0.0)
    cell_2 = F.floor(second / reach).cast("long") if also else F.lit(0).cast("long")
    spread = features.select(*by, cell.cast("long").alias("_cell"), cell_2.alias("_cell2"), "id", "value", "s", "e", second.alias("_also")).dropna(subset=["_cell", "_cell2", "s", "e"])
    offs = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(i).alias("i"), F.lit(j).alias("j")) for n, (i, j) in enumerate(cells)]))
    spread = spread.withColumn("_off", offs).select(*by, (F.col("_cell") - F.col("_off.i")).alias("_cell"), (F.col("_cell2") - F.col("_off.j")).alias("_cell2"), F.col("_off.n").alias("_off"), "id", "value", "s", "e", "_also")
    n = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartition(n, *by, "_cell", "_cell2").sortWithinPartitions(*by, "_cell", "_cell2", "s", "id").mapInArrow(kernel, "a long, b long")


#: Vertices that a task holds while it joins links.
HELD = 1 << 19


def linked_components(edges: DataFrame, held: int = HELD) -> DataFrame:
    """What :func:`connected_components` returns, for links a, b of which those of one component mostly lie in the same partition.

    A task joins what its links connect, ``held`` vertices at a time, and gives
    each vertex the least one of its part. Rounds over tables then connect
    those alone: few, where links were made cell by cell.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(i):
            while (j := up.setdefault(i, i)) != i:
                up[i] = i = up[j]
            return i

        def parts():
            return pa.record_batch([pa.array(list(up), pa.int64()), pa.array([root(i) for i in up], pa.int64())], ["id", "root"])

        for batch in batches:
            for i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(i), root(j)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) >= held:
                yield parts()
                up.clear()
        if up:
            yield parts()

    parts = edges.select("a", "b").dropna().mapInArrow(kernel, "id long, root long")
    of = materialize(parts.groupBy("id").agg(F.sort_array(F.collect_set("root")).alias("roots")), "cc-parts")
    links = of.select(F.col("roots")[0].alias("a"), F.explode("roots").alias("b")).distinct()
    label = connected_components(links, "a", "b").withColumnRenamed("id", "root")
    return of.select("id", F.col("roots")[0].alias("root")).join(label, "root").select("id", "component")
