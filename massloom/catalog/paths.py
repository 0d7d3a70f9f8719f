"""Paths through spectrum graphs and the denoiser built on their edges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from massloom.catalog import query
from massloom.catalog.quality import GRAPH, graph, longest_to
from massloom.operators.joins import range_join
from massloom.plans.store import materialize
from massloom.plans.views import view

#: Distinct steps; all paths from where no step ends to where none starts, with their nodes and residues.
STEPS = GRAPH.replace("WITH c AS", "WITH RECURSIVE c AS", 1) + """, st AS MATERIALIZED (SELECT scan_id, a, b, min(residue) AS residue FROM g GROUP BY scan_id, a, b)"""
PATHS = STEPS + """, walk(scan_id, nodes, tag) AS (SELECT scan_id, [a, b], residue FROM st s WHERE NOT EXISTS (SELECT 1 FROM st p WHERE p.scan_id = s.scan_id AND p.b = s.a)
UNION ALL SELECT w.scan_id, list_append(nodes, s.b), tag || residue FROM walk w JOIN st s ON s.scan_id = w.scan_id AND s.a = nodes[-1]),
path AS MATERIALIZED (SELECT * FROM walk w WHERE NOT EXISTS (SELECT 1 FROM st s WHERE s.scan_id = w.scan_id AND s.a = w.nodes[-1]))"""


def steps(spark, d):
    """(scan_id, a, b, residue): one step for each pair of peaks, of the first residue by name."""
    return graph(spark, d).groupBy("scan_id", "a", "b").agg(F.min("residue").alias("residue"))


def all_paths(spark, d):
    """(scan_id, nodes, tag): every path from a peak that no step ends at to one that none starts from.

    Paths grow by one step a round, for all spectra at once; steps go up in
    mass, so this ends. Paths may grow in number with every step: a spectrum of
    more than MOST_PATHS of them is refused before any is made.
    """
    st = materialize(steps(spark, d), "path-steps")
    starts = path_counts(st).join(st.select("scan_id", F.col("b").alias("node")).distinct(), ["scan_id", "node"], "left_anti")
    many = starts.groupBy("scan_id").agg(F.sum("n_paths").alias("n")).filter(F.col("n") > MOST_PATHS).limit(1).collect()
    if many:
        raise ValueError(f"spectrum {many[0].scan_id} has {many[0].n} paths, more than {MOST_PATHS}; count them instead")
    ends = st.select("scan_id", F.col("b").alias("a")).distinct()
    front = st.join(ends, ["scan_id", "a"], "left_anti").select("scan_id", F.array("a", "b").alias("nodes"), F.col("residue").alias("tag"))
    front, done = materialize(front, "path-front"), None
    while not front.isEmpty():
        at = front.withColumn("a", F.element_at("nodes", -1))
        over = at.join(st.select("scan_id", "a").distinct(), ["scan_id", "a"], "left_anti").select("scan_id", "nodes", "tag")
        done = over if done is None else done.unionByName(over)
        grown = at.join(st, ["scan_id", "a"]).select("scan_id", F.concat("nodes", F.array("b")).alias("nodes"), F.concat("tag", "residue").alias("tag"))
        front = materialize(grown, "path-front")
    return front.select("scan_id", "nodes", "tag") if done is None else done


#: Paths of one spectrum that are enumerated; counts have no such bound.
MOST_PATHS = 1_000_000


def path_counts(edges):
    """(scan_id, node, n_paths, longest): for every node with a step (a, b), a < b, the paths from it to where no step starts, and the steps of the longest.

    Dynamic programming over each spectrum's stream of steps by falling ``a``:
    what lies behind a step is known when it comes. No path is enumerated.
    """

    def kernel(batches):
        scan, counts, longest = None, {}, {}

        def told_of(scan):
            if max(counts.values(), default=0) >= 1 << 63:
                raise OverflowError(f"spectrum {scan} has 2**63 paths or more")
            nodes = list(longest)
            return pa.record_batch([pa.array([scan] * len(nodes), pa.int64()), pa.array(nodes, pa.int64()), pa.array([counts[n] for n in nodes], pa.int64()), pa.array([longest[n] for n in nodes], pa.int64())], ["scan_id", "node", "n_paths", "longest"])

        for b in batches:
            for s, a, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s != scan:
                    if longest:
                        yield told_of(scan)
                    scan, counts, longest = s, {}, {}
                counts[a] = counts.get(a, 0) + counts.get(z, 1)
                longest[a] = max(longest.get(a, 0), longest.get(z, 0) + 1)
        if longest:
            yield told_of(scan)

    streams = edges.select("scan_id", "a", "b").repartition("scan_id").sortWithinPartitions("scan_id", F.desc("a"), "b")
    return streams.mapInArrow(kernel, "scan_id long, node long, n_paths long, longest long")


def told(nodes):
    return F.array_join(F.transform(nodes, lambda x: x.cast("string")), "-")


TOLD = "array_to_string(nodes, '-')"


@query(f"{STEPS} SELECT scan_id, a, count(*) AS degree, min(b) AS first, max(b) AS last FROM st GROUP BY scan_id, a")
def graph_adjacency(spark, d):
    """The rows of each spectrum graph's adjacency: out-degree, first and last neighbour."""
    return steps(spark, d).groupBy("scan_id", "a").agg(F.count("*").alias("degree"), F.min("b").alias("first"), F.max("b").alias("last"))


@query(f"{STEPS}, n AS (SELECT scan_id, a AS node FROM st UNION SELECT scan_id, b FROM st), r(scan_id, b, len) AS (SELECT scan_id, b, 1 FROM st UNION SELECT r.scan_id, st.b, r.len + 1 FROM r JOIN st ON r.scan_id = st.scan_id AND r.b = st.a), l AS (SELECT scan_id, b AS node, max(len) AS level FROM r GROUP BY scan_id, b) SELECT n.scan_id, n.node, CAST(coalesce(level, 0) AS BIGINT) AS level, row_number() OVER (PARTITION BY n.scan_id ORDER BY coalesce(level, 0), n.node) AS place FROM n LEFT JOIN l ON l.scan_id = n.scan_id AND l.node = n.node")
def graph_topological_order(spark, d):
    """Nodes in topological order: by the longest path that leads to them, then by mass."""
    st = materialize(steps(spark, d), "path-steps")
    nodes = st.select("scan_id", F.col("a").alias("node")).union(st.select("scan_id", "b")).distinct()
    level = F.coalesce("length", F.lit(0).cast("long"))
    out = nodes.join(longest_to(st), ["scan_id", "node"], "left").select("scan_id", "node", level.alias("level"))
    return out.withColumn("place", F.row_number().over(W.partitionBy("scan_id").orderBy("level", "node")).cast("long"))


@query(f"{PATHS} SELECT scan_id, {TOLD} AS nodes, tag FROM path")
def graph_paths(spark, d):
    """Every path of every spectrum graph with the residues it spells: sequence tags."""
    return all_paths(spark, d).select("scan_id", told("nodes").alias("nodes"), "tag")


@query(f"{PATHS} SELECT scan_id, nodes[1] AS node, count(*) AS n_paths, CAST(max(len(nodes)) - 1 AS BIGINT) AS longest FROM path GROUP BY scan_id, nodes[1]")
def paths_starting_at(spark, d):
    """How many paths start at each node, and the steps of the longest."""
    st = materialize(steps(spark, d), "path-steps")
    return path_counts(st).join(st.select("scan_id", F.col("b").alias("node")).distinct(), ["scan_id", "node"], "left_anti")


@query(f"{PATHS} SELECT scan_id, nodes[-1] AS node, count(*) AS n_paths, CAST(max(len(nodes)) - 1 AS BIGINT) AS longest FROM path GROUP BY scan_id, nodes[-1]")
def paths_ending_at(spark, d):
    """How many paths end at each node, and the steps of the longest."""
    st = materialize(steps(spark, d), "path-steps")
    back = path_counts(st.select("scan_id", (-F.col("b")).alias("a"), (-F.col("a")).alias("b"))).withColumn("node", -F.col("node"))
    return back.join(st.select("scan_id", F.col("a").alias("node")).distinct(), ["scan_id", "node"], "left_anti")


CLOSED = f"{PATHS}, closed AS (SELECT * FROM path p WHERE NOT EXISTS (SELECT 1 FROM path o WHERE o.scan_id = p.scan_id AND len(o.nodes) > len(p.nodes) AND list_has_all(o.nodes, p.nodes)))"


def closed_paths(spark, d):
    """The paths whose nodes are not all on a longer path; longer ones are looked up by a path's first node."""
    p = materialize(all_paths(spark, d).withColumn("first", F.get("nodes", F.lit(0))), "paths")
    longer = p.select("scan_id", F.explode("nodes").alias("first"), F.col("nodes").alias("other"))
    inside = p.join(longer, ["scan_id", "first"]).filter((F.size("other") > F.size("nodes")) & (F.size(F.array_except("nodes", "other")) == 0))
    return p.join(inside.select("scan_id", "nodes").distinct(), ["scan_id", "nodes"], "left_anti")


@query(f"{CLOSED} SELECT scan_id, {TOLD} AS nodes, tag FROM closed")
def transitive_closure(spark, d):
    """Paths that are no strict subset of another."""
    return closed_paths(spark, d).select("scan_id", told("nodes").alias("nodes"), "tag")


@query(f"{CLOSED}, r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY len(nodes) DESC, {TOLD}) AS place FROM closed) SELECT scan_id, place, {TOLD} AS nodes, tag FROM r WHERE place <= 20")
def longest_paths(spark, d):
    """The longest paths of each spectrum that are no subset of another, 20 at most."""
    c = closed_paths(spark, d).select("scan_id", F.size("nodes").alias("n"), told("nodes").alias("nodes"), "tag")
    place = F.row_number().over(W.partitionBy("scan_id").orderBy(F.desc("n"), "nodes")).cast("long")
    return c.withColumn("place", place).filter("place <= 20").select("scan_id", "place", "nodes", "tag")


@query(f"{PATHS} SELECT scan_id, nodes[1] AS start_node, nodes[-1] AS end_node, count(*) AS n_paths, string_agg(tag, '|' ORDER BY tag) AS tags FROM path GROUP BY ALL")
def parallel_paths(spark, d):
    """Paths that share both ends, merged with the tags of all."""
    p = all_paths(spark, d).groupBy("scan_id", F.get("nodes", F.lit(0)).alias("start_node"), F.element_at("nodes", -1).alias("end_node"))
    return p.agg(F.count("*").alias("n_paths"), F.array_join(F.sort_array(F.collect_list("tag")), "|").alias("tags"))


# fixed values: masses of water and of ammonia
LOSSES = [18.010565, 17.026549]
KEPT = f"""{GRAPH}, e AS (SELECT scan_id, a AS n FROM g UNION SELECT scan_id, b FROM g), pre AS (SELECT p.scan_id, p.n FROM p JOIN v_peak_scan s ON s.scan_id = p.scan_id AND (abs(p.mz - s.precursor_mz) <= s.precursor_mz * 2e-4 OR abs(p.mz - (s.precursor_mz - {LOSSES[0]})) <= (s.precursor_mz - {LOSSES[0]}) * 2e-4)),
k AS MATERIALIZED (SELECT * FROM e UNION SELECT * FROM pre), loss AS (SELECT l.scan_id, l.n FROM k JOIN p h ON h.scan_id = k.scan_id AND h.n = k.n JOIN p l ON l.scan_id = h.scan_id AND ({" OR ".join(f"abs(l.mz - (h.mz - {x})) <= (h.mz - {x}) * 2e-5" for x in LOSSES)}))"""


def precursor_nodes(spark, d, p):
    """Peaks at the precursor and at its loss of water."""
    s = view(spark, d, "v_peak_scan").select("scan_id", F.explode(F.array(F.col("precursor_mz"), F.col("precursor_mz") - LOSSES[0])).alias("want"))
    return range_join(s, p, "want", "mz", 2e-4, ["scan_id"]).select("scan_id", "n").distinct()


def ordered_peaks(spark, d):
    return view(spark, d, "v_peak").select("scan_id", "mz", F.row_number().over(W.partitionBy("scan_id").orderBy("mz", "intensity", "ord", "part")).cast("long").alias("n"))


def loss_nodes(kept, p):
    """Peaks a neutral loss below the peaks that are kept."""
    want = kept.join(p, ["scan_id", "n"]).select("scan_id", F.explode(F.array(*[F.col("mz") - x for x in LOSSES])).alias("want"))
    return range_join(want, p, "want", "mz", 2e-5, ["scan_id"]).select("scan_id", "n").distinct()


@query(f"{KEPT} SELECT scan_id, n AS node FROM pre")
def find_precursor_peak(spark, d):
    """The precursor's own peaks, with or without a loss of water."""
    return precursor_nodes(spark, d, ordered_peaks(spark, d)).select("scan_id", F.col("n").alias("node"))


@query(f"{KEPT} SELECT DISTINCT scan_id, n AS node FROM loss")
def find_loss_peaks(spark, d):
    """Neutral losses of peaks on edges."""
    p, g = ordered_peaks(spark, d), materialize(graph(spark, d).select("scan_id", "a", "b"), "graph-edges")
    kept = g.select("scan_id", F.col("a").alias("n")).union(g.select("scan_id", "b")).union(precursor_nodes(spark, d, p)).distinct()
    return loss_nodes(kept, p).select("scan_id", F.col("n").alias("node"))


@query(f"{KEPT}, f AS (SELECT * FROM k UNION SELECT * FROM loss) SELECT scan_id, count(*) AS n_kept, min(n) AS first, max(n) AS last FROM f GROUP BY scan_id")
def graph_denoise(spark, d):
    """Peaks that a denoiser keeps: those on residue edges, the precursor's and their neutral losses."""
    p, g = ordered_peaks(spark, d), materialize(graph(spark, d).select("scan_id", "a", "b"), "graph-edges")
    kept = g.select("scan_id", F.col("a").alias("n")).union(g.select("scan_id", "b")).union(precursor_nodes(spark, d, p)).distinct()
    out = kept.union(loss_nodes(kept, p)).distinct()
    return out.groupBy("scan_id").agg(F.count("*").alias("n_kept"), F.min("n").alias("first"), F.max("n").alias("last"))
