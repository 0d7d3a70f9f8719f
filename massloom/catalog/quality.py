"""Quality control of scans and peaks, and spectrum graphs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from massloom.catalog import query
from massloom.functions.scoring import xrea_parts
from massloom.operators.joins import best_match, range_join
from massloom.plans.views import view


@query("""WITH c AS (SELECT scan_id, intensity, sum(intensity) OVER (PARTITION BY scan_id ORDER BY intensity, mz, ord, part, charge ROWS UNBOUNDED PRECEDING) AS run FROM v_peak),
t AS (SELECT scan_id, sum(run) AS area, sum(intensity) AS total, count(*) AS n FROM c GROUP BY scan_id) SELECT scan_id, round(((n + 1) * total / 2.0 - area) / ((n + 1) * total / 2.0), 6) AS xrea FROM t""")
def xrea(spark, d):
    """How far the running total of ascending intensities lies below the straight line."""
    c = view(spark, d, "v_peak").withColumn("run", xrea_parts(F.col("intensity"), ["scan_id"], [F.col("mz"), F.col("ord"), F.col("part"), F.col("charge")]))
    t = c.groupBy("scan_id").agg(F.sum("run").alias("area"), F.sum("intensity").alias("total"), F.count("*").alias("n"))
    line = (F.col("n") + 1) * F.col("total") / 2
    return t.select("scan_id", F.round((line - F.col("area")) / line, 6).alias("xrea"))


WINDOW = "SELECT s.scan_id, precursor_mz AS pmz, s.charge AS z, mz, intensity FROM v_peak_scan s JOIN v_peak p ON s.scan_id = p.scan_id AND mz BETWEEN precursor_mz - 5 AND precursor_mz + 5"


def window(spark, d):
    s = view(spark, d, "v_peak_scan").select("scan_id", F.col("precursor_mz").alias("pmz"), F.col("charge").alias("z"))
    p = view(spark, d, "v_peak").select("scan_id", "mz", "intensity")
    return s.join(p, "scan_id").filter(F.col("mz").between(F.col("pmz") - 5, F.col("pmz") + 5))


@query(f"""WITH w AS ({WINDOW}) SELECT scan_id, round(least(1, greatest(0, coalesce(sum(intensity) FILTER (abs(mz - pmz) <= 1), 0) / sum(intensity))), 6) AS purity FROM w GROUP BY scan_id""")
def precursor_purity(spark, d):
    """The precursor's part of the signal in the isolation window."""
    own = F.coalesce(F.sum(F.when(F.abs(F.col("mz") - F.col("pmz")) <= 1, F.col("intensity"))), F.lit(0.0))
    return window(spark, d).groupBy("scan_id").agg(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), own / F.sum("intensity"))), 6).alias("purity"))


@query(f"""WITH w AS ({WINDOW}), t AS (SELECT *, max(intensity) OVER (PARTITION BY scan_id) AS top FROM w) SELECT scan_id, round(mz, 6) AS mz, intensity FROM t WHERE abs(mz - pmz) > 1 AND intensity > 0.1 * top""")
def coisolation(spark, d):
    """Other peaks of the window above a part of its strongest."""
    t = window(spark, d).withColumn("top", F.max("intensity").over(W.partitionBy("scan_id")))
    return t.filter((F.abs(F.col("mz") - F.col("pmz")) > 1) & (F.col("intensity") > 0.1 * F.col("top"))).select("scan_id", F.round("mz", 6).alias("mz"), "intensity")


@query(f"""WITH w AS ({WINDOW}) SELECT s.scan_id, coalesce(sum(w.intensity), 0) <= 1 AS is_empty FROM v_peak_scan s LEFT JOIN w ON s.scan_id = w.scan_id GROUP BY s.scan_id""")
def isolation_empty(spark, d):
    s = view(spark, d, "v_peak_scan").select("scan_id")
    return s.join(window(spark, d).select("scan_id", "intensity"), "scan_id", "left").groupBy("scan_id").agg((F.coalesce(F.sum("intensity"), F.lit(0.0)) <= 1).alias("is_empty"))


@query("""WITH t AS (SELECT DISTINCT target_mass FROM v_target), b AS (SELECT scan_id, max(intensity) AS base FROM v_peak GROUP BY scan_id)
SELECT p.scan_id, round(sum(intensity / base) / (SELECT count(*) FROM t), 6) AS ratio FROM v_peak p JOIN t ON abs(mz - target_mass) <= target_mass * 2e-5 JOIN b ON p.scan_id = b.scan_id GROUP BY p.scan_id""")
def signature_ratio(spark, d):
    """Signature ions' intensities over the base peak, averaged over the ions."""
    t = view(spark, d, "v_target").select("target_mass").distinct()
    p = view(spark, d, "v_peak").select("scan_id", "mz", "intensity").withColumn("base", F.max("intensity").over(W.partitionBy("scan_id")))
    n = t.agg(F.count("*").alias("n"))
    g = range_join(t, p, "target_mass", "mz", 2e-5).groupBy("scan_id").agg(F.sum(F.col("intensity") / F.col("base")).alias("total"))
    return g.join(F.broadcast(n)).select("scan_id", F.round(F.col("total") / F.col("n"), 6).alias("ratio"))


CHANNELS = [920.0, 930.0, 940.0]


@query(f"""WITH t AS (SELECT unnest({CHANNELS}) AS c), p AS (SELECT scan_id, c, intensity, row_number() OVER (PARTITION BY scan_id, c ORDER BY abs(mz - c), mz, intensity) AS r FROM v_peak JOIN t ON abs(mz - c) <= c * 5e-4)
SELECT scan_id, {", ".join(f"coalesce(max(intensity) FILTER (c = {c}), 0) AS c{int(c)}" for c in CHANNELS)} FROM p WHERE r = 1 GROUP BY scan_id""")
def reporter_pivot(spark, d):
    """The nearest peak of each reporter channel, one column for each."""
    t = spark.createDataFrame([(c,) for c in CHANNELS], "c double")
    pairs = range_join(t, view(spark, d, "v_peak").select("scan_id", "mz", "intensity"), "c", "mz", 5e-4)
    best = best_match(pairs, ["scan_id", "c"], F.abs(F.col("mz") - F.col("c")), F.col("mz"), F.col("intensity"))
    wide = best.groupBy("scan_id").pivot("c", CHANNELS).agg(F.max("intensity"))
    return wide.select("scan_id", *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(f"c{int(c)}") for c in CHANNELS])


@query("""WITH p AS (SELECT a.scan_id, a.charge AS za, b.charge AS zb FROM v_peak a JOIN v_peak b ON a.scan_id = b.scan_id AND abs(b.mz - (a.mz + 57.02146)) <= (a.mz + 57.02146) * 2e-5) SELECT za, zb, count(*) AS n FROM p GROUP BY za, zb""")
def delta_feature_rates(spark, d):
    """Pairs of peaks a residue mass apart, counted by the two charges."""
    p = view(spark, d, "v_peak").select("scan_id", "mz", "charge")
    q = p.select("scan_id", (F.col("mz") + 57.02146).alias("want"), F.col("charge").alias("za"))
    return range_join(q, p.withColumnRenamed("charge", "zb"), "want", "mz", 2e-5, ["scan_id"]).groupBy("za", "zb").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT scan_id, intensity / lag(intensity) OVER (PARTITION BY scan_id ORDER BY mz, intensity, ord, part) AS r FROM v_peak),
b AS (SELECT CASE WHEN r >= 5 THEN -4 WHEN r >= 2.5 THEN -3 WHEN r >= 1.7 THEN -2 WHEN r >= 1.3 THEN -1 WHEN r >= 1.0 THEN 0 WHEN r >= 0.8 THEN 1 WHEN r >= 0.6 THEN 2 WHEN r >= 0.4 THEN 3 WHEN r >= 0.2 THEN 4 ELSE 5 END AS bucket FROM n WHERE r IS NOT NULL) SELECT bucket, count(*) AS n FROM b GROUP BY bucket""")
def intensity_ratio_bucket(spark, d):
    """Neighbours' intensity ratios as ordinal classes."""
    w = W.partitionBy("scan_id").orderBy("mz", "intensity", "ord", "part")
    r = F.col("r")
    bucket = F.when(r >= 5, -4)
    for k, t in enumerate((2.5, 1.7, 1.3, 1.0, 0.8, 0.6, 0.4, 0.2)):
        bucket = bucket.when(r >= t, k - 3)
    n = view(spark, d, "v_peak").select((F.col("intensity") / F.lag("intensity").over(w)).alias("r")).dropna()
    return n.groupBy(bucket.otherwise(5).alias("bucket")).agg(F.count("*").alias("n"))


# fixed values: residue masses of six amino acids
RESIDUES = {"G": 57.02146, "A": 71.03711, "S": 87.03203, "P": 97.05276, "V": 99.06841, "T": 101.04768}
GRAPH = f"""WITH c AS (SELECT unnest({list(RESIDUES)}) AS residue, unnest({list(RESIDUES.values())}) AS m), p AS MATERIALIZED (SELECT scan_id, mz, CAST(floor(mz * 10) AS BIGINT) AS cell, row_number() OVER (PARTITION BY scan_id ORDER BY mz, intensity, ord, part) AS n FROM v_peak),
q AS (SELECT scan_id, n AS a, residue, mz + m AS want, unnest([CAST(floor((mz + m) * 10) AS BIGINT) - 1, CAST(floor((mz + m) * 10) AS BIGINT), CAST(floor((mz + m) * 10) AS BIGINT) + 1]) AS cell FROM p, c),
g AS (SELECT q.scan_id, q.a, b.n AS b, residue FROM q JOIN p b ON q.scan_id = b.scan_id AND q.cell = b.cell AND abs(b.mz - want) <= want * 2e-5)"""


def graph(spark, d):
    p = view(spark, d, "v_peak").select("scan_id", "mz", F.row_number().over(W.partitionBy("scan_id").orderBy("mz", "intensity", "ord", "part")).cast("long").alias("n"))
    steps = F.explode(F.array(*[F.struct(F.lit(r).alias("residue"), F.lit(m).alias("m")) for r, m in RESIDUES.items()]))
    q = p.select("scan_id", F.col("n").alias("a"), "mz", steps.alias("s")).select("scan_id", "a", "s.residue", (F.col("mz") + F.col("s.m")).alias("want"))
    return range_join(q, p.select("scan_id", "mz", F.col("n").alias("b")), "want", "mz", 2e-5, ["scan_id"], spread="found").select("scan_id", "a", "b", "residue")


@query(f"{GRAPH} SELECT scan_id, a, b, residue FROM g")
def graph_edges(spark, d):
    """Pairs of peaks a residue mass apart: the edges of a spectrum graph."""
    return graph(spark, d)


@query("""WITH p AS (SELECT v.scan_id, mz, precursor_mz * 2 AS total FROM v_peak v JOIN v_peak_scan s ON v.scan_id = s.scan_id) SELECT a.scan_id, count(*) AS pairs FROM p a JOIN p b ON a.scan_id = b.scan_id AND a.total - a.mz > 0 AND abs(b.mz - (a.total - a.mz)) <= (a.total - a.mz) * 2e-5 GROUP BY a.scan_id""")
def graph_complements(spark, d):
    """Pairs of peaks that add up to the precursor."""
    s = view(spark, d, "v_peak_scan").select("scan_id", (F.col("precursor_mz") * 2).alias("total"))
    p = view(spark, d, "v_peak").select("scan_id", "mz")
    q = p.join(s, "scan_id").select("scan_id", (F.col("total") - F.col("mz")).alias("want"))
    return range_join(q, p, "want", "mz", 2e-5, ["scan_id"]).groupBy("scan_id").agg(F.count("*").alias("pairs"))


def longest_to(edges):
    """(scan_id, node, length): the steps (a, b), a < b, of the longest path that ends at each node.

    Edges go up in mass, so in a spectrum's stream of edges by rising start all
    that lead to a node come before those that leave it: one pass, no rounds.
    """

    def kernel(batches):
        scan, length = None, {}

        def told(scan):
            return pa.record_batch([pa.array([scan] * len(length), pa.int64()), pa.array(list(length), pa.int64()), pa.array(list(length.values()), pa.int64())], ["scan_id", "node", "length"])

        for batch in batches:
            for s, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != scan:
                    if length:
                        yield told(scan)
                    scan, length = s, {}
                length[b] = max(length.get(b, 0), length.get(a, 0) + 1)
        if length:
            yield told(scan)

    streams = edges.select("scan_id", "a", "b").repartition("scan_id").sortWithinPartitions("scan_id", "a", "b")
    return streams.mapInArrow(kernel, "scan_id long, node long, length long")


@query(GRAPH.replace("WITH c AS", "WITH RECURSIVE c AS", 1) + """, r(scan_id, b, len) AS (SELECT scan_id, b, 1 FROM g UNION SELECT r.scan_id, g.b, r.len + 1 FROM r JOIN g ON r.scan_id = g.scan_id AND r.b = g.a) SELECT scan_id, b AS node, CAST(max(len) AS BIGINT) AS length FROM r GROUP BY scan_id, b""")
def graph_path_lengths(spark, d):
    """The longest path that ends at each node."""
    return longest_to(graph(spark, d))
