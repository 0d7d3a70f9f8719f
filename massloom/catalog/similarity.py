"""Spectrum similarity, grouping and consensus."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from massloom.catalog import query
from massloom.functions.mass import ratio
from massloom.operators.ordered import sessionize, top_k
from massloom.operators.pairing import matched_pairs, products, spectra_of
from massloom.plans.views import view

#: Spectra are compared where their precursors lie this close (m/z).
NEAR = 50.0
BINS = "WITH b AS (SELECT p.scan_id, any_value(s.precursor_mz) AS m, CAST(floor(mz) AS BIGINT) AS bin, sum(intensity) AS i FROM v_peak p JOIN v_peak_scan s ON p.scan_id = s.scan_id GROUP BY p.scan_id, floor(mz)), n AS (SELECT scan_id, sqrt(sum(i * i)) AS norm FROM b GROUP BY scan_id)"
DOTS = f"d AS (SELECT x.scan_id AS a, y.scan_id AS b, sum(x.i * y.i) AS dot FROM b x JOIN b y ON x.bin = y.bin AND x.scan_id < y.scan_id AND abs(y.m - x.m) <= {NEAR} GROUP BY ALL)"


def peaks_with_precursor(spark, d):
    return view(spark, d, "v_peak").join(view(spark, d, "v_peak_scan").select("scan_id", F.col("precursor_mz").alias("m")), "scan_id")


def binned(spark, d):
    return peaks_with_precursor(spark, d).groupBy("scan_id", "m", F.floor("mz").alias("bin")).agg(F.sum("intensity").alias("i"))


def cosine(spark, d):
    """Cosine of all pairs of spectra whose precursors are near and that have a bin in common: products of blocks of spectra, which alone are shuffled."""
    s = spectra_of(binned(spark, d).select("scan_id", "m", F.col("bin").cast("double").alias("mz"), "i"))
    return products(s, NEAR, 0.0, own_norm=False).select("a", "b", ratio(F.col("dot"), F.sqrt("norm_a") * F.sqrt("norm_b")).alias("s"))


@query(f"""{BINS}, {DOTS}
SELECT a, b, round(dot / (p.norm * q.norm), 6) AS similarity FROM d JOIN n p ON p.scan_id = a JOIN n q ON q.scan_id = b""")
def cosine_binned(spark, d):
    """Cosine over truncated m/z bins, for spectra of near precursors."""
    return cosine(spark, d).select("a", "b", F.round("s", 6).alias("similarity"))


@query(f"""WITH p AS (SELECT v.scan_id, mz, intensity AS i, precursor_mz AS m FROM v_peak v JOIN v_peak_scan s ON v.scan_id = s.scan_id),
c AS (SELECT x.scan_id AS a, y.scan_id AS b, sum(x.i * y.i) AS dot FROM p x JOIN p y ON abs(y.mz - x.mz) <= x.mz * 2e-5 AND abs(y.m - x.m) <= {NEAR} GROUP BY ALL)
SELECT c.a, c.b, round(c.dot / sqrt(s.dot) / sqrt(t.dot), 6) AS similarity FROM c JOIN c s ON s.a = c.a AND s.b = c.a JOIN c t ON t.a = c.b AND t.b = c.b WHERE c.a < c.b""")
def cosine_ppm(spark, d):
    """Products of all peaks matched within tolerance, normalised by each spectrum's own, for spectra of near precursors."""
    p = peaks_with_precursor(spark, d).select("scan_id", "m", "mz", F.col("intensity").alias("i"))
    c = products(spectra_of(p), NEAR, 2e-5, own_norm=True)
    return c.select("a", "b", F.round(ratio(ratio(F.col("dot"), F.sqrt("norm_a")), F.sqrt("norm_b")), 6).alias("similarity"))


SHIFTED = f"""WITH p AS (SELECT v.scan_id, mz, intensity AS i, precursor_mz AS m FROM v_peak v JOIN v_peak_scan s ON v.scan_id = s.scan_id),
c AS (SELECT x.scan_id AS a, y.scan_id AS b, y.m - x.m AS shift, CASE WHEN abs(y.mz - x.mz) <= x.mz * 5e-5 THEN 'direct' ELSE 'shifted' END AS kind, x.i * y.i AS w FROM p x JOIN p y ON x.scan_id < y.scan_id AND abs(y.m - x.m) <= {NEAR} AND (abs(y.mz - x.mz) <= x.mz * 5e-5 OR (x.mz + y.m - x.m > 0 AND abs(y.mz - (x.mz + y.m - x.m)) <= (x.mz + y.m - x.m) * 5e-5)))"""


def aligned_pairs(spark, d):
    """Pairs of spectra of near precursors with their matched peaks, direct or moved by the precursors' difference, each pair once."""
    return matched_pairs(peaks_with_precursor(spark, d).select("scan_id", "m", "mz", F.col("intensity").alias("i")), NEAR, 5e-5)


@query(f"{SHIFTED} SELECT a, b, kind, count(*) AS n, sum(w) AS product FROM c GROUP BY a, b, kind")
def modified_cosine(spark, d):
    """Direct matches and matches shifted by the precursors' difference, each pair once, for spectra of near precursors."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").alias("n"), F.col(k).alias("product")) for k in ("direct", "shifted")]))
    return aligned_pairs(spark, d).select("a", "b", kinds.alias("x")).select("a", "b", "x.*").filter("n > 0")


ALIGNED = f"""{SHIFTED}, n AS (SELECT scan_id, sum(i * i) AS norm FROM p GROUP BY scan_id), q AS (SELECT a, b, round(any_value(shift), 4) AS shift, round(sum(w), 3) AS weight FROM c GROUP BY a, b),
e AS (SELECT a, b, shift, weight, round(weight / sqrt(x.norm * y.norm), 6) AS score FROM q JOIN n x ON x.scan_id = a JOIN n y ON y.scan_id = b WHERE abs(shift) >= 0.02)"""


def alignment(spark, d):
    """(a, b, shift, weight, score): aligned spectra whose precursors differ by at least 0.02, scored by all matches, direct and shifted."""
    e = aligned_pairs(spark, d).withColumn("shift", F.round("shift", 4)).filter(F.abs("shift") >= 0.02).withColumn("weight", F.round(F.col("direct") + F.col("shifted"), 3))
    return e.select("a", "b", "shift", "weight", F.round(F.col("weight") / F.sqrt(F.col("norm_a") * F.col("norm_b")), 6).alias("score"))


@query(f"{ALIGNED} SELECT a, b, shift, weight, score FROM e")
def alignment_edges(spark, d):
    """Edges of the alignment graph: spectra of unlike precursors with the shift between them, the summed products and the score."""
    return alignment(spark, d)


@query(f"""{ALIGNED}, u AS (SELECT a, b, shift, score FROM e WHERE score >= 0.01 UNION ALL SELECT b, a, -shift, score FROM e WHERE score >= 0.01),
r AS (SELECT *, CAST(trunc(shift * 100) AS BIGINT) AS bucket, row_number() OVER (PARTITION BY a, trunc(shift * 100) ORDER BY score DESC, b) AS r FROM u) SELECT a, bucket, b, score FROM r WHERE r = 1""")
def alignment_trim(spark, d):
    """Of a spectrum's neighbours of enough score, the best in each hundredth of a shift."""
    e = alignment(spark, d).filter("score >= 0.01")
    both = e.select("a", "b", "shift", "score").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("shift")).alias("shift"), "score"))
    bucket = (F.col("shift") * 100).cast("long")
    best = F.max(F.struct("score", (-F.col("b")).alias("n")))
    return both.groupBy("a", bucket.alias("bucket")).agg(best.alias("m")).select("a", "bucket", (-F.col("m.n")).alias("b"), "m.score")


@query(f"""{ALIGNED}, s AS (SELECT abs(shift) AS shift, weight FROM e WHERE score >= 0.01), g AS (SELECT *, CASE WHEN shift - lag(shift) OVER (ORDER BY shift, weight) < 0.001 THEN 0 ELSE 1 END AS new FROM s),
t AS (SELECT *, sum(new) OVER (ORDER BY shift, weight ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT round(sum(shift * weight) / sum(weight), 4) AS shift, count(*) AS n, round(sum(weight), 2) AS weight FROM t GROUP BY k""")
def average_shifts(spark, d):
    """Shifts of alignments in chains of near values, each chain's mean weighted by the matched products."""
    s = alignment(spark, d).filter("score >= 0.01").select(F.abs("shift").alias("shift"), "weight")
    k = sessionize(s, [], ["shift", "weight"], F.col("shift") - F.col("_prev.shift") >= 0.001, "k")
    return k.groupBy("k").agg(F.round(F.sum(F.col("shift") * F.col("weight")) / F.sum("weight"), 4).alias("shift"), F.count("*").alias("n"), F.round(F.sum("weight"), 2).alias("weight")).drop("k")


GROUPS = """WITH g AS (SELECT scan_id, precursor_mz, CASE WHEN (lag(precursor_mz) OVER (ORDER BY precursor_mz DESC, scan_id) - precursor_mz) / precursor_mz > 1.5e-5 THEN 1 ELSE 0 END AS new FROM v_scan WHERE ms_level = 2),
s AS (SELECT scan_id, precursor_mz, CAST(sum(new) OVER (ORDER BY precursor_mz DESC, scan_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster_id FROM g)"""


def mass_groups(spark, d):
    v = view(spark, d, "v_scan").filter("ms_level = 2").select("scan_id", "precursor_mz")
    return sessionize(v, [], [F.desc("precursor_mz"), "scan_id"], (F.col("_prev.precursor_mz") - F.col("precursor_mz")) / F.col("precursor_mz") > 1.5e-5, "cluster_id")


@query(f"{GROUPS} SELECT scan_id, cluster_id FROM s")
def precursor_mass_groups(spark, d):
    """Chains of scans whose neighbouring precursor masses are within tolerance."""
    return mass_groups(spark, d).select("scan_id", "cluster_id")


@query(f"{GROUPS}, c AS (SELECT cluster_id, count(*) AS size FROM s GROUP BY cluster_id) SELECT size, count(*) AS n_clusters FROM c GROUP BY size")
def cluster_sizes(spark, d):
    return mass_groups(spark, d).groupBy("cluster_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_clusters"))


@query(f"""{BINS}, {DOTS}, m AS (SELECT DISTINCT scan_id, CAST(floor(m / 10) AS BIGINT) AS cluster FROM b), c AS (SELECT cluster, count(*) AS size FROM m GROUP BY cluster)
SELECT c.cluster, size, round(sum(dot / (p.norm * q.norm)) / (size * (size - 1) / 2), 6) AS similarity FROM d JOIN m x ON x.scan_id = a JOIN m y ON y.scan_id = b AND x.cluster = y.cluster JOIN c ON c.cluster = x.cluster JOIN n p ON p.scan_id = a JOIN n q ON q.scan_id = b GROUP BY c.cluster, size""")
def cluster_avg_similarity(spark, d):
    """Mean cosine of the pairs inside each group of precursors; pairs without a common bin count as 0.

    No pair is made: with spectra of norm 1, the products of all pairs in a bin
    add up to half of the bin's squared sum less its sum of squares. A group
    has a row if a bin has two of its spectra.
    """
    b = binned(spark, d).withColumn("u", F.col("i") / F.sqrt(F.sum(F.col("i") * F.col("i")).over(W.partitionBy("scan_id")))).withColumn("cluster", F.floor(F.col("m") / 10))
    size = b.groupBy("scan_id", "cluster").agg(F.lit(1).alias("one")).groupBy("cluster").agg(F.count("*").alias("size"))
    at = b.groupBy("cluster", "bin").agg(F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("q"), F.count("*").alias("n")).filter("n > 1")
    out = at.groupBy("cluster").agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2).alias("total")).join(size, "cluster")
    return out.select("cluster", "size", F.round(F.col("total") / (F.col("size") * (F.col("size") - 1) / 2), 6).alias("similarity"))


@query("""WITH p AS (SELECT *, floor(mz * 10) AS bin FROM v_peak) SELECT CAST(bin AS BIGINT) AS bin, count(DISTINCT scan_id) AS n_scans, round(sum(mz * intensity) / sum(intensity) + 1e-9, 6) AS mz, round(sum(intensity), 3) AS intensity FROM p GROUP BY bin HAVING count(*) > 1""")
def consensus_peak(spark, d):
    """Consensus centroids: weighted m/z and summed signal of peaks in one bin over scans."""
    p = view(spark, d, "v_peak").withColumn("bin", F.floor(F.col("mz") * 10))
    out = p.groupBy("bin").agg(F.countDistinct("scan_id").alias("n_scans"), F.round(F.sum(F.col("mz") * F.col("intensity")) / F.sum("intensity") + 1e-9, 6).alias("mz"), F.round(F.sum("intensity"), 3).alias("intensity"), F.count("*").alias("n"))
    return out.filter("n > 1").drop("n")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, floor(mz / 100) ORDER BY intensity DESC, mz, ord, part) AS r FROM v_peak) SELECT scan_id, count(*) AS n, round(sum(intensity), 3) AS intensity FROM r WHERE r <= 5 GROUP BY scan_id""")
def filter_peak_set(spark, d):
    p = top_k(view(spark, d, "v_peak").withColumn("w", F.floor(F.col("mz") / 100)), ["scan_id", "w"], [F.desc("intensity"), "mz", "ord", "part"], 5)
    return p.groupBy("scan_id").agg(F.count("*").alias("n"), F.round(F.sum("intensity"), 3).alias("intensity"))
