"""Clusters of spectra and of peaks: lookup by mass, charge splits, peak clusters, sign hashing."""

from __future__ import annotations

from pyspark.sql import functions as F

from massloom.catalog import query
from massloom.catalog.similarity import GROUPS, mass_groups
from massloom.operators import hashing as H
from massloom.operators.joins import best_match, range_join
from massloom.operators.ordered import sessionize
from massloom.plans.views import view

CLUSTERS = f"{GROUPS}, c AS (SELECT cluster_id, count(*) AS size, min(precursor_mz) AS low, max(precursor_mz) AS mass FROM s GROUP BY cluster_id)"


def cluster_table(spark, d):
    """(cluster_id, size, low, mass): the mass of a cluster is that of its first member, the heaviest."""
    return mass_groups(spark, d).groupBy("cluster_id").agg(F.count("*").alias("size"), F.min("precursor_mz").alias("low"), F.max("precursor_mz").alias("mass"))


HITS = f"{CLUSTERS}, h AS (SELECT target_id, target_mass, cluster_id, c.size, mass FROM v_target JOIN c ON abs(mass - target_mass) <= target_mass * 1e-4)"


def hits(spark, d):
    t = view(spark, d, "v_target").select("target_id", "target_mass")
    return range_join(t, cluster_table(spark, d), "target_mass", "mass", 1e-4)


@query(f"{HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY abs(mass - target_mass), cluster_id) AS r FROM h) SELECT target_id, cluster_id, size, round(mass, 5) AS mass FROM r WHERE r = 1")
def cluster_find(spark, d):
    """The cluster of the nearest mass within tolerance."""
    best = best_match(hits(spark, d), ["target_id"], F.abs(F.col("mass") - F.col("target_mass")), F.col("cluster_id"))
    return best.select("target_id", "cluster_id", "size", F.round("mass", 5).alias("mass"))


@query(f"{HITS} SELECT target_id, count(*) AS n, min(cluster_id) AS first, max(cluster_id) AS last, sum(size)::BIGINT AS members FROM h GROUP BY target_id")
def cluster_find_all(spark, d):
    """All clusters of a mass within tolerance."""
    return hits(spark, d).groupBy("target_id").agg(F.count("*").alias("n"), F.min("cluster_id").alias("first"), F.max("cluster_id").alias("last"), F.sum("size").alias("members"))


@query(f"{GROUPS} SELECT cluster_id, v.charge, count(*) AS size, arg_max(s.scan_id, (v.tic, s.scan_id)) AS leader FROM s JOIN v_scan v ON v.scan_id = s.scan_id GROUP BY cluster_id, v.charge")
def split_on_charge(spark, d):
    """Clusters parted by charge, each led by its strongest spectrum."""
    v = view(spark, d, "v_scan").select("scan_id", "charge", "tic")
    g = mass_groups(spark, d).select("scan_id", "cluster_id").join(v, "scan_id")
    return g.groupBy("cluster_id", "charge").agg(F.count("*").alias("size"), F.max_by("scan_id", F.struct("tic", "scan_id")).alias("leader"))


@query("""WITH g AS (SELECT scan_id, mz, intensity, ord, part, CASE WHEN (mz - lag(mz) OVER o) / mz <= 2e-6 THEN 0 ELSE 1 END AS new FROM v_peak WINDOW o AS (ORDER BY mz, scan_id, intensity, ord, part)), s AS (SELECT *, sum(new) OVER (ORDER BY mz, scan_id, intensity, ord, part ROWS UNBOUNDED PRECEDING) AS k FROM g),
n AS (SELECT count(DISTINCT scan_id) AS n FROM v_peak) SELECT round(sum(mz * intensity) / sum(intensity) + 1e-9, 5) AS mz, count(*) AS size, round(sum(intensity), 2) AS intensity, round(count(DISTINCT scan_id) / max(n), 6) AS probability FROM s, n GROUP BY k HAVING count(*) >= 3""")
def cluster_peaks(spark, d):
    """Peaks of all spectra in chains of near m/z: weighted centre, members, signal, and the share of spectra that have one."""
    v = view(spark, d, "v_peak").select("scan_id", "mz", "intensity", "ord", "part")
    s = sessionize(v, [], ["mz", "scan_id", "intensity", "ord", "part"], (F.col("mz") - F.col("_prev.mz")) / F.col("mz") > 2e-6, "k")
    n = v.agg(F.countDistinct("scan_id").alias("n"))
    g = s.groupBy("k").agg(F.round(F.sum(F.col("mz") * F.col("intensity")) / F.sum("intensity") + 1e-9, 5).alias("mz"), F.count("*").alias("size"), F.round(F.sum("intensity"), 2).alias("intensity"), F.countDistinct("scan_id").alias("scans"))
    return g.filter("size >= 3").join(F.broadcast(n)).select("mz", "size", "intensity", F.round(F.col("scans") / F.col("n"), 6).alias("probability"))


#: Twelve planes drawn by a linear congruence, scaled to unit length.
RAW = [[((1103515245 * (i + 64 * k + 1) + 12345) % 65536) / 32768 - 1 for i in range(64)] for k in range(12)]
PLANES = [[x / sum(y * y for y in plane) ** 0.5 for x in plane] for plane in RAW]
BUCKETS = "WITH h AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, " + " || ".join(f"CASE WHEN list_dot_product(CAST(embedding AS DOUBLE[]), {p}) > 0 THEN '1' ELSE '0' END" for p in PLANES) + " AS bucket FROM embeddings)"


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def hashed(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.withColumn("bucket", F.concat(*[F.when(dot(F.col("e"), F.array(*map(F.lit, p))) > 0, "1").otherwise("0") for p in PLANES]))


@query(f"{BUCKETS} SELECT vec_id, bucket FROM h")
def lsh_buckets(spark, d):
    """Sign bits of projections on unit vectors."""
    return hashed(spark, d).select("vec_id", "bucket")


LIKE = 0.4


def vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


@query()
def lsh_similar_pairs(spark, d):
    """Vectors like each query vector, those of ids divisible by 50, found by sign hashing in as many tables as a recall of 0.99 needs."""
    v = vectors(spark, d)
    return H.hashed_search(v.filter("id % 50 = 0"), v, LIKE).withColumn("similarity", F.round("similarity", 5))


@query(f"WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 5) AS similarity FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {LIKE}")
def similar_pairs(spark, d):
    """The same without loss: query vectors in blocks against all rows."""
    v = vectors(spark, d)
    return H.block_search(v.filter("id % 50 = 0"), v, LIKE).withColumn("similarity", F.round("similarity", 5))


@query(f"""{GROUPS}, m AS (SELECT s.cluster_id, s.precursor_mz, v.tic, row_number() OVER (PARTITION BY cluster_id ORDER BY v.tic DESC, s.scan_id) AS r FROM s JOIN v_scan v ON v.scan_id = s.scan_id) SELECT cluster_id, count(*) AS size, round(max(precursor_mz) FILTER (r = 1), 5) AS centre, round(coalesce(stddev_samp(precursor_mz), 0), 5) AS spread FROM m GROUP BY cluster_id HAVING count(*) > 1""")
def precursor_clustering(spark, d):
    """Groups of precursors around their strongest: size, centre and spread."""
    v = view(spark, d, "v_scan").select("scan_id", "tic")
    m = mass_groups(spark, d).join(v, "scan_id")
    g = m.groupBy("cluster_id").agg(F.count("*").alias("size"), F.round(F.max_by("precursor_mz", F.struct("tic", -F.col("scan_id"))), 5).alias("centre"), F.round(F.coalesce(F.stddev_samp("precursor_mz"), F.lit(0.0)), 5).alias("spread"))
    return g.filter("size > 1")
