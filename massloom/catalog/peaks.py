"""Peak-set search: range, nearest, interval and ranked selection."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from massloom.catalog import query
from massloom.functions.mass import ISOTOPE_GAP, PROTON, mass_charge_ratio, neutral_mass, ppm_error
from massloom.operators.joins import interval_join, interval_join_2d, nearest_by_group, nearest_join, range_join
from massloom.operators.ordered import top_k
from massloom.plans.views import view

TARGETS = "SELECT target_id, target_mass FROM v_target"


def targets(spark, d):
    return view(spark, d, "v_target").select("target_id", "target_mass")


@query(f"""WITH t AS ({TARGETS}) SELECT target_id, scan_id, round(mz, 6) AS mz, intensity, round((mz - target_mass) / target_mass * 1e6, 4) AS ppm
FROM t JOIN v_peak ON abs(mz - target_mass) <= target_mass * 2e-5""")
def ppm_match_all(spark, d):
    pairs = range_join(targets(spark, d), view(spark, d, "v_peak"), "target_mass", "mz", 2e-5)
    return pairs.select("target_id", "scan_id", F.round("mz", 6).alias("mz"), "intensity", F.round(ppm_error(F.col("mz"), F.col("target_mass")) * 1e6, 4).alias("ppm"))


@query(f"""WITH t AS ({TARGETS}), p AS (SELECT target_id, scan_id, mz, row_number() OVER (PARTITION BY target_id, scan_id ORDER BY abs(mz - target_mass), mz) AS r
FROM t JOIN v_peak ON abs(mz - target_mass) < target_mass * 1e-4) SELECT target_id, scan_id, round(mz, 6) AS mz FROM p WHERE r = 1""")
def ppm_match_best(spark, d):
    """The nearest peak of each spectrum to each target within tolerance."""
    t = targets(spark, d).select(F.col("target_id").alias("query"), F.col("target_mass").alias("value"))
    p = view(spark, d, "v_peak").select(F.col("scan_id").alias("group"), F.col("mz").alias("at"), F.round("mz", 6).alias("shown"))
    return nearest_by_group(t, p, 1e-4).select(F.col("query").alias("target_id"), F.col("group").alias("scan_id"), F.col("shown").alias("mz"))


@query(f"""WITH t AS ({TARGETS}) SELECT target_id, coalesce(max(intensity), 1.0) AS intensity, CASE WHEN count(mz) = 0 THEN -1 ELSE count(mz) END AS peak_count
FROM t LEFT JOIN v_peak ON abs(mz - target_mass) <= target_mass * 1e-6 GROUP BY target_id""")
def ppm_match_placeholder(spark, d):
    """A target without a peak keeps a placeholder of intensity 1 and count -1."""
    pairs = range_join(targets(spark, d), view(spark, d, "v_peak").select("mz", "intensity"), "target_mass", "mz", 1e-6, how="left")
    n = F.count("mz")
    return pairs.groupBy("target_id").agg(F.coalesce(F.max("intensity"), F.lit(1.0)).alias("intensity"), F.when(n == 0, -1).otherwise(n).alias("peak_count"))


@query("""WITH q AS (SELECT scan_id, precursor_mz FROM v_peak_scan), p AS (SELECT q.scan_id, precursor_mz, mz, row_number() OVER (PARTITION BY q.scan_id ORDER BY abs(mz - precursor_mz), mz) AS r
FROM q JOIN v_peak USING (scan_id)) SELECT scan_id, round(precursor_mz, 6) AS precursor_mz, round(mz, 6) AS nearest_mz FROM p WHERE r = 1""")
def nearest_peak(spark, d):
    q = view(spark, d, "v_peak_scan").select("scan_id", "precursor_mz")
    p = view(spark, d, "v_peak").select("scan_id", "mz", "intensity")
    near = nearest_join(q, p, "precursor_mz", "mz", ["scan_id"], ["intensity"]).filter("nearest_mz is not null")
    return near.select("scan_id", F.round("precursor_mz", 6).alias("precursor_mz"), F.round("nearest_mz", 6).alias("nearest_mz"))


@query("""SELECT scan_id, round(mz, 6) AS mz, intensity, charge FROM v_peak WHERE mz BETWEEN 500 AND 520""")
def mz_between(spark, d):
    return view(spark, d, "v_peak").filter(F.col("mz").between(500, 520)).select("scan_id", F.round("mz", 6).alias("mz"), "intensity", "charge")


@query("""SELECT DISTINCT s.scan_id FROM v_peak_scan s JOIN v_peak p ON s.scan_id = p.scan_id AND abs(mz - 500.0) <= 500.0 * 2e-4""")
def has_product_mz(spark, d):
    scans = view(spark, d, "v_peak_scan").select("scan_id").withColumn("product_mz", F.lit(500.0))
    return range_join(scans, view(spark, d, "v_peak").select("scan_id", "mz"), "product_mz", "mz", 2e-4, ["scan_id"], "left_semi").select("scan_id")


@query("""SELECT DISTINCT s.scan_id FROM v_peak_scan s JOIN v_peak p ON s.scan_id = p.scan_id AND abs(mz - (precursor_mz - 18.0106)) <= (precursor_mz - 18.0106) * 1e-4""")
def precursor_loss(spark, d):
    scans = view(spark, d, "v_peak_scan").select("scan_id", (F.col("precursor_mz") - 18.0106).alias("loss_mz"))
    return range_join(scans, view(spark, d, "v_peak").select("scan_id", "mz"), "loss_mz", "mz", 1e-4, ["scan_id"], "left_semi").select("scan_id")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY intensity DESC, mz, charge, ord, part) AS r FROM v_peak)
SELECT scan_id, round(mz, 6) AS mz, intensity FROM r WHERE r <= 20""")
def select_top_n(spark, d):
    return top_k(view(spark, d, "v_peak"), ["scan_id"], [F.desc("intensity"), "mz", "charge", "ord", "part"], 20).select("scan_id", F.round("mz", 6).alias("mz"), "intensity")


@query("""WITH r AS (SELECT *, floor(mz / 100) AS w, row_number() OVER (PARTITION BY scan_id, floor(mz / 100) ORDER BY intensity DESC, mz, charge, ord, part) AS r FROM v_peak)
SELECT scan_id, CAST(w AS BIGINT) AS window_id, round(mz, 6) AS mz, intensity FROM r WHERE r <= 5""")
def window_top_k(spark, d):
    peaks = view(spark, d, "v_peak").withColumn("window_id", F.floor(F.col("mz") / 100))
    return top_k(peaks, ["scan_id", "window_id"], [F.desc("intensity"), "mz", "charge", "ord", "part"], 5).select("scan_id", "window_id", F.round("mz", 6).alias("mz"), "intensity")


@query(f"""SELECT scan_id, round(mz * charge - charge * {PROTON}, 5) AS neutral_mass, round(mz * charge - charge * {PROTON} + {PROTON}, 5) AS mz_at_one FROM v_peak""")
def decharge(spark, d):
    mass = neutral_mass(F.col("mz"), F.col("charge"))
    return view(spark, d, "v_peak").select("scan_id", F.round(mass, 5).alias("neutral_mass"), F.round(mass_charge_ratio(mass, F.lit(1)), 5).alias("mz_at_one"))


@query("""WITH u AS (SELECT scan_id, mz, intensity, 'a' AS origin FROM v_peak WHERE charge = 1 UNION ALL SELECT scan_id, mz, intensity, 'b' FROM v_peak WHERE charge = 2)
SELECT scan_id, origin, round(mz, 6) AS mz, row_number() OVER (PARTITION BY scan_id ORDER BY mz, intensity, origin) AS idx FROM u""")
def merge_peak_sets(spark, d):
    p = view(spark, d, "v_peak").select("scan_id", "mz", "intensity", "charge")
    u = p.filter("charge = 1").withColumn("origin", F.lit("a")).unionByName(p.filter("charge = 2").withColumn("origin", F.lit("b")))
    idx = F.row_number().over(W.partitionBy("scan_id").orderBy("mz", "intensity", "origin"))
    return u.select("scan_id", "origin", F.round("mz", 6).alias("mz"), idx.cast("long").alias("idx"))


@query(f"""WITH m AS (SELECT *, mz * charge - charge * {PROTON} AS mass FROM v_peak)
SELECT scan_id, ord, part, charge, row_number() OVER (PARTITION BY scan_id ORDER BY mass, intensity, ord, part, charge) AS by_mass, row_number() OVER (PARTITION BY scan_id ORDER BY mz, intensity, ord, part, charge) AS by_mz FROM m""")
def reindex_dual(spark, d):
    p = view(spark, d, "v_peak").withColumn("mass", neutral_mass(F.col("mz"), F.col("charge")))
    rank = lambda c: F.row_number().over(W.partitionBy("scan_id").orderBy(c, "intensity", "ord", "part", "charge")).cast("long")
    return p.select("scan_id", "ord", "part", "charge", rank("mass").alias("by_mass"), rank("mz").alias("by_mz"))


@query(f"""WITH q AS (SELECT scan_id, mz AS from_mz, mz + {ISOTOPE_GAP} / z AS want, z FROM v_peak, (SELECT unnest(range(1, 9)) AS z))
SELECT q.scan_id, z AS charge, count(*) AS n, round(sum(p.intensity), 2) AS intensity FROM q JOIN v_peak p ON q.scan_id = p.scan_id AND abs(p.mz - want) <= want * 2e-5 GROUP BY q.scan_id, z""")
def charge_neighbors(spark, d):
    """Peaks one isotope above another, by charge: the candidate edges of deconvolution."""
    p = view(spark, d, "v_peak").select("scan_id", "mz", "intensity")
    q = p.select("scan_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("z"), "mz").select("scan_id", "z", (F.col("mz") + F.lit(ISOTOPE_GAP) / F.col("z")).alias("want"))
    found = range_join(q, p, "want", "mz", 2e-5, ["scan_id"], spread="found")
    return found.groupBy("scan_id", F.col("z").cast("long").alias("charge")).agg(F.count("*").alias("n"), F.round(F.sum("intensity"), 2).alias("intensity"))


SPANS = "SELECT scan_id AS a, scan_time AS s, scan_time + CAST(charge AS DOUBLE) AS e FROM v_scan"


@query(f"""WITH x AS ({SPANS}), y AS (SELECT a AS b, s AS t, e AS f FROM x) SELECT a, count(*) AS n, min(b) AS first, max(b) AS last, round(sum(least(e, f) - greatest(s, t)), 4) AS overlap FROM x JOIN y ON s <= f AND t <= e AND a <> b GROUP BY a""")
def interval_overlap(spark, d):
    """How many other intervals each one overlaps, the first and last of them, and the summed overlap."""
    x = view(spark, d, "v_scan").select(F.col("scan_id").alias("a"), F.col("scan_time").alias("s"), (F.col("scan_time") + F.col("charge")).alias("e"))
    pairs = interval_join(x, x.toDF("b", "t", "f"), ("s", "e"), ("t", "f"), 4.0).filter("a <> b")
    return pairs.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("first"), F.max("b").alias("last"), F.round(F.sum(F.least("e", "f") - F.greatest("s", "t")), 4).alias("overlap"))


@query(f"""WITH x AS ({SPANS}) SELECT a, count(*) AS n, min(scan_id) AS first, max(scan_id) AS last FROM x JOIN v_scan ON scan_time BETWEEN s AND e GROUP BY a""")
def interval_stab(spark, d):
    """The points inside each interval: their number, the first and the last."""
    v = view(spark, d, "v_scan")
    x = v.select(F.col("scan_id").alias("a"), F.col("scan_time").alias("s"), (F.col("scan_time") + F.col("charge")).alias("e"))
    y = v.select(F.col("scan_id").alias("point_id"), F.col("scan_time").alias("p"), F.col("scan_time").alias("p2"))
    return interval_join(x, y, ("s", "e"), ("p", "p2"), 4.0).groupBy("a").agg(F.count("*").alias("n"), F.min("point_id").alias("first"), F.max("point_id").alias("last"))


@query(f"""WITH x AS ({SPANS}) SELECT x.a, count(*) AS inside FROM x JOIN x y ON x.s <= y.s AND y.e <= x.e AND x.a <> y.a GROUP BY x.a""")
def interval_containment(spark, d):
    """How many other intervals lie inside each one."""
    x = view(spark, d, "v_scan").select(F.col("scan_id").alias("a"), F.col("scan_time").alias("s"), (F.col("scan_time") + F.col("charge")).alias("e"))
    pairs = interval_join(x, x.toDF("b", "t", "f"), ("s", "e"), ("t", "f"), 4.0).filter("a <> b and s <= t and f <= e")
    return pairs.groupBy("a").agg(F.count("*").alias("inside"))


@query(f"""WITH x AS (SELECT scan_id AS a, scan_time AS s, scan_time + charge AS e, precursor_mz AS lo, precursor_mz + 10 AS hi FROM v_scan)
SELECT x.a, y.a AS b FROM x JOIN x y ON x.s <= y.e AND y.s <= x.e AND x.lo <= y.hi AND y.lo <= x.hi AND x.a < y.a""")
def interval_overlap_2d(spark, d):
    v = view(spark, d, "v_scan")
    x = v.select(F.col("scan_id").alias("a"), F.col("scan_time").alias("s"), (F.col("scan_time") + F.col("charge")).alias("e"), F.col("precursor_mz").alias("lo"), (F.col("precursor_mz") + 10).alias("hi"))
    y = x.toDF("b", "t", "f", "lo2", "hi2")
    return interval_join_2d(x, y, ("s", "e", "lo", "hi"), ("t", "f", "lo2", "hi2"), (4.0, 20.0)).filter("a < b").select("a", "b")


@query(f"""WITH p AS (SELECT ord, part, charge, mz * charge - charge * {PROTON} AS mass FROM v_peak)
SELECT a.ord AS ord_a, b.ord AS ord_b, a.charge AS charge FROM p a JOIN p b ON abs(b.mass - a.mass) <= a.mass * 2e-6 AND b.charge - a.charge = 1""")
def charge_relationship(spark, d):
    """Partners of the same mass one charge apart."""
    p = view(spark, d, "v_peak").select("ord", "charge", neutral_mass(F.col("mz"), F.col("charge")).alias("mass"))
    q = p.select(F.col("ord").alias("ord_a"), F.col("charge").alias("z"), F.col("mass").alias("want"))
    return range_join(q, p, "want", "mass", 2e-6).filter("charge - z = 1").select("ord_a", F.col("ord").alias("ord_b"), F.col("z").alias("charge"))


@query("""SELECT scan_id, min(mz) FILTER (mz >= 600) AS first_mz, CAST(count(*) FILTER (mz < 600) AS BIGINT) AS index_low, CAST(count(*) FILTER (mz <= 700) AS BIGINT) AS index_high FROM v_peak GROUP BY scan_id""")
def index_range(spark, d):
    """Ordinal range of an m/z interval in each sorted peak list."""
    count = lambda c: F.count(F.when(c, 1))
    mz = F.col("mz")
    return view(spark, d, "v_peak").groupBy("scan_id").agg(F.min(F.when(mz >= 600, mz)).alias("first_mz"), count(mz < 600).alias("index_low"), count(mz <= 700).alias("index_high"))
