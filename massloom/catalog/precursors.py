"""Precursor handling, compositions, array arithmetic and metadata lookups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from massloom.catalog import query
from massloom.functions.mass import PROTON, mass_charge_ratio, neutral_mass, to_dalton, to_ppm
from massloom.operators.joins import best_match, range_join
from massloom.operators.ordered import sessionize
from massloom.plans.views import view


@query(f"""WITH c AS (SELECT s.scan_id, s.precursor_mz AS declared, s.charge, p.mz, p.intensity, row_number() OVER (PARTITION BY s.scan_id ORDER BY abs(p.mz - s.precursor_mz), p.mz, p.intensity) AS r FROM v_peak_scan s JOIN v_peak p ON s.scan_id = p.scan_id AND abs(p.mz - s.precursor_mz) <= s.precursor_mz * 5e-4 WHERE s.ms_level = 2)
SELECT s.scan_id, round(coalesce(c.mz, s.precursor_mz), 6) AS mz, round(coalesce(c.mz, s.precursor_mz) * s.charge - s.charge * {PROTON}, 5) AS extracted_mass, c.mz IS NULL AS defaulted
FROM v_peak_scan s LEFT JOIN c ON s.scan_id = c.scan_id AND c.r = 1 WHERE s.ms_level = 2""")
def precursor_extract(spark, d):
    """Take the matching peak's values for a precursor, else its declared ones and mark it defaulted."""
    s = view(spark, d, "v_peak_scan").filter("ms_level = 2").select("scan_id", "precursor_mz", "charge")
    pairs = range_join(s, view(spark, d, "v_peak").select("scan_id", "mz", "intensity"), "precursor_mz", "mz", 5e-4, ["scan_id"])
    best = best_match(pairs, ["scan_id"], F.abs(F.col("mz") - F.col("precursor_mz")), F.col("mz"), F.col("intensity")).select("scan_id", "mz")
    mz = F.coalesce("mz", "precursor_mz")
    return s.join(best, "scan_id", "left").select("scan_id", F.round(mz, 6).alias("mz"), F.round(neutral_mass(mz, F.col("charge")), 5).alias("extracted_mass"), F.col("mz").isNull().alias("defaulted"))


@query(f"""SELECT scan_id, round(precursor_mz * 1 - {PROTON}, 5) AS mass_if_unknown, round((precursor_mz * charge - charge * {PROTON} + 2 * {PROTON}) / 2, 6) AS mz_at_two FROM v_scan""")
def unknown_charge(spark, d):
    """A charge that is not known counts as one."""
    v = view(spark, d, "v_scan")
    return v.select("scan_id", F.round(neutral_mass(F.col("precursor_mz"), F.lit(None).cast("int")), 5).alias("mass_if_unknown"), F.round(mass_charge_ratio(neutral_mass(F.col("precursor_mz"), F.col("charge")), F.lit(2)), 6).alias("mz_at_two"))


@query("""WITH c AS (SELECT scan_id, precursor_mz AS mz, 0 AS k FROM v_scan WHERE ms_level = 2 UNION ALL SELECT scan_id, precursor_mz + 1, 1 FROM v_scan WHERE ms_level = 2 AND charge > 1 UNION ALL SELECT scan_id, precursor_mz + 2, 2 FROM v_scan WHERE ms_level = 2 AND charge > 2) SELECT scan_id, CAST(k AS INT) AS ion, round(mz, 6) AS mz FROM c""")
def split_coisolations(spark, d):
    """One row for each ion isolated together, the primary one first."""
    mz = F.col("precursor_mz")
    ions = F.array(mz, F.when(F.col("charge") > 1, mz + 1), F.when(F.col("charge") > 2, mz + 2))
    return view(spark, d, "v_scan").filter("ms_level = 2").select("scan_id", F.posexplode(ions).alias("ion", "mz")).dropna().select("scan_id", "ion", F.round("mz", 6).alias("mz"))


@query("""SELECT target_id, round(target_mass * 2e-5, 8) AS dalton, round(0.01 / target_mass, 10) AS ppm FROM v_target""")
def tolerance_units(spark, d):
    m = F.col("target_mass")
    return view(spark, d, "v_target").select("target_id", F.round(to_dalton(m, 2e-5), 8).alias("dalton"), F.round(to_ppm(m, 0.01), 10).alias("ppm"))


FORMULA = "'C' || (1 + p_size) || 'H' || (2 * p_size) || 'O' || (p_partkey % 7 + 1)"


@query(f"""WITH f AS (SELECT p_partkey AS target_id, {FORMULA} AS f FROM part) SELECT target_id, CAST(regexp_extract(f, 'C([0-9]+)', 1) AS BIGINT) AS c, CAST(regexp_extract(f, 'H([0-9]+)', 1) AS BIGINT) AS h, CAST(regexp_extract(f, 'O([0-9]+)', 1) AS BIGINT) AS o FROM f""")
def parse_formula(spark, d):
    """Element counts of a formula string."""
    f = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("target_id"), F.expr(FORMULA).alias("f"))
    counts = F.expr("map_from_arrays(regexp_extract_all(f, '([A-Z][a-z]?)([0-9]+)', 1), transform(regexp_extract_all(f, '([A-Z][a-z]?)([0-9]+)', 2), x -> bigint(x)))")
    return f.select("target_id", counts.alias("m")).select("target_id", *[F.col("m")[e.upper()].alias(e) for e in "cho"])


@query("""SELECT name, round(sum(size * target_mass) / sum(target_mass), 6) AS weighted, sum(size) AS total FROM v_target GROUP BY name""")
def average_compositions(spark, d):
    """Weighted mean and sum of element counts."""
    return view(spark, d, "v_target").groupBy("name").agg(F.round(F.sum(F.col("size") * F.col("target_mass")) / F.sum("target_mass"), 6).alias("weighted"), F.sum("size").alias("total"))


@query("""WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS term, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier), a(term, ancestor) AS (SELECT term, parent FROM e UNION SELECT a.term, e.parent FROM a JOIN e ON a.ancestor = e.term) SELECT term, ancestor FROM a""")
def vocabulary_closure(spark, d):
    """Every (term, ancestor) of an is-a hierarchy: the table behind is-a filters."""
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("n"), "n_nationkey").alias("term"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("s"), "s_suppkey").alias("term"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    edges = n.unionByName(s)
    closure = front = edges.toDF("term", "ancestor")
    while not front.isEmpty():  # as many rounds as the hierarchy is deep
        front = front.join(edges.toDF("ancestor", "parent"), "ancestor").select("term", F.col("parent").alias("ancestor"))
        closure = closure.unionByName(front)
    return closure.distinct()


@query("""WITH q AS (SELECT unnest([10.3, 50.004, 99.999]::DOUBLE[]) AS q), r AS (SELECT q, scan_id, row_number() OVER (PARTITION BY q ORDER BY abs(scan_time - q), scan_id) AS r FROM v_scan, q) SELECT q AS query_time, scan_id FROM r WHERE r = 1""")
def scan_by_time(spark, d):
    """The scan nearest to a time: one combinable minimum for each query."""
    v = view(spark, d, "v_scan").select("scan_id", "scan_time")
    times = [10.3, 50.004, 99.999]
    near = [F.min(F.struct(F.abs(F.col("scan_time") - q), F.col("scan_id")))["scan_id"] for q in times]
    found = v.agg(F.array(*[F.struct(F.lit(q).alias("query_time"), n.alias("scan_id")) for q, n in zip(times, near, strict=True)]).alias("x"))
    return found.select(F.explode("x").alias("y")).select("y.query_time", "y.scan_id")


@query("""WITH a AS (SELECT vec_id, embedding AS e, lead(embedding) OVER (ORDER BY vec_id) AS f FROM embeddings) SELECT vec_id, round(list_sum([CAST(x AS DOUBLE) * 2 for x in e]), 4) AS doubled, round(list_sum([CAST(e[i] AS DOUBLE) + CAST(f[i] AS DOUBLE) for i in range(1, 65)]), 4) AS added FROM a WHERE f IS NOT NULL""")
def array_arithmetic(spark, d):
    """Scaling a spectrum's intensities, and adding two on one grid."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    pair = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f")), "vec_id")
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 4)
    return pair.select("vec_id", total(F.transform("e", lambda x: x * 2)).alias("doubled"), total(F.zip_with("e", "f", lambda x, y: x + y)).alias("added"))


@query("""WITH p AS (SELECT run, channel, event_id, ts, intensity, CAST(epoch_us(ts) AS DOUBLE) / 3.6e9 AS t FROM v_signal WHERE intensity >= 100), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY run, channel ORDER BY t, event_id) > 48 THEN 1 ELSE 0 END AS new FROM p),
s AS (SELECT *, sum(new) OVER (PARTITION BY run, channel ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT run, channel, CAST(k AS BIGINT) AS part, count(*) AS n, round(sum(intensity), 4) AS total FROM s GROUP BY run, channel, k HAVING count(*) >= 2""")
def remove_peaks_below_threshold(spark, d):
    """Drop weak points of features, then cut at the gaps that this opens."""
    p = view(spark, d, "v_signal").filter("intensity >= 100").select("run", "channel", "event_id", (F.unix_micros("ts") / 3.6e9).alias("t"), "intensity")
    s = sessionize(p, ["run", "channel"], ["t", "event_id"], F.col("t") - F.col("_prev.t") > 48, "part")
    return s.groupBy("run", "channel", "part").agg(F.count("*").alias("n"), F.round(F.sum("intensity"), 4).alias("total")).filter("n >= 2")


@query("""WITH w AS (SELECT run, channel, ts, event_id, mz, intensity, sum(intensity) OVER (PARTITION BY run, channel) AS total FROM v_signal) SELECT run, channel, round(sum(mz * intensity) / max(total), 6) AS mz, round(max(intensity), 4) AS apex, count(*) AS n FROM w GROUP BY run, channel""")
def feature_to_peak(spark, d):
    """A feature as one peak: weighted m/z, apex, points."""
    g = view(spark, d, "v_signal").groupBy("run", "channel")
    return g.agg(F.round(F.sum(F.col("mz") * F.col("intensity")) / F.sum("intensity"), 6).alias("mz"), F.round(F.max("intensity"), 4).alias("apex"), F.count("*").alias("n"))


@query("""WITH m AS (SELECT scan_id, mz, intensity, min(mz) OVER (PARTITION BY scan_id) AS lo, max(mz) OVER (PARTITION BY scan_id) AS hi FROM v_peak) SELECT scan_id, round(min(lo), 6) AS lowest_mz, round(max(hi), 6) AS highest_mz, sum(intensity) AS tic, max(intensity) AS base_intensity FROM m GROUP BY scan_id""")
def spectrum_description(spark, d):
    """Range, total and base intensity of each peak list."""
    return view(spark, d, "v_peak").groupBy("scan_id").agg(F.round(F.min("mz"), 6).alias("lowest_mz"), F.round(F.max("mz"), 6).alias("highest_mz"), F.sum("intensity").alias("tic"), F.max("intensity").alias("base_intensity"))


@query("""WITH r AS (SELECT scan_id, charge, mz, intensity, row_number() OVER (PARTITION BY scan_id, charge ORDER BY mz, intensity, ord, part) - 1 AS k FROM v_peak) SELECT scan_id, CAST(k AS BIGINT) AS position, sum(intensity) AS intensity, round(sum(mz * intensity) / sum(intensity) + 1e-8, 4) AS mz FROM r GROUP BY scan_id, k""")
def sum_envelopes(spark, d):
    """Envelopes added position by position, m/z weighted by signal."""
    k = (F.row_number().over(W.partitionBy("scan_id", "charge").orderBy("mz", "intensity", "ord", "part")) - 1).cast("long")
    r = view(spark, d, "v_peak").withColumn("position", k)
    return r.groupBy("scan_id", "position").agg(F.sum("intensity").alias("intensity"), F.round(F.sum(F.col("mz") * F.col("intensity")) / F.sum("intensity") + 1e-8, 4).alias("mz"))
