"""Metadata index queries and run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from massloom.catalog import query
from massloom.functions.mass import PROTON, neutral_mass
from massloom.operators.joins import range_join
from massloom.operators.ordered import coalesce_spans, group_scans, previous_where
from massloom.plans.store import materialize
from massloom.plans.views import view

MASS = f"precursor_mz * charge - charge * {PROTON}"


@query(f"""WITH g AS (SELECT *, last_value(CASE WHEN ms_level = 1 THEN scan_id END IGNORE NULLS) OVER (ORDER BY scan_time, scan_id ROWS UNBOUNDED PRECEDING) AS precursor_id FROM v_scan)
SELECT scan_id, precursor_id, charge, round(precursor_mz, 6) AS mz, round({MASS}, 5) AS neutral_mass, precursor_id IS NULL AS orphan FROM g WHERE ms_level = 2""")
def index_build(spark, d):
    """A record for each product scan: precursor, charge, mass, whether it has none."""
    g = previous_where(view(spark, d, "v_scan"), ["scan_time", "scan_id"], F.col("ms_level") == 1, "scan_id", "precursor_id").filter("ms_level = 2")
    return g.select("scan_id", "precursor_id", "charge", F.round("precursor_mz", 6).alias("mz"), F.round(neutral_mass(F.col("precursor_mz"), F.col("charge")), 5).alias("neutral_mass"), F.col("precursor_id").isNull().alias("orphan"))


@query(f"""WITH t AS (SELECT target_id, target_mass FROM v_target), s AS (SELECT scan_id, scan_time, {MASS} AS mass FROM v_scan WHERE ms_level = 2)
SELECT target_id, scan_id, round(mass, 5) AS mass FROM t JOIN s ON abs(mass - target_mass) <= target_mass * 1e-4""")
def msms_for(spark, d):
    """Product scans by precursor mass within tolerance and time."""
    t = view(spark, d, "v_target").select("target_id", "target_mass")
    s = view(spark, d, "v_scan").filter("ms_level = 2").select("scan_id", neutral_mass(F.col("precursor_mz"), F.col("charge")).alias("mass"))
    return range_join(t, s, "target_mass", "mass", 1e-4).select("target_id", "scan_id", F.round("mass", 5).alias("mass"))


@query("""SELECT charge, count(*) AS n FROM v_scan WHERE ms_level = 2 GROUP BY charge""")
def charge_states(spark, d):
    return view(spark, d, "v_scan").filter("ms_level = 2").groupBy("charge").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT *, sum(CASE WHEN ms_level = 1 THEN 1 ELSE 0 END) OVER (ORDER BY scan_time, scan_id ROWS UNBOUNDED PRECEDING) AS g FROM v_scan),
a AS (SELECT g, min(scan_time) FILTER (ms_level = 1) AS t, max(scan_time) AS last_t, sum(tic) FILTER (ms_level = 1) AS tic, count(*) FILTER (ms_level = 2) AS n_products FROM g WHERE g > 0 GROUP BY g)
SELECT CAST(g AS BIGINT) AS group_id, round(coalesce(lead(t) OVER (ORDER BY g), last_t) - t, 6) AS duty_cycle, round(tic, 4) AS tic, n_products FROM a""")
def ms1_diagnostics(spark, d):
    """Duty cycle, signal and products of each MS1; the last one's cycle ends with its last product."""
    g = group_scans(view(spark, d, "v_scan"), ["scan_time", "scan_id"]).filter("group_id > 0")
    one = F.col("ms_level") == 1
    a = g.groupBy("group_id").agg(F.min(F.when(one, F.col("scan_time"))).alias("t"), F.max("scan_time").alias("last_t"), F.sum(F.when(one, F.col("tic"))).alias("tic"), F.count(F.when(~one, 1)).alias("n_products"))
    # the next group's time by its number: an equality, where a window would order all groups in one task
    a = materialize(a, "ms1-groups")
    a = a.join(a.select((F.col("group_id") - 1).alias("group_id"), F.col("t").alias("next_t")), "group_id", "left")
    cycle = F.coalesce("next_t", "last_t") - F.col("t")
    return a.select("group_id", F.round(cycle, 6).alias("duty_cycle"), F.round("tic", 4).alias("tic"), "n_products")


@query("""WITH c AS (SELECT name, count(*) AS n, var_samp(target_mass) AS v FROM v_target GROUP BY name HAVING count(*) > 1) SELECT round(sqrt(sum(v * (n - 1)) / sum(n - 1)), 6) AS pooled_sd, count(*) AS n_groups FROM c""")
def pooled_mass_sd(spark, d):
    c = view(spark, d, "v_target").groupBy("name").agg(F.count("*").alias("n"), F.var_samp("target_mass").alias("v")).filter("n > 1")
    return c.agg(F.round(F.sqrt(F.sum(F.col("v") * (F.col("n") - 1)) / F.sum(F.col("n") - 1)), 6).alias("pooled_sd"), F.count("*").alias("n_groups"))


@query("""WITH b AS (SELECT instrument, precursor_mz - 2 AS lo, precursor_mz + 3 AS hi FROM v_scan WHERE ms_level = 2 AND 60 BETWEEN greatest(scan_time - 5, 0) AND scan_time + 5),
n AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY instrument ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM b), s AS (SELECT *, sum(new) OVER (PARTITION BY instrument ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM n)
SELECT instrument, round(min(lo), 6) AS low, round(max(hi), 6) AS high FROM s GROUP BY instrument, k""")
def mz_intervals_for_time(spark, d):
    """The merged m/z intervals of all boxes around precursors at one time."""
    v = view(spark, d, "v_scan").filter("ms_level = 2").filter(F.lit(60).between(F.greatest(F.col("scan_time") - 5, F.lit(0)), F.col("scan_time") + 5))
    b = v.select("instrument", (F.col("precursor_mz") - 2).alias("low"), (F.col("precursor_mz") + 3).alias("high"))
    return coalesce_spans(b, ["instrument"], "low", "high").select("instrument", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("""SELECT ms_level, charge, count(*) AS n, round(sum(tic), 2) AS tic FROM v_scan GROUP BY ROLLUP (ms_level, charge)""")
def describe_rollup(spark, d):
    return view(spark, d, "v_scan").rollup("ms_level", "charge").agg(F.count("*").alias("n"), F.round(F.sum("tic"), 2).alias("tic"))


@query("""SELECT scan_id, CAST(count(*) AS BIGINT) AS n FROM v_peak WHERE mz * charge >= 1500 AND intensity >= 1000 GROUP BY scan_id""")
def ms1_peaks_above(spark, d):
    return view(spark, d, "v_peak").filter("mz * charge >= 1500 and intensity >= 1000").groupBy("scan_id").agg(F.count("*").alias("n"))


@query("""SELECT scan_id, round(greatest(scan_time - 5, 0), 6) AS t0, round(scan_time + 5, 6) AS t1, round(greatest(precursor_mz - 2, 0), 6) AS low, round(precursor_mz + 3, 6) AS high FROM v_scan WHERE ms_level = 2""")
def extract_intervals(spark, d):
    v = view(spark, d, "v_scan").filter("ms_level = 2")
    t, m = F.col("scan_time"), F.col("precursor_mz")
    return v.select("scan_id", F.round(F.greatest(t - 5, F.lit(0)), 6).alias("t0"), F.round(t + 5, 6).alias("t1"), F.round(F.greatest(m - 2, F.lit(0)), 6).alias("low"), F.round(m + 3, 6).alias("high"))


@query("""WITH a AS (SELECT scan_id, 'x' AS src, charge FROM v_scan WHERE ms_level = 1 OR charge < 3 UNION ALL SELECT scan_id, 'y', charge FROM v_scan WHERE ms_level = 2) SELECT scan_id, min(charge) AS charge, count(*) AS n_sources FROM a GROUP BY scan_id""")
def index_merge(spark, d):
    """Indexes of two sources, survey scans with low charges and all product scans, as one."""
    v = view(spark, d, "v_scan")
    return v.filter("ms_level = 1 or charge < 3").unionByName(v.filter("ms_level = 2")).groupBy("scan_id").agg(F.min("charge").alias("charge"), F.count("*").alias("n_sources"))


@query("""SELECT user_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS mobility, count(*) AS n FROM events GROUP BY ALL""")
def mobility_from_json(spark, d):
    """Scan attributes held as JSON."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy("user_id", F.get_json_object("props", "$.k").cast("long").alias("mobility")).agg(F.count("*").alias("n"))
