"""User functions, archives of runs, identifiers and text parameters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from massloom.catalog import query
from massloom.catalog.deconvolution import FITS, fits
from massloom.operators import plugins
from massloom.plans.views import view


@query(f"{FITS} SELECT scan_id, charge, round(sum(abs(obs - theo)), 4) AS score FROM fit GROUP BY scan_id, charge")
def function_scorer(spark, d):
    """Fits scored by a function of the user's: here the sum of absolute differences."""
    out = plugins.score_fits(fits(spark, d), ["scan_id", "charge"], lambda obs, theo: F.sum(F.abs(obs - theo)))
    return out.withColumn("score", F.round("score", 4))


@query("SELECT scan_id, charge FROM v_scan WHERE ms_level = 2 AND charge % 2 = 1 AND tic > 50000")
def callable_filter(spark, d):
    """Scans that pass a predicate of the user's over batches."""

    def keep(f: pd.DataFrame) -> pd.Series:
        return (f.ms_level == 2) & (f.charge % 2 == 1) & (f.tic > 50000)

    return plugins.filter_scans(view(spark, d, "v_scan").select("scan_id", "ms_level", "charge", "tic"), keep).select("scan_id", "charge")


@query("SELECT scan_id, round(mz, 6) AS mz, intensity FROM v_peak WHERE charge > 2 AND intensity >= 4500")
def retention_hook(spark, d):
    """Peaks that no solution explains and that a rule of the user's keeps: here strong ones of higher charge."""
    p = view(spark, d, "v_peak").select("scan_id", "mz", "charge", "intensity")
    solved = p.filter("charge <= 2").select("scan_id", "charge").distinct()
    return plugins.retain_peaks(p, solved, ["scan_id", "charge"], lambda rest: rest.filter("intensity >= 4500")).select("scan_id", F.round("mz", 6).alias("mz"), "intensity")


@query("""WITH r AS (SELECT scan_id, mz, intensity, row_number() OVER (PARTITION BY scan_id ORDER BY snr DESC, intensity DESC, mz) AS r FROM v_peak WHERE snr >= 3) SELECT scan_id, round(mz, 6) AS mz, intensity FROM r WHERE r <= 3""")
def selector_hook(spark, d):
    """The best of each group in an order of the user's, among those that pass."""
    p = view(spark, d, "v_peak").select("scan_id", "mz", "intensity", "snr")
    out = plugins.select_fits(p, ["scan_id"], [F.desc("snr"), F.desc("intensity"), "mz"], F.col("snr") >= 3, 3)
    return out.select("scan_id", F.round("mz", 6).alias("mz"), "intensity")


@query("SELECT ms_level, count(*) AS n, round(sum(tic), 2) AS tic FROM v_scan GROUP BY ms_level")
def task_over_ranges(spark, d):
    """A task of the user's over ranges of scans; its partial results are combined."""

    def task(f: pd.DataFrame) -> pd.DataFrame:
        return f.groupby("ms_level", as_index=False).agg(n=("tic", "size"), tic=("tic", "sum"))

    parts = plugins.over_ranges(view(spark, d, "v_scan").select("scan_id", "ms_level", "tic"), "scan_id", 8, task, "ms_level int, n long, tic double")
    return parts.groupBy("ms_level").agg(F.sum("n").alias("n"), F.round(F.sum("tic"), 2).alias("tic"))


USI = "'mzspec:PXD' || lpad(CAST(scan_id % 7 AS VARCHAR), 6, '0') || ':run' || (scan_id % 3) || ':scan:' || scan_id"


@query("SELECT scan_id, 'PXD' || lpad(CAST(scan_id % 7 AS VARCHAR), 6, '0') AS dataset, 'run' || (scan_id % 3) AS run, ms_level, round(precursor_mz, 5) AS precursor_mz, charge FROM v_scan WHERE scan_id % 50 = 0")
def handle_usi(spark, d):
    """Universal spectrum identifiers taken apart and resolved to their spectra; the queries are every fiftieth id."""
    v = view(spark, d, "v_scan")
    usi = F.format_string("mzspec:PXD%06d:run%d:scan:%d", F.col("scan_id") % 7, F.col("scan_id") % 3, F.col("scan_id"))
    asked = v.filter("scan_id % 50 = 0").select(F.split(usi, ":").alias("u"))
    parts = asked.select(F.get("u", F.lit(1)).alias("dataset"), F.get("u", F.lit(2)).alias("run"), F.get("u", F.lit(4)).cast("long").alias("scan_id"))
    return parts.join(v, "scan_id").select("scan_id", "dataset", "run", "ms_level", F.round("precursor_mz", 5).alias("precursor_mz"), "charge")


@query("""SELECT r_name AS dataset, count(*) AS n_files, min(n_name || '.mzML') AS first, max(n_name || '.mzML') AS last FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""")
def archive_datasets(spark, d):
    """The datasets of an archive with their runs' files."""
    r, n = spark.read.parquet(f"{d}/region.parquet"), spark.read.parquet(f"{d}/nation.parquet")
    file = F.concat("n_name", F.lit(".mzML"))
    return r.join(n, r.r_regionkey == n.n_regionkey).groupBy(F.col("r_name").alias("dataset")).agg(F.count("*").alias("n_files"), F.min(file).alias("first"), F.max(file).alias("last"))


@query("""WITH f AS (SELECT r_name AS dataset, n_name AS run FROM region JOIN nation ON n_regionkey = r_regionkey), q AS (SELECT DISTINCT dataset, left(run, 2) AS wanted FROM f) SELECT q.dataset, wanted, count(*) AS n, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'found' END AS outcome, min(run) AS run FROM q JOIN f ON f.dataset = q.dataset AND starts_with(f.run, wanted) GROUP BY q.dataset, wanted""")
def find_ms_files(spark, d):
    """Files of a dataset whose name starts as asked; more than one is ambiguous."""
    r, n = spark.read.parquet(f"{d}/region.parquet"), spark.read.parquet(f"{d}/nation.parquet")
    f = r.join(n, r.r_regionkey == n.n_regionkey).select(F.col("r_name").alias("dataset"), F.col("n_name").alias("run"))
    q = f.select("dataset", F.substring("run", 1, 2).alias("wanted")).distinct()
    g = q.join(f, "dataset").filter(F.col("run").startswith(F.col("wanted"))).groupBy("dataset", "wanted")
    return g.agg(F.count("*").alias("n"), F.when(F.count("*") > 1, "ambiguous").otherwise("found").alias("outcome"), F.min("run").alias("run"))


@query("""WITH k AS (SELECT DISTINCT name AS key FROM v_target), q AS (SELECT DISTINCT right(name, 1) AS tail FROM v_target), r AS (SELECT tail, key, row_number() OVER (PARTITION BY tail ORDER BY CASE WHEN key = tail THEN 0 ELSE 1 END, length(key) DESC, key) AS r FROM q JOIN k ON contains(key, tail)) SELECT tail, key FROM r WHERE r = 1""")
def subsequence_lookup(spark, d):
    """An exact key if there is one, else the longest that contains what is asked."""
    t = view(spark, d, "v_target")
    k, q = t.select(F.col("name").alias("key")).distinct(), t.select(F.right(F.col("name"), F.lit(1)).alias("tail")).distinct()
    letters = k.withColumn("first", F.explode(F.array_distinct(F.split("key", ""))))  # what contains a text has its first letter
    pairs = q.withColumn("first", F.left("tail", F.lit(1))).join(letters, "first").filter(F.col("key").contains(F.col("tail"))).select("tail", "key")
    r = F.row_number().over(W.partitionBy("tail").orderBy(F.when(F.col("key") == F.col("tail"), 0).otherwise(1), F.desc(F.length("key")), "key"))
    return pairs.withColumn("r", r).filter("r = 1").select("tail", "key")


VALUE = "CASE scan_id % 4 WHEN 0 THEN CAST(scan_id AS VARCHAR) WHEN 1 THEN CAST(scan_id AS VARCHAR) || '.5' WHEN 2 THEN 'scan' || scan_id ELSE 'None' END"


@query(f"WITH v AS (SELECT scan_id, {VALUE} AS v FROM v_scan) SELECT scan_id, CASE WHEN v = 'None' THEN 'null' WHEN try_cast(v AS BIGINT) IS NOT NULL AND NOT contains(v, '.') THEN 'int' WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'string' END AS kind, try_cast(v AS DOUBLE) AS number FROM v")
def type_cast(spark, d):
    """Text values as what they say: whole numbers, reals, nothing, or text."""
    n = F.col("scan_id").cast("string")
    v = F.when(F.col("scan_id") % 4 == 0, n).when(F.col("scan_id") % 4 == 1, F.concat(n, F.lit(".5"))).when(F.col("scan_id") % 4 == 2, F.concat(F.lit("scan"), n)).otherwise("None")
    x = view(spark, d, "v_scan").select("scan_id", v.alias("v"))
    kind = F.when(F.col("v") == "None", "null").when(F.col("v").rlike(r"^[-+]?\d+$"), "int").when(F.col("v").try_cast("double").isNotNull(), "float").otherwise("string")
    return x.select("scan_id", kind.alias("kind"), F.col("v").try_cast("double").alias("number"))


METHOD = "'Segment ' || (target_id % 3 + 1) || ' Scan Event ' || (target_id % 5 + 1) || ' Isolation Width: ' || (target_id % 4 + 1) || '.5 Activation: HCD'"


@query(f"WITH m AS (SELECT target_id, {METHOD} AS t FROM v_target) SELECT target_id, CAST(regexp_extract(t, 'Segment ([0-9]+)', 1) AS BIGINT) AS segment, CAST(regexp_extract(t, 'Event ([0-9]+)', 1) AS BIGINT) AS event, CAST(regexp_extract(t, 'Width: ([0-9.]+)', 1) AS DOUBLE) AS width FROM m")
def method_parser(spark, d):
    """Isolation widths by segment and scan event from an instrument method's text."""
    at = lambda k: (F.col("target_id") % k + 1).cast("string")
    text = F.concat(F.lit("Segment "), at(3), F.lit(" Scan Event "), at(5), F.lit(" Isolation Width: "), at(4), F.lit(".5 Activation: HCD"))
    m = view(spark, d, "v_target").select("target_id", text.alias("t"))
    found = lambda p: F.regexp_extract("t", p, 1)
    return m.select("target_id", found("Segment ([0-9]+)").cast("long").alias("segment"), found("Event ([0-9]+)").cast("long").alias("event"), found("Width: ([0-9.]+)").cast("double").alias("width"))


@query("SELECT scan_id, CAST(pow(2, ceil(log2(1 + count(*)))) AS BIGINT) AS size, round(avg(mz), 5) AS mean_mz FROM v_peak GROUP BY scan_id")
def power_of_two(spark, d):
    """The power of two that holds a spectrum's bins, and its plain mean m/z."""
    return view(spark, d, "v_peak").groupBy("scan_id").agg(F.pow(F.lit(2), F.ceil(F.log2(F.count("*") + 1))).cast("long").alias("size"), F.round(F.avg("mz"), 5).alias("mean_mz"))


@query("SELECT target_id, round(target_mass * (1 - 1e-5), 6) AS low, round(target_mass * (1 + 1e-5), 6) AS high, round(size - 0.25, 4) AS start_time, round(size + 0.25, 4) AS end_time FROM v_target")
def query_intervals(spark, d):
    """Search intervals: a mass with its tolerance and a time with its width."""
    m, t = F.col("target_mass"), F.col("size")
    return view(spark, d, "v_target").select("target_id", F.round(m * (1 - 1e-5), 6).alias("low"), F.round(m * (1 + 1e-5), 6).alias("high"), F.round(t - F.lit(0.25), 4).alias("start_time"), F.round(t + F.lit(0.25), 4).alias("end_time"))
