"""Scan filters, grouping and ordered iteration."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from massloom.catalog import query
from massloom.operators.ordered import group_scans as open_groups
from massloom.operators.ordered import next_where, previous_where, row_numbers, sliding_windows
from massloom.plans.views import view

ORDER = ["scan_time", "scan_id"]


@query("""WITH b AS (SELECT coalesce(max(scan_time) FILTER (ms_level = 1 AND scan_time <= 50), 50) AS lo FROM v_scan)
SELECT scan_id, round(scan_time, 6) AS scan_time, ms_level FROM v_scan, b WHERE scan_time BETWEEN lo AND 90""")
def time_range_scan(spark, d):
    """Scans of a time range, its start moved back to the MS1 before."""
    v = view(spark, d, "v_scan")
    low = v.agg(F.coalesce(F.max(F.when((F.col("ms_level") == 1) & (F.col("scan_time") <= 50), F.col("scan_time"))), F.lit(50.0)).alias("lo"))
    return v.join(F.broadcast(low), F.col("scan_time").between(F.col("lo"), 90)).select("scan_id", F.round("scan_time", 6).alias("scan_time"), "ms_level")


@query("""SELECT scan_id, ms_level FROM v_scan WHERE scan_id BETWEEN 1000 AND 2000""")
def index_range_scan(spark, d):
    return view(spark, d, "v_scan").filter(F.col("scan_id").between(1000, 2000)).select("scan_id", "ms_level")


@query("""SELECT scan_id, round(precursor_mz, 6) AS precursor_mz FROM v_scan WHERE ms_level = 2""")
def ms_level_filter(spark, d):
    return view(spark, d, "v_scan").filter("ms_level = 2").select("scan_id", F.round("precursor_mz", 6).alias("precursor_mz"))


@query("""SELECT scan_id FROM v_scan WHERE polarity = -1""")
def polarity_filter(spark, d):
    return view(spark, d, "v_scan").filter("polarity = -1").select("scan_id")


@query("""WITH g AS (SELECT *, sum(CASE WHEN ms_level = 1 THEN 1 ELSE 0 END) OVER (ORDER BY scan_time, scan_id ROWS UNBOUNDED PRECEDING) AS group_id FROM v_scan)
SELECT scan_id, ms_level, CAST(group_id AS BIGINT) AS group_id FROM g""")
def group_scans(spark, d):
    return open_groups(view(spark, d, "v_scan"), ORDER).select("scan_id", "ms_level", "group_id")


@query("""WITH g AS (SELECT *, sum(CASE WHEN ms_level = 1 THEN 1 ELSE 0 END) OVER (ORDER BY scan_time, scan_id ROWS UNBOUNDED PRECEDING) AS group_id FROM v_scan)
SELECT CAST(group_id AS BIGINT) AS group_id, max(CASE WHEN ms_level = 1 AND polarity = 1 THEN scan_id END) AS precursor_id, count(*) FILTER (ms_level = 2 AND polarity = 1) AS n_products FROM g GROUP BY group_id HAVING count(*) FILTER (ms_level = 2) > 0""")
def bunch_filter(spark, d):
    """A predicate over groups: groups without products go, the precursor and each product must pass."""
    g = open_groups(view(spark, d, "v_scan"), ORDER)
    good, product = F.col("polarity") == 1, F.col("ms_level") == 2
    out = g.groupBy("group_id").agg(F.max(F.when(~product & good, F.col("scan_id"))).alias("precursor_id"), F.count(F.when(product & good, 1)).alias("n_products"), F.count(F.when(product, 1)).alias("_all"))
    return out.filter("_all > 0").drop("_all")


@query("""SELECT scan_id, last_value(CASE WHEN ms_level = 1 THEN scan_id END IGNORE NULLS) OVER (ORDER BY scan_time, scan_id ROWS UNBOUNDED PRECEDING) AS previous_ms1 FROM v_scan""")
def previous_ms1(spark, d):
    return previous_where(view(spark, d, "v_scan"), ORDER, F.col("ms_level") == 1, "scan_id", "previous_ms1").select("scan_id", "previous_ms1")


@query("""SELECT scan_id, first_value(CASE WHEN ms_level = 1 THEN scan_id END IGNORE NULLS) OVER (ORDER BY scan_time, scan_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ms1 FROM v_scan""")
def next_ms1(spark, d):
    return next_where(view(spark, d, "v_scan"), ORDER, F.col("ms_level") == 1, "scan_id", "next_ms1").select("scan_id", "next_ms1")


@query("""WITH m AS (SELECT tic, row_number() OVER (ORDER BY scan_time, scan_id) - 1 AS n FROM v_scan WHERE ms_level = 1),
w AS (SELECT tic, n, unnest(range(greatest(0, CAST(floor((n - 10) / 5.0) AS BIGINT) + 1), CAST(floor(n / 5.0) AS BIGINT) + 1)) AS window_id FROM m)
SELECT window_id, count(*) AS n_scans, round(avg(tic) * 10, 3) AS intensity FROM w GROUP BY window_id""")
def merge_ms1_windows(spark, d):
    """Count windows of ten MS1 scans that slide by five; the mean times the width."""
    m = row_numbers(view(spark, d, "v_scan").filter("ms_level = 1"), ORDER, "n").withColumn("n", F.col("n") - 1)
    return sliding_windows(m, "n", 10, 5).groupBy("window_id").agg(F.count("*").alias("n_scans"), F.round(F.avg("tic") * 10, 3).alias("intensity"))


@query("""WITH u AS (SELECT scan_id, scan_time, 'a' AS run FROM v_scan WHERE polarity = 1 UNION ALL SELECT scan_id, scan_time, 'b' FROM v_scan WHERE polarity = -1)
SELECT scan_id, run, row_number() OVER (ORDER BY scan_time, scan_id) AS position FROM u""")
def kway_merge(spark, d):
    v = view(spark, d, "v_scan").select("scan_id", "scan_time", "polarity")
    u = v.filter("polarity = 1").withColumn("run", F.lit("a")).unionByName(v.filter("polarity = -1").withColumn("run", F.lit("b")))
    return row_numbers(u, ORDER, "position").select("scan_id", "run", "position")


@query("""WITH c AS (SELECT channel, event_id, row_number() OVER (PARTITION BY channel ORDER BY ts, event_id) AS n FROM v_signal)
SELECT a.n AS n, a.event_id AS click_id, b.event_id AS view_id FROM (SELECT * FROM c WHERE channel = 'click') a FULL OUTER JOIN (SELECT * FROM c WHERE channel = 'view') b ON a.n = b.n WHERE a.n IS NOT NULL""")
def demux_channels(spark, d):
    """Split a stream into channels and pair their heads by position."""
    n = F.row_number().over(W.partitionBy("channel").orderBy("ts", "event_id")).cast("long")
    c = view(spark, d, "v_signal").withColumn("n", n)
    a = c.filter("channel = 'click'").select("n", F.col("event_id").alias("click_id"))
    b = c.filter("channel = 'view'").select("n", F.col("event_id").alias("view_id"))
    return a.join(b, "n", "full").filter("click_id is not null").select("n", "click_id", "view_id")


@query("""SELECT scan_id, CASE WHEN precursor_mz IS NULL THEN true ELSE precursor_mz BETWEEN 500 - 100 AND 500 + 150 END AS spans FROM v_scan""")
def isolation_valid(spark, d):
    mz = F.col("precursor_mz")
    return view(spark, d, "v_scan").select("scan_id", F.when(mz.isNull(), True).otherwise(mz.between(400, 650)).alias("spans"))


@query("""WITH s AS (SELECT scan_id, 'controllerType=0 controllerNumber=' || charge || ' scan=' || scan_id AS native_id FROM v_scan)
SELECT scan_id, regexp_extract(native_id, 'scan=([0-9]+)', 1) AS scan_field, regexp_extract(native_id, 'controllerNumber=([0-9]+)', 1) AS controller FROM s""")
def native_id_parse(spark, d):
    native = F.concat(F.lit("controllerType=0 controllerNumber="), F.col("charge"), F.lit(" scan="), F.col("scan_id"))
    fields = F.call_function("str_to_map", F.col("native_id"), F.lit(" "), F.lit("="))
    return view(spark, d, "v_scan").select("scan_id", native.alias("native_id")).select("scan_id", fields["scan"].alias("scan_field"), fields["controllerNumber"].alias("controller"))


@query("""WITH s AS (SELECT scan_id, 'FTMS ' || CASE WHEN polarity = 1 THEN '+' ELSE '-' END || ' p NSI Full ms' || CASE WHEN ms_level = 1 THEN '' ELSE '2' END || ' [100.00-2000.00]' AS f FROM v_scan)
SELECT scan_id, regexp_extract(f, '^([A-Z]+) ', 1) AS analyzer, regexp_extract(f, '\\[([0-9.]+)-', 1) AS low, CASE WHEN regexp_extract(f, ' ms([0-9]*)', 1) = '' THEN 1 ELSE CAST(regexp_extract(f, ' ms([0-9]*)', 1) AS INT) END AS level FROM s""")
def filter_string_parse(spark, d):
    v = view(spark, d, "v_scan")
    text = F.concat(F.lit("FTMS "), F.when(F.col("polarity") == 1, "+").otherwise("-"), F.lit(" p NSI Full ms"), F.when(F.col("ms_level") == 1, "").otherwise("2"), F.lit(" [100.00-2000.00]"))
    level = F.regexp_extract("f", r" ms([0-9]*)", 1)
    return v.select("scan_id", text.alias("f")).select("scan_id", F.regexp_extract("f", r"^([A-Z]+) ", 1).alias("analyzer"), F.regexp_extract("f", r"\[([0-9.]+)-", 1).alias("low"), F.when(level == "", 1).otherwise(F.expr("try_cast(regexp_extract(f, ' ms([0-9]*)', 1) AS INT)")).alias("level"))


@query("""WITH e AS (SELECT *, CASE WHEN channel IN ('click', 'view') THEN 1 ELSE 0 END AS low FROM v_signal)
SELECT run, event_id, CAST(sum(low) OVER (PARTITION BY run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cycle FROM e WHERE channel <> 'error'""")
def energy_alternation(spark, d):
    """Low-energy scans open cycles for the high-energy ones that follow; lock-mass scans (errors) are set aside."""
    w = W.partitionBy("run").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    e = view(spark, d, "v_signal").filter("channel <> 'error'")
    return e.select("run", "event_id", F.sum(F.col("channel").isin("click", "view").cast("int")).over(w).alias("cycle"))
