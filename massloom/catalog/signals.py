"""Signal processing over ordered points: smoothing, maxima, averaging, regression."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from massloom.catalog import query
from massloom.operators.ordered import row_numbers
from massloom.plans.views import view

W_SQL = "OVER (PARTITION BY run ORDER BY ts, event_id)"


def w_run():
    return W.partitionBy("run").orderBy("ts", "event_id")


@query(f"""SELECT event_id, round((coalesce(lag(intensity) {W_SQL}, 0) + intensity + coalesce(lead(intensity) {W_SQL}, 0)) / 3, 6) AS smooth FROM v_signal""")
def sliding_mean(spark, d):
    i = F.col("intensity")
    return view(spark, d, "v_signal").select("event_id", F.round((F.coalesce(F.lag(i).over(w_run()), F.lit(0)) + i + F.coalesce(F.lead(i).over(w_run()), F.lit(0))) / 3, 6).alias("smooth"))


@query(f"""SELECT event_id, round(list_sort([coalesce(lag(intensity) {W_SQL}, 0), intensity, coalesce(lead(intensity) {W_SQL}, 0)])[2], 6) AS smooth FROM v_signal""")
def sliding_median(spark, d):
    i = F.col("intensity")
    three = F.array(F.coalesce(F.lag(i).over(w_run()), F.lit(0.0)), i, F.coalesce(F.lead(i).over(w_run()), F.lit(0.0)))
    return view(spark, d, "v_signal").select("event_id", F.round(F.get(F.sort_array(three), 1), 6).alias("smooth"))


@query(f"""WITH n AS (SELECT event_id, run, intensity, lag(intensity) {W_SQL} AS a, lead(intensity) {W_SQL} AS b FROM v_signal) SELECT event_id, run FROM n WHERE intensity > coalesce(a, -1) AND intensity > coalesce(b, -1)""")
def local_maxima(spark, d):
    n = view(spark, d, "v_signal").select("event_id", "run", "intensity", F.lag("intensity", 1, -1.0).over(w_run()).alias("a"), F.lead("intensity", 1, -1.0).over(w_run()).alias("b"))
    return n.filter("intensity > a and intensity > b").select("event_id", "run")


@query("""WITH n AS (SELECT run, intensity AS y, row_number() OVER (PARTITION BY run ORDER BY ts, event_id) AS x FROM v_signal),
c AS (SELECT run, covar_pop(y, x) / var_pop(x) AS slope, avg(y) - covar_pop(y, x) / var_pop(x) * avg(x) AS icpt FROM n GROUP BY run HAVING count(*) > 2)
SELECT run, round(sum((y - icpt - slope * x) * (y - icpt - slope * x)), 2) AS residual FROM n JOIN c USING (run) GROUP BY run""")
def ols_residuals(spark, d):
    n = view(spark, d, "v_signal").select("run", F.col("intensity").alias("y"), F.row_number().over(w_run()).alias("x"))
    c = n.groupBy("run").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("icpt"), F.count("*").alias("n")).filter("n > 2")
    return n.join(c, "run").groupBy("run").agg(F.round(F.sum(F.pow(F.col("y") - F.col("icpt") - F.col("slope") * F.col("x"), 2)), 2).alias("residual"))


@query("""SELECT scan_id, sum(intensity) AS tic, count(*) AS n_peaks FROM v_peak GROUP BY scan_id""")
def tic(spark, d):
    return view(spark, d, "v_peak").groupBy("scan_id").agg(F.sum("intensity").alias("tic"), F.count("*").alias("n_peaks"))


@query("""SELECT scan_id, round(min(mz), 6) AS mz, max(intensity) AS intensity FROM (SELECT *, max(intensity) OVER (PARTITION BY scan_id) AS top FROM v_peak) t WHERE intensity = top GROUP BY scan_id""")
def base_peak(spark, d):
    """The strongest peak of each scan, the lower m/z on ties."""
    best = F.max(F.struct("intensity", (-F.col("mz")).alias("m"))).alias("b")
    return view(spark, d, "v_peak").groupBy("scan_id").agg(best).select("scan_id", F.round(-F.col("b.m"), 6).alias("mz"), F.col("b.intensity").alias("intensity"))


@query("""WITH m AS (SELECT scan_id, scan_time, tic FROM v_scan WHERE ms_level = 1)
SELECT scan_id, round(avg(tic) OVER (ORDER BY scan_time, scan_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS average FROM m""")
def adjacent_average(spark, d):
    m = row_numbers(view(spark, d, "v_scan").filter("ms_level = 1"), ["scan_time", "scan_id"], "n")
    near = m.select("tic", F.explode(F.sequence(F.col("n") - 2, F.col("n") + 2)).alias("n"))
    average = near.groupBy("n").agg(F.avg("tic").alias("a"))
    return m.select("n", "scan_id").join(average, "n").select("scan_id", F.round("a", 4).alias("average"))


@query("""WITH m AS (SELECT scan_id, scan_time, tic FROM v_scan WHERE ms_level = 1), p AS (SELECT a.scan_id, exp(-pow(a.scan_time - b.scan_time, 2) / (2 * 0.025 * 0.025)) AS w, b.tic FROM m a JOIN m b ON abs(a.scan_time - b.scan_time) <= 0.1)
SELECT scan_id, round(sum(w * tic) / sum(w), 4) AS smoothed FROM p GROUP BY scan_id""")
def gaussian_weights(spark, d):
    """Average over scans near in time, weighted by a Gaussian of the time difference."""
    m = view(spark, d, "v_scan").filter("ms_level = 1").select("scan_id", "scan_time", "tic")
    cell = F.floor(F.col("scan_time") / 0.1)
    a = m.select("scan_id", F.col("scan_time").alias("t"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    p = a.join(m.select("scan_time", "tic", cell.alias("cell")), "cell").filter(F.abs(F.col("t") - F.col("scan_time")) <= 0.1)
    w = F.exp(-F.pow(F.col("t") - F.col("scan_time"), 2) / (2 * 0.025 * 0.025))
    return p.withColumn("w", w).groupBy("scan_id").agg(F.round(F.sum(F.col("w") * F.col("tic")) / F.sum("w"), 4).alias("smoothed"))


@query("""WITH s AS (SELECT run, ts, event_id, intensity AS y, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS x FROM v_signal), n AS (SELECT *, lead(x) OVER (PARTITION BY run ORDER BY ts, event_id) AS x2, lead(y) OVER (PARTITION BY run ORDER BY ts, event_id) AS y2 FROM s),
g AS (SELECT *, unnest(range(CAST(ceil(x / 3600) AS BIGINT), CAST(ceil(x2 / 3600) AS BIGINT))) AS h FROM n WHERE x2 > x) SELECT run, h AS hour, round(y + (y2 - y) * (h * 3600 - x) / (x2 - x), 4) AS value FROM g""")
def interpolate_grid(spark, d):
    """Linear resampling of each run to whole hours."""
    s = view(spark, d, "v_signal").withColumn("x", F.unix_micros("ts") / 1e6).withColumn("x2", F.lead("x").over(w_run())).withColumn("y2", F.lead("intensity").over(w_run())).filter("x2 > x")
    lo, hi = F.ceil(F.col("x") / 3600), F.ceil(F.col("x2") / 3600)
    g = s.filter(hi > lo).withColumn("hour", F.explode(F.sequence(lo, hi - 1)))
    y = F.col("intensity") + (F.col("y2") - F.col("intensity")) * (F.col("hour") * 3600 - F.col("x")) / (F.col("x2") - F.col("x"))
    return g.select("run", "hour", F.round(y, 4).alias("value"))
