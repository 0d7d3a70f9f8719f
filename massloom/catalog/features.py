"""Features traced over time: splitting, overlap graphs, alignment, consistency."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from massloom.catalog import query
from massloom.functions.mass import ratio
from massloom.operators.graph import connected_components, linking_edges
from massloom.operators.joins import interval_join, interval_join_2d
from massloom.operators.ordered import sessionize
from massloom.operators.pairing import correlations, spectra_of
from massloom.plans.views import view

HOURS = "CAST(epoch_us(ts) AS DOUBLE) / 3.6e9"
#: Points of a (run, channel) chromatogram, cut into features at gaps of more than a day.
SPLIT = f"""WITH t AS (SELECT run, channel, event_id, {HOURS} AS t, intensity, mz FROM v_signal), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY run, channel ORDER BY t, event_id) > 24 THEN 1 ELSE 0 END AS new FROM t),
s AS (SELECT *, sum(new) OVER (PARTITION BY run, channel ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS part FROM g),
f AS (SELECT run, channel, CAST(part AS BIGINT) AS part, min(t) AS s, max(t) AS e, min(mz) AS lo, max(mz) AS hi, count(*) AS n, sum(intensity) AS total, min(event_id) AS id FROM s GROUP BY run, channel, part HAVING count(*) >= 2)"""


def points(spark, d):
    return view(spark, d, "v_signal").select("run", "channel", "event_id", (F.unix_micros("ts") / 3.6e9).alias("t"), "intensity", "mz")


def features(spark, d):
    s = sessionize(points(spark, d), ["run", "channel"], ["t", "event_id"], F.col("t") - F.col("_prev.t") > 24, "part")
    f = s.groupBy("run", "channel", "part").agg(F.min("t").alias("s"), F.max("t").alias("e"), F.min("mz").alias("lo"), F.max("mz").alias("hi"), F.count("*").alias("n"), F.sum("intensity").alias("total"), F.min("event_id").alias("id"))
    return f.filter("n >= 2")


@query(f"{SPLIT} SELECT run, channel, part, round(s, 4) AS start_time, round(e, 4) AS end_time, n, round(total, 4) AS total FROM f")
def feature_split_sparse(spark, d):
    """Cut chromatograms where time gaps exceed a limit; parts of fewer than two points go."""
    return features(spark, d).select("run", "channel", "part", F.round("s", 4).alias("start_time"), F.round("e", 4).alias("end_time"), "n", F.round("total", 4).alias("total"))


T0 = "473353 * CAST(1 AS DOUBLE)"  # an hour in January 2024


@query(f"{SPLIT} SELECT id FROM f WHERE s <= {T0} + 240 AND e >= {T0} + 200")
def feature_between_times(spark, d):
    return features(spark, d).filter((F.col("s") <= 473353 + 240) & (F.col("e") >= 473353 + 200)).select("id")


@query(f"{SPLIT} SELECT id FROM f WHERE {T0} + 220 BETWEEN s AND e")
def feature_spanning_time(spark, d):
    return features(spark, d).filter((F.col("s") <= 473353 + 220) & (F.col("e") >= 473353 + 220)).select("id")


@query("""SELECT event_id, round(sum(mz * intensity) OVER w / sum(intensity) OVER w, 6) AS running_mz FROM v_signal WINDOW w AS (PARTITION BY run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def feature_running_mz(spark, d):
    """Intensity-weighted mean m/z up to each point."""
    w = W.partitionBy("run").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return view(spark, d, "v_signal").select("event_id", F.round(ratio(F.sum(F.col("mz") * F.col("intensity")).over(w), F.sum("intensity").over(w)), 6).alias("running_mz"))


EDGES = f"""{SPLIT}, e AS (SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON a.channel = b.channel AND a.id < b.id AND a.s <= b.e AND b.s <= a.e AND a.lo <= b.lo + 2 AND b.lo <= a.lo + 2)"""


def edges(spark, d):
    f = features(spark, d).select("channel", "id", "s", "e", F.col("lo").alias("m"), (F.col("lo") + 2).alias("m2"))
    g = f.toDF("channel", "id_b", "s_b", "e_b", "m_b", "m2_b")
    return interval_join_2d(f, g, ("s", "e", "m", "m2"), ("s_b", "e_b", "m_b", "m2_b"), (48.0, 4.0), ["channel"]).filter("id < id_b").select(F.col("id").alias("a"), F.col("id_b").alias("b"))


@query(f"{EDGES} SELECT a, b FROM e")
def feature_overlap_edges(spark, d):
    """Features of a channel near in m/z that overlap in time."""
    return edges(spark, d)


@query(EDGES.replace("WITH t AS", "WITH RECURSIVE t AS", 1) + """, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(x, y) AS (SELECT a, b FROM u UNION SELECT r.x, u.b FROM r JOIN u ON r.y = u.a)
SELECT x AS id, least(x, min(y)) AS component FROM r GROUP BY x""")
def feature_components(spark, d):
    """Features connected by overlaps, found over some of the edges that connect as all do."""
    f = features(spark, d).select("channel", "id", F.col("lo").alias("value"), "s", "e")
    e = linking_edges(f, F.floor(F.col("value") / 2), lambda x, i, y, j: y <= x + 2, lambda x, y: y <= x + 2, ["channel"])
    return connected_components(e, "a", "b")


@query("""WITH h AS (SELECT channel, run, date_trunc('day', ts) AS day, sum(intensity) AS i FROM v_signal GROUP BY ALL)
SELECT coalesce(a.run, b.run) AS run, strftime(coalesce(a.day, b.day), '%Y-%m-%d') AS day, round(coalesce(a.i, 0), 4) AS click, round(coalesce(b.i, 0), 4) AS purchase
FROM (SELECT * FROM h WHERE channel = 'click') a FULL OUTER JOIN (SELECT * FROM h WHERE channel = 'purchase') b ON a.run = b.run AND a.day = b.day""")
def align_features_outer(spark, d):
    """Co-iteration of two features over all times that either has."""
    h = view(spark, d, "v_signal").groupBy("channel", "run", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum("intensity").alias("i"))
    side = lambda c: h.filter(F.col("channel") == c).select("run", "day", F.col("i").alias(c))
    j = side("click").join(side("purchase"), ["run", "day"], "full")
    return j.select("run", "day", *[F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in ("click", "purchase")])


@query(f"""WITH t AS (SELECT run, event_id, {HOURS} / 1000 AS t, intensity FROM v_signal), g AS (SELECT run, t - lag(t) OVER w AS dt, abs(intensity - lag(intensity) OVER w) AS di FROM t WINDOW w AS (PARTITION BY run ORDER BY t, event_id))
SELECT run, round(greatest(1 - 2 * sum(dt * di) / sum(di), 1e-4), 5) AS spacing FROM g WHERE dt IS NOT NULL GROUP BY run HAVING sum(di) > 0""")
def spacing_fit(spark, d):
    """One less twice the mean time step, weighted by the change of signal, floored."""
    w = W.partitionBy("run").orderBy("t", "event_id")
    t = points(spark, d).withColumn("t", F.col("t") / 1000)
    g = t.select("run", (F.col("t") - F.lag("t").over(w)).alias("dt"), F.abs(F.col("intensity") - F.lag("intensity").over(w)).alias("di")).dropna()
    return g.groupBy("run").agg(F.sum("di").alias("w"), F.sum(F.col("dt") * F.col("di")).alias("x")).filter("w > 0").select("run", F.round(F.greatest(1 - 2 * F.col("x") / F.col("w"), F.lit(1e-4)), 5).alias("spacing"))


@query("""WITH h AS (SELECT run, date_trunc('day', ts) AS day, sum(intensity) AS i FROM v_signal GROUP BY ALL), m AS (SELECT run, sum(mz * intensity) / sum(intensity) AS centre FROM v_signal GROUP BY run)
SELECT a.run AS run_a, b.run AS run_b, count(*) AS n, round(corr(a.i, b.i), 5) AS r FROM h a JOIN h b ON a.day = b.day AND a.run < b.run JOIN m x ON x.run = a.run JOIN m y ON y.run = b.run AND abs(y.centre - x.centre) <= 2
GROUP BY a.run, b.run HAVING count(*) >= 3 AND var_pop(a.i) > 0 AND var_pop(b.i) > 0""")
def xic_correlation(spark, d):
    """Correlation of the daily chromatograms of runs whose mean m/z lie within 2: sums of blocks of runs, which alone are shuffled."""
    v = view(spark, d, "v_signal")
    m = v.groupBy("run").agg(ratio(F.sum(F.col("mz") * F.col("intensity")), F.sum("intensity")).alias("m")).filter("not isnan(m)")
    h = v.groupBy("run", F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("double").alias("mz")).agg(F.sum("intensity").alias("i"))
    series = spectra_of(h.join(m, "run").withColumnRenamed("run", "scan_id"))
    return correlations(series, 2.0, 3).select(F.col("a").alias("run_a"), F.col("b").alias("run_b"), "n", F.round("r", 5).alias("r"))


@query(f"""{SPLIT} SELECT s.scan_id, count(*) AS n, min(f.id) AS first, max(f.id) AS last FROM f JOIN (SELECT scan_id, {T0} + scan_time AS t FROM v_scan) s ON s.t BETWEEN f.s AND f.e GROUP BY s.scan_id""")
def precursor_stab(spark, d):
    """The features that each scan's time falls into: their number, the first and the last."""
    f = features(spark, d).select("id", "s", "e")
    t = F.lit(473353.0) + F.col("scan_time")
    s = view(spark, d, "v_scan").select("scan_id", t.alias("t"), t.alias("t2"))
    return interval_join(f, s, ("s", "e"), ("t", "t2"), 24.0).groupBy("scan_id").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@query("""SELECT channel, CAST(epoch_us(time_bucket(INTERVAL '6 hours', ts)) // 1000000 AS BIGINT) AS window_start, count(*) AS n, round(sum(intensity), 4) AS intensity FROM v_signal GROUP BY ALL""")
def tumbling_chromatogram(spark, d):
    """Signal by channel and six-hour window; the streaming twin is in massloom.streaming."""
    w = F.window("ts", "6 hours")
    return view(spark, d, "v_signal").groupBy("channel", w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("intensity"), 4).alias("intensity")).select("channel", F.unix_seconds("w.start").alias("window_start"), "n", "intensity")
