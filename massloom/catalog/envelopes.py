"""Operations on theoretical patterns and on envelopes of deconvoluted peaks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from massloom.catalog import query
from massloom.catalog.deconvolution import FITS, PATTERN, fits, pattern
from massloom.functions import envelopes as E
from massloom.plans.views import view

P = "p"


def told(df, *keys):
    """One row for each peak of a pattern."""
    return df.select(*keys, F.posexplode("p").alias("k", "x")).select(*keys, F.col("k").cast("long").alias("k"), F.round("x.mz", 6).alias("mz"), F.round("x.intensity", 8).alias("intensity"))


@query(f"{PATTERN} SELECT target_id, k, round(mz + 0.5, 6) AS mz, round(i / sum(i) OVER (PARTITION BY target_id) * 100 + 1e-9, 6) AS intensity FROM p")
def pattern_shift_and_scale(spark, d):
    """Patterns normalised, moved by half a unit and scaled to a hundred."""
    moved = E.scale_raw(E.shift(E.normalize(F.col(P)), F.lit(0.5)), F.lit(100.0))
    rows = pattern(spark, d).select("target_id", F.posexplode(moved).alias("k", "x"))
    return rows.select("target_id", F.col("k").cast("long").alias("k"), F.round("x.mz", 6).alias("mz"), F.round(F.col("x.intensity") + 1e-9, 6).alias("intensity"))


@query(f"{PATTERN}, n AS (SELECT *, i / sum(i) OVER (PARTITION BY target_id) AS f FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY i DESC, k) AS r FROM n) SELECT target_id, max(k) FILTER (r = 1) AS base_peak, round(max(mz) FILTER (r = 1) - min(mz), 6) AS peak_offset, round(sum(f), 6) AS total FROM r GROUP BY target_id")
def pattern_base_peak(spark, d):
    """The largest peak of each pattern and how far it lies above the lightest: the offset from base peak to monoisotopic peak."""
    p = F.col(P)
    return pattern(spark, d).select("target_id", E.base_peak_index(p).cast("long").alias("base_peak"), F.round(E.most_abundant_mz(p) - F.get(p, 0)["mz"], 6).alias("peak_offset"), F.round(E.total(E.normalize(p)), 6).alias("total"))


@query(f"""{PATTERN}, n AS (SELECT *, i / sum(i) OVER (PARTITION BY target_id) AS f FROM p), c AS (SELECT *, sum(f) OVER (PARTITION BY target_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM n)
SELECT target_id, k + 1 AS n_peaks, round(upto, 8) AS held FROM c WHERE k > 0 AND (upto >= 0.8 OR k = 4)""")
def incremental_truncation(spark, d):
    """The prefixes of each pattern that still hold four fifths of it, the whole first."""
    p = pattern(spark, d).select("target_id", E.normalize(F.col(P)).alias("p"))
    upto = lambda n: F.aggregate(F.slice("p", 1, n), F.lit(0.0), lambda s, x: s + x["intensity"])
    t = p.select("target_id", F.explode(F.transform(F.sequence(F.lit(2), F.size("p")), lambda n: F.struct(n.alias("n"), upto(n).alias("held"), (n == F.size("p")).alias("whole")))).alias("t"))
    return t.filter("t.held >= 0.8 or t.whole").select("target_id", F.col("t.n").cast("long").alias("n_peaks"), F.round("t.held", 8).alias("held"))


@query(f"{PATTERN}, n AS (SELECT target_id, k, mz, i / sum(i) OVER (PARTITION BY target_id) AS f FROM p), z AS (SELECT target_id, max(f) FILTER (k = 4) AS tail FROM n GROUP BY target_id) SELECT n.target_id, k, round(mz, 6) AS mz, round(f / (1 - tail), 8) AS intensity FROM n JOIN z ON z.target_id = n.target_id WHERE k < 4")
def pattern_drop_last(spark, d):
    """Patterns without their last peak, the others normalised to what is left."""
    p = E.normalize(F.col(P))
    left = E.normalize(F.slice(p, 1, F.size(p) - 1))
    return told(pattern(spark, d).select("target_id", left.alias("p")), "target_id")


#: Envelopes of a scan and charge: their four strongest peaks by m/z, weak ones as placeholders.
ENVELOPES = f"{FITS}, en AS (SELECT scan_id, charge, k, mz, CASE WHEN obs < 1000 THEN 1.0 ELSE obs END AS i, snr FROM fit)"


def envelopes(spark, d):
    """(scan_id, charge, p): envelopes as arrays; peaks under 1000 are placeholders of intensity 1."""
    weak = F.when(F.col("obs") < 1000, F.lit(1.0)).otherwise(F.col("obs"))
    peak = F.struct("k", "mz", weak.alias("intensity"), "snr")
    return fits(spark, d).groupBy("scan_id", "charge").agg(F.sort_array(F.collect_list(peak)).alias("p"))


@query(f"{ENVELOPES} SELECT scan_id, charge, count(*) FILTER (i <= 1) AS placeholders, count(*) FILTER (i > 1) AS real, round(min(mz) FILTER (i > 1), 6) AS first_mz FROM en GROUP BY scan_id, charge")
def envelope_placeholders(spark, d):
    """Placeholders counted and dropped, and the first real peak."""
    kept = E.drop_placeholders(F.col("p"))
    return envelopes(spark, d).select("scan_id", "charge", (F.size("p") - F.size(kept)).cast("long").alias("placeholders"), F.size(kept).cast("long").alias("real"), F.round(F.get(kept, 0)["mz"], 6).alias("first_mz"))


@query(f"{ENVELOPES} SELECT scan_id, charge, round(sum(snr * i) / sum(i), 6) AS signal_to_noise, round(sum(mz * i) / sum(i), 6) AS centre, round(avg(mz), 6) AS mean_mz, sum(i) AS area FROM en WHERE i > 1 GROUP BY scan_id, charge")
def envelope_averages(spark, d):
    """Weighted signal-to-noise, weighted and plain mean m/z, and total of the real peaks."""
    p = envelopes(spark, d).select("scan_id", "charge", F.explode(E.drop_placeholders(F.col("p"))).alias("x")).select("scan_id", "charge", "x.*")
    weighted = lambda c: F.sum(F.col(c) * F.col("intensity")) / F.sum("intensity")
    return p.groupBy("scan_id", "charge").agg(F.round(weighted("snr"), 6).alias("signal_to_noise"), F.round(weighted("mz"), 6).alias("centre"), F.round(F.avg("mz"), 6).alias("mean_mz"), F.sum("intensity").alias("area"))


@query(f"{ENVELOPES}, m AS (SELECT scan_id, k, sum(i) AS i, sum(mz * i) / sum(i) AS mz, count(*) AS n FROM en GROUP BY scan_id, k) SELECT scan_id, k, n, round(mz, 5) AS mz, round(i / n, 4) AS intensity FROM m")
def average_envelope(spark, d):
    """The mean of a scan's envelopes, position by position: merged, weighted by signal."""
    p = envelopes(spark, d).select("scan_id", F.explode("p").alias("x")).select("scan_id", "x.*")
    g = p.groupBy("scan_id", "k").agg(F.count("*").alias("n"), F.round(F.sum(F.col("mz") * F.col("intensity")) / F.sum("intensity"), 5).alias("mz"), F.sum("intensity").alias("i"))
    return g.select("scan_id", F.col("k").cast("long").alias("k"), "n", "mz", F.round(F.col("i") / F.col("n"), 4).alias("intensity"))


@query(f"{ENVELOPES}, a AS (SELECT scan_id, charge, max(total) AS area, min(mono) AS mono FROM fit GROUP BY scan_id, charge) SELECT scan_id, round(sum(mono * area) / sum(area), 5) AS mz, round(avg(area), 4) AS intensity, count(*) AS n FROM a GROUP BY scan_id")
def average_deconvoluted_peak(spark, d):
    """Deconvoluted peaks of a scan averaged: mean signal, m/z weighted by it."""
    a = fits(spark, d).groupBy("scan_id", "charge").agg(F.max("total").alias("area"), F.min("mono").alias("mono"))
    return a.groupBy("scan_id").agg(F.round(F.sum(F.col("mono") * F.col("area")) / F.sum("area"), 5).alias("mz"), F.round(F.avg("area"), 4).alias("intensity"), F.count("*").alias("n"))


@query(f"{ENVELOPES}, s AS (SELECT en.*, sum(theo) OVER w AS tt, theo FROM en JOIN fit USING (scan_id, charge, k) WINDOW w AS (PARTITION BY en.scan_id, en.charge)) SELECT scan_id, charge, count(*) FILTER (i <= 1 AND theo / tt >= 0.05) AS missing, round(sum(CASE WHEN i <= 1 THEN theo ELSE i END), 4) AS filled FROM s GROUP BY scan_id, charge")
def conform_envelopes(spark, d):
    """Missing peaks filled from theory, and those of them that theory holds above a twentieth."""
    w = W.partitionBy("scan_id", "charge")
    s = fits(spark, d).withColumn("share", F.col("theo") / F.sum("theo").over(w))
    weak = F.col("obs") < 1000
    return s.groupBy("scan_id", "charge").agg(F.count(F.when(weak & (F.col("share") >= 0.05), 1)).alias("missing"), F.round(F.sum(F.when(weak, F.col("theo")).otherwise(F.col("obs"))), 4).alias("filled"))


SCORES = f"""{FITS}, n AS (SELECT *, obs / sum(obs) OVER w AS o, theo / sum(theo) OVER w AS t, min(mz) OVER w AS lo, max(mz) OVER w AS hi, sum(obs) OVER w AS used FROM fit WINDOW w AS (PARTITION BY scan_id, charge)),
sc AS (SELECT scan_id, charge, any_value(lo) AS lo, any_value(hi) AS hi, any_value(used) AS used, 2 * sum(o * ln(o / t)) AS g, sum((obs - theo) * (obs - theo) / theo) / count(*) AS chi FROM n GROUP BY scan_id, charge),
inf AS (SELECT sc.scan_id, sc.charge, 1 - any_value(used) / sum(p.intensity) AS f FROM sc JOIN v_peak p ON p.scan_id = sc.scan_id AND p.mz BETWEEN lo AND hi GROUP BY sc.scan_id, sc.charge)"""


def scores(spark, d):
    """(scan_id, charge, g, chi, f): scaled G-test, chi-square by peak and interference of each fit."""
    w = W.partitionBy("scan_id", "charge")
    n = fits(spark, d).withColumn("o", F.col("obs") / F.sum("obs").over(w)).withColumn("t", F.col("theo") / F.sum("theo").over(w))
    sc = n.groupBy("scan_id", "charge").agg(F.min("mz").alias("lo"), F.max("mz").alias("hi"), F.sum("obs").alias("used"), (2 * F.sum(F.col("o") * F.log(F.col("o") / F.col("t")))).alias("g"), (F.sum(F.pow(F.col("obs") - F.col("theo"), 2) / F.col("theo")) / F.count("*")).alias("chi"))
    p = view(spark, d, "v_peak").select("scan_id", "mz", "intensity")
    f = sc.join(p, "scan_id").filter(F.col("mz").between(F.col("lo"), F.col("hi"))).groupBy("scan_id", "charge").agg((1 - F.max("used") / F.sum("intensity")).alias("f"))
    return sc.join(f, ["scan_id", "charge"]).select("scan_id", "charge", "g", "chi", "f")


@query(f"{SCORES} SELECT sc.scan_id, sc.charge, round(g * abs((f + 0.00001) / (4 * 1.5)) * 100, 5) AS score FROM sc JOIN inf USING (scan_id, charge)")
def distinct_pattern_fit(spark, d):
    """The scaled G-test weighted by interference and by the number of peaks."""
    return scores(spark, d).select("scan_id", "charge", F.round(F.col("g") * F.abs((F.col("f") + 0.00001) / 6) * 100, 5).alias("score"))


@query(f"{SCORES} SELECT scan_id, charge, round(chi, 4) AS score FROM sc")
def chi_square_by_peak(spark, d):
    """Chi-square of a fit over the number of its peaks."""
    return scores(spark, d).select("scan_id", "charge", F.round("chi", 4).alias("score"))


@query(f"{SCORES}, z AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY round(g, 8), charge) AS place FROM sc WHERE g < 0.5) SELECT scan_id, charge, round(g, 6) AS score FROM z WHERE place = 1")
def minimize_fit_selector(spark, d):
    """The fit of the least score in each scan, among those under a limit."""
    r = F.row_number().over(W.partitionBy("scan_id").orderBy(F.round("g", 8), "charge"))
    return scores(spark, d).filter("g < 0.5").withColumn("r", r).filter("r = 1").select("scan_id", "charge", F.round("g", 6).alias("score"))


@query(f"{SCORES} SELECT scan_id, charge FROM sc WHERE g < 0.1")
def bisect_at_score(spark, d):
    """Fits on the good side of a score."""
    return scores(spark, d).filter("g < 0.1").select("scan_id", "charge")


@query("SELECT scan_id, round(quantile_cont(intensity, 0.05), 4) AS p05, round(quantile_cont(intensity, 0.5), 4) AS p50, round(quantile_cont(intensity, 0.95), 4) AS p95 FROM v_peak GROUP BY scan_id")
def percentiles(spark, d):
    """Interpolated percentiles of each spectrum's intensities."""
    at = lambda q: F.round(F.percentile("intensity", F.lit(q)), 4)
    return view(spark, d, "v_peak").groupBy("scan_id").agg(at(0.05).alias("p05"), at(0.5).alias("p50"), at(0.95).alias("p95"))


@query("""WITH q AS (SELECT scan_id, mz, intensity, row_number() OVER (PARTITION BY scan_id ORDER BY mz, intensity, ord, part) AS n, lead(mz) OVER (PARTITION BY scan_id ORDER BY mz, intensity, ord, part) AS up, lag(mz) OVER (PARTITION BY scan_id ORDER BY mz, intensity, ord, part) AS down FROM v_peak)
SELECT scan_id, count(*) FILTER (up - mz <= 1.1) AS has_next, count(*) FILTER (mz - down <= 1.1) AS has_previous FROM q GROUP BY scan_id""")
def putative_neighbours(spark, d):
    """Peaks with a putative isotope within a unit above, and below."""
    w = W.partitionBy("scan_id").orderBy("mz", "intensity", "ord", "part")
    q = view(spark, d, "v_peak").select("scan_id", "mz", F.lead("mz").over(w).alias("up"), F.lag("mz").over(w).alias("down"))
    return q.groupBy("scan_id").agg(F.count(F.when(F.col("up") - F.col("mz") <= 1.1, 1)).alias("has_next"), F.count(F.when(F.col("mz") - F.col("down") <= 1.1, 1)).alias("has_previous"))


@query("SELECT scan_id, polarity, string_agg(CAST(polarity * z AS VARCHAR), ',' ORDER BY z DESC) AS charges FROM v_scan, (SELECT unnest(range(1, 5)) AS z) WHERE z <= charge GROUP BY scan_id, polarity")
def charge_iterator(spark, d):
    """The charges to try for a scan: from its precursor's down to one, signed by polarity."""
    z = F.transform(F.reverse(F.sequence(F.lit(1), F.col("charge"))), lambda x: (F.col("polarity") * x).cast("string"))
    return view(spark, d, "v_scan").select("scan_id", "polarity", F.array_join(z, ",").alias("charges"))
