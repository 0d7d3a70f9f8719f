"""Scan metadata: windows, activation, ids, lookups, headers, work partitions, targets, offset features."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from massloom.catalog import query
from massloom.functions.mass import PROTON, mass_charge_ratio
from massloom.operators.joins import best_match, range_join
from massloom.operators.ordered import group_scans, next_where, row_numbers, sessionize
from massloom.plans.views import view

ORDER = ["scan_time", "scan_id"]

#: Isolation windows as offsets, an acquisition's scan windows, and the methods that a scan was broken up by.
ACTIVE = """a AS (SELECT scan_id, precursor_mz AS target, CAST(scan_id % 4 AS DOUBLE) / 2 AS lower, CAST(scan_id % 3 AS DOUBLE) / 2 AS upper,
CASE scan_id % 6 WHEN 0 THEN ['CID'] WHEN 1 THEN ['HCD'] WHEN 2 THEN ['ETD', 'HCD'] WHEN 3 THEN ['ETD'] WHEN 4 THEN ['ETD', 'CID'] ELSE ['IRMPD'] END AS methods FROM v_scan WHERE ms_level = 2)"""


def active(spark, d):
    names = {0: ["CID"], 1: ["HCD"], 2: ["ETD", "HCD"], 3: ["ETD"], 4: ["ETD", "CID"], 5: ["IRMPD"]}
    kind = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    s = view(spark, d, "v_scan").filter("ms_level = 2")
    return s.select("scan_id", F.col("precursor_mz").alias("target"), (F.col("scan_id") % 4 / 2.0).alias("lower"), (F.col("scan_id") % 3 / 2.0).alias("upper"), kind[(F.col("scan_id") % 6).cast("int")].alias("methods"))


@query(f"WITH {ACTIVE} SELECT scan_id, lower = 0 AND upper = 0 AS is_empty, round(target - lower, 5) AS low, round(target + upper, 5) AS high, round(lower + upper, 5) AS width, target + 0.4 BETWEEN target - lower AND target + upper AS spans FROM a")
def isolation_window(spark, d):
    """Bounds of isolation windows from their offsets: empty ones, width, and whether a point near the target lies inside."""
    near = F.col("target") + 0.4
    low, high = F.col("target") - F.col("lower"), F.col("target") + F.col("upper")
    return active(spark, d).select("scan_id", ((F.col("lower") == 0) & (F.col("upper") == 0)).alias("is_empty"), F.round(low, 5).alias("low"), F.round(high, 5).alias("high"), F.round(F.col("lower") + F.col("upper"), 5).alias("width"), near.between(low, high).alias("spans"))


@query(f"WITH {ACTIVE} SELECT scan_id, list_contains(methods, 'ETD') AS has_etd, len(methods) > 1 AS is_multiple, list_contains(methods, 'ETD') AND len(methods) > 1 AS has_supplemental, methods[1] AS first FROM a")
def activation(spark, d):
    """What activation is told by its methods: a type, several at once, a supplemental one beside electron transfer."""
    etd, many = F.array_contains("methods", "ETD"), F.size("methods") > 1
    return active(spark, d).select("scan_id", etd.alias("has_etd"), many.alias("is_multiple"), (etd & many).alias("has_supplemental"), F.get("methods", F.lit(0)).alias("first"))


@query(f"WITH {ACTIVE}, w AS (SELECT scan_id, unnest([target - 100, target + 50]) AS lo, unnest([target + 20, target + 300]) AS hi FROM a) SELECT scan_id, round(min(lo), 5) AS low, round(max(hi), 5) AS high, count(*) AS n_windows, bool_or(hi <= lo) AS any_empty FROM w GROUP BY scan_id")
def total_scan_window(spark, d):
    """The range that an acquisition's scan windows cover together."""
    t = F.col("target")
    spans = F.array(F.struct((t - 100).alias("lo"), (t + 20).alias("hi")), F.struct((t + 50).alias("lo"), (t + 300).alias("hi")))
    w = active(spark, d).select("scan_id", F.explode(spans).alias("w")).select("scan_id", "w.lo", "w.hi")
    return w.groupBy("scan_id").agg(F.round(F.min("lo"), 5).alias("low"), F.round(F.max("hi"), 5).alias("high"), F.count("*").alias("n_windows"), F.bool_or(F.col("hi") <= F.col("lo")).alias("any_empty"))


@query("SELECT scan_id, 'controllerType=0 controllerNumber=1 scan=' || scan_id AS native_id FROM v_scan")
def native_id_format(spark, d):
    """Native ids written from their parts."""
    return view(spark, d, "v_scan").select("scan_id", F.format_string("controllerType=%d controllerNumber=%d scan=%d", F.lit(0), F.lit(1), "scan_id").alias("native_id"))


@query("SELECT scan_id, instrument FROM v_scan WHERE instrument IN ('1-URGENT', '2-HIGH')")
def mass_analyzer_filter(spark, d):
    """Scans of given analyzers."""
    return view(spark, d, "v_scan").filter(F.col("instrument").isin("1-URGENT", "2-HIGH")).select("scan_id", "instrument")


@query("SELECT scan_id, CAST(-40 - 10 * (scan_id % 3) AS BIGINT) AS voltage FROM v_scan WHERE -40 - 10 * (scan_id % 3) = -50")
def compensation_voltage_filter(spark, d):
    """Scans of one compensation voltage."""
    v = (F.lit(-40) - 10 * (F.col("scan_id") % 3)).cast("long")
    return view(spark, d, "v_scan").select("scan_id", v.alias("voltage")).filter("voltage = -50")


@query("SELECT count(*) FILTER (ms_level = 2) > 0 AND count(DISTINCT precursor_mz) FILTER (ms_level = 2) > 0.5 * count(*) FILTER (ms_level = 2) AS is_dda FROM v_scan")
def acquisition_is_dda(spark, d):
    """Whether precursors were picked from the data: most product scans have one of their own."""
    two = F.col("ms_level") == 2
    n, k = F.count(F.when(two, 1)), F.countDistinct(F.when(two, F.col("precursor_mz")))
    return view(spark, d, "v_scan").agg(((n > 0) & (k > 0.5 * n)).alias("is_dda"))


@query("SELECT t.target_id, s.scan_id, round(s.scan_time, 4) AS scan_time, s.ms_level FROM v_target t LEFT JOIN v_scan s ON s.scan_id = t.target_id * 4")
def get_scan_by_id(spark, d):
    """Scans looked up by id: a missing one gives nulls. Also an id's time and index record."""
    t = view(spark, d, "v_target").select("target_id", (F.col("target_id") * 4).alias("scan_id"))
    s = view(spark, d, "v_scan").select("scan_id", F.round("scan_time", 4).alias("scan_time"), "ms_level", F.col("scan_id").alias("found"))
    return t.join(s, "scan_id", "left").select("target_id", F.col("found").alias("scan_id"), "scan_time", "ms_level")


@query("WITH o AS (SELECT *, row_number() OVER (ORDER BY scan_time, scan_id) - 1 AS idx FROM v_scan), f AS (SELECT coalesce(max(idx) FILTER (ms_level = 1 AND scan_time <= 60), 0) AS first FROM o) SELECT scan_id, idx, ms_level FROM o, f WHERE idx >= first")
def start_from_scan(spark, d):
    """The scans from the MS1 at or before a time on."""
    o = row_numbers(view(spark, d, "v_scan").select("scan_id", "scan_time", "ms_level"), ORDER, "idx").withColumn("idx", F.col("idx") - 1)
    first = o.agg(F.coalesce(F.max(F.when((F.col("ms_level") == 1) & (F.col("scan_time") <= 60), F.col("idx"))), F.lit(0).cast("long")).alias("first"))
    return o.join(F.broadcast(first), F.col("idx") >= F.col("first")).select("scan_id", "idx", "ms_level")


@query("WITH o AS (SELECT scan_time, lag(scan_time) OVER (ORDER BY scan_id) AS before FROM v_scan) SELECT bool_and(before IS NULL OR before <= scan_time) AS is_sorted, count(*) AS n FROM o")
def is_sorted_by_time(spark, d):
    """Whether scans in index order are in time order."""
    runs = sessionize(view(spark, d, "v_scan").select("scan_id", "scan_time"), [], ["scan_id"], F.col("_prev.scan_time") > F.col("scan_time"), "run")
    return runs.agg((F.max("run") == 0).alias("is_sorted"), F.count("*").alias("n"))


@query("SELECT scan_id, round(precursor_mz, 5) AS precursor_mz, charge, round(tic, 4) AS intensity FROM v_scan WHERE ms_level = 2 AND precursor_mz IS NOT NULL AND charge IS NOT NULL")
def precursor_information(spark, d):
    """All precursors with a known m/z and charge."""
    return view(spark, d, "v_scan").filter("ms_level = 2 and precursor_mz is not null and charge is not null").select("scan_id", F.round("precursor_mz", 5).alias("precursor_mz"), "charge", F.round("tic", 4).alias("intensity"))


@query("SELECT scan_id, round(scan_time, 4) AS scan_time, row_number() OVER (ORDER BY scan_time, scan_id) - 1 AS place FROM v_scan WHERE ms_level = 1")
def ms1_scan_times(spark, d):
    """MS1 times in order."""
    o = row_numbers(view(spark, d, "v_scan").filter("ms_level = 1").select("scan_id", "scan_time"), ORDER, "place")
    return o.select("scan_id", F.round("scan_time", 4).alias("scan_time"), (F.col("place") - 1).alias("place"))


@query("SELECT s.scan_id, s.ms_level, round(s.scan_time, 4) AS scan_time, round(s.precursor_mz, 5) AS precursor_mz, s.charge FROM v_peak_scan s")
def scan_headers(spark, d):
    """Scans without their peaks: the peak table is not read."""
    return view(spark, d, "v_peak_scan").select("scan_id", "ms_level", F.round("scan_time", 4).alias("scan_time"), F.round("precursor_mz", 5).alias("precursor_mz"), "charge")


@query("""WITH g AS (SELECT scan_id, sum(CASE WHEN ms_level = 1 THEN 1 ELSE 0 END) OVER (ORDER BY scan_time, scan_id ROWS UNBOUNDED PRECEDING) AS grp FROM v_scan), n AS (SELECT CAST(max(grp) AS BIGINT) AS top FROM g)
SELECT CAST(grp * 8 // (top + 1) AS BIGINT) AS worker, count(*) AS n_scans, min(scan_id) AS first, max(scan_id) AS last FROM g, n GROUP BY grp * 8 // (top + 1)""")
def partition_work(spark, d):
    """Eight ranges of scans cut at MS1 scans only, so that no group is split."""
    g = group_scans(view(spark, d, "v_scan").select("scan_id", "scan_time", "ms_level"), ORDER)
    top = g.agg(F.max("group_id").alias("top"))
    g = g.join(F.broadcast(top)).withColumn("worker", F.floor(F.col("group_id") * 8 / (F.col("top") + 1)))
    return g.groupBy("worker").agg(F.count("*").alias("n_scans"), F.min("scan_id").alias("first"), F.max("scan_id").alias("last"))


@query("WITH s AS (SELECT coalesce(max(scan_time) FILTER (scan_time <= 40), min(scan_time)) AS lo, coalesce(max(scan_time) FILTER (scan_time <= 70), max(scan_time)) AS hi FROM v_scan WHERE ms_level = 1) SELECT count(*) AS n, min(scan_id) AS first, max(scan_id) AS last FROM v_scan, s WHERE scan_time BETWEEN lo AND hi")
def configure_iterator(spark, d):
    """Start and end times moved to the MS1 scans at or before them."""
    v, t = view(spark, d, "v_scan"), F.col("scan_time")
    s = v.filter("ms_level = 1").agg(F.coalesce(F.max(F.when(t <= 40, t)), F.min(t)).alias("lo"), F.coalesce(F.max(F.when(t <= 70, t)), F.max(t)).alias("hi"))
    return v.join(F.broadcast(s), t.between(F.col("lo"), F.col("hi"))).agg(F.count("*").alias("n"), F.min("scan_id").alias("first"), F.max("scan_id").alias("last"))


@query("WITH o AS (SELECT scan_id, mz - lag(mz) OVER (PARTITION BY scan_id ORDER BY mz) AS gap FROM v_peak) SELECT scan_id, round(median(gap), 6) AS spacing, median(gap) < 0.05 AS is_profile FROM o WHERE gap IS NOT NULL GROUP BY scan_id")
def check_if_profile(spark, d):
    """Whether a spectrum is a profile: points lie close and evenly."""
    gap = F.col("mz") - F.lag("mz").over(W.partitionBy("scan_id").orderBy("mz"))
    o = view(spark, d, "v_peak").select("scan_id", gap.alias("gap")).dropna()
    return o.groupBy("scan_id").agg(F.round(F.median("gap"), 6).alias("spacing"), (F.median("gap") < 0.05).alias("is_profile"))


@query("SELECT scan_id, CASE WHEN ms_level = 1 THEN 0 ELSE scan_id END AS group_id FROM v_scan WHERE ms_level = 2")
def single_product_groups(spark, d):
    """Every product scan as a group of its own."""
    return view(spark, d, "v_scan").filter("ms_level = 2").select("scan_id", F.col("scan_id").alias("group_id"))


@query("""WITH c AS (SELECT s.scan_id, p.mz, row_number() OVER (PARTITION BY s.scan_id ORDER BY p.intensity DESC, p.mz) AS r FROM v_peak_scan s JOIN v_peak p ON p.scan_id = s.scan_id AND p.mz BETWEEN s.precursor_mz - 1 AND s.precursor_mz + 1),
n AS (SELECT s.scan_id, p.mz, row_number() OVER (PARTITION BY s.scan_id ORDER BY abs(p.mz - s.precursor_mz), p.mz) AS r FROM v_peak_scan s JOIN v_peak p ON p.scan_id = s.scan_id AND abs(p.mz - s.precursor_mz) <= s.precursor_mz * 2e-5)
SELECT s.scan_id, round(coalesce(n.mz, c.mz, s.precursor_mz), 6) AS mz, n.mz IS NOT NULL AS exact FROM v_peak_scan s LEFT JOIN n ON n.scan_id = s.scan_id AND n.r = 1 LEFT JOIN c ON c.scan_id = s.scan_id AND c.r = 1""")
def correct_mz(spark, d):
    """A precursor's m/z moved to the peak within tolerance, else to the strongest in its isolation window, else left."""
    s = view(spark, d, "v_peak_scan").select("scan_id", "precursor_mz")
    p = view(spark, d, "v_peak").select("scan_id", "mz", "intensity")
    near = best_match(range_join(s, p, "precursor_mz", "mz", 2e-5, ["scan_id"]), ["scan_id"], F.abs(F.col("mz") - F.col("precursor_mz")), F.col("mz")).select("scan_id", F.col("mz").alias("near"))
    inside = s.join(p, "scan_id").filter(F.col("mz").between(F.col("precursor_mz") - 1, F.col("precursor_mz") + 1))
    strong = inside.groupBy("scan_id").agg(F.max_by("mz", F.struct("intensity", -F.col("mz"))).alias("strong"))
    return s.join(near, "scan_id", "left").join(strong, "scan_id", "left").select("scan_id", F.round(F.coalesce("near", "strong", "precursor_mz"), 6).alias("mz"), F.col("near").isNotNull().alias("exact"))


@query(f"SELECT target_id, z AS charge, round((target_mass + z * {PROTON}) / z, 6) AS mz FROM v_target, (SELECT unnest(range(1, 5)) AS z)")
def target_mz_series(spark, d):
    """A target's m/z at each charge."""
    t = view(spark, d, "v_target").select("target_id", "target_mass", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("z"))
    return t.select("target_id", F.col("z").cast("long").alias("charge"), F.round(mass_charge_ratio(F.col("target_mass"), F.col("z")), 6).alias("mz"))


#: Pairs of peaks a residue apart with their charges and the class of their intensity ratio.
OFFSETS = """o AS MATERIALIZED (SELECT a.charge AS za, b.charge AS zb, CASE WHEN b.intensity >= 2 * a.intensity THEN 'up' WHEN b.intensity * 2 <= a.intensity THEN 'down' ELSE 'even' END AS ratio FROM v_peak a JOIN v_peak b ON a.scan_id = b.scan_id AND abs(b.mz - (a.mz + 57.02146)) <= (a.mz + 57.02146) * 2e-5)"""


def offsets(spark, d):
    p = view(spark, d, "v_peak").select("scan_id", "mz", "charge", "intensity")
    q = p.select("scan_id", (F.col("mz") + 57.02146).alias("want"), F.col("charge").alias("za"), F.col("intensity").alias("ia"))
    pairs = range_join(q, p, "want", "mz", 2e-5, ["scan_id"])
    ratio = F.when(F.col("intensity") >= 2 * F.col("ia"), "up").when(F.col("intensity") * 2 <= F.col("ia"), "down").otherwise("even")
    return pairs.select("za", F.col("charge").alias("zb"), ratio.alias("ratio"))


@query(f"WITH {OFFSETS} SELECT za, zb, count(*) AS n FROM o GROUP BY za, zb")
def offset_charge_relations(spark, d):
    """How often each pair of charges satisfies an offset."""
    return offsets(spark, d).groupBy("za", "zb").agg(F.count("*").alias("n"))


@query(f"WITH {OFFSETS} SELECT ratio, count(*) AS n FROM o GROUP BY ratio")
def offset_intensity_ratio(spark, d):
    """How often each class of intensity ratio satisfies an offset."""
    return offsets(spark, d).groupBy("ratio").agg(F.count("*").alias("n"))


@query(f"WITH {OFFSETS} SELECT za, zb, ratio, count(*) AS n FROM o GROUP BY za, zb, ratio HAVING count(*) >= 10")
def offset_partitions(spark, d):
    """Joint counts by charges and ratio, of ten pairs or more: the specialised features."""
    return offsets(spark, d).groupBy("za", "zb", "ratio").agg(F.count("*").alias("n")).filter("n >= 10")


@query(f"WITH {OFFSETS} SELECT za, zb, ratio, count(*) AS n FROM o GROUP BY CUBE (za, zb, ratio)")
def offset_charge_intensity_cube(spark, d):
    """Counts of offsets over every combination of charges and ratio."""
    return offsets(spark, d).cube("za", "zb", "ratio").agg(F.count("*").alias("n"))


@query("SELECT scan_id, next_id, round(gap, 6) AS gap FROM (SELECT scan_id, scan_time, lead(scan_id) OVER (ORDER BY scan_time, scan_id) AS next_id, lead(scan_time) OVER (ORDER BY scan_time, scan_id) - scan_time AS gap FROM v_scan)")
def collate_scans(spark, d):
    """Scans put in order again, each with the one that follows."""
    v = view(spark, d, "v_scan").select("scan_id", "scan_time", F.struct("scan_id", "scan_time").alias("row"))
    o = next_where(v, ORDER, F.lit(True), "row", "n")
    return o.select("scan_id", F.col("n.scan_id").alias("next_id"), F.round(F.col("n.scan_time") - F.col("scan_time"), 6).alias("gap"))


@query("WITH i AS (SELECT s.scan_id, count(*) FILTER (p.mz BETWEEN s.precursor_mz - 2 AND s.precursor_mz + 3) AS n FROM v_peak_scan s JOIN v_peak p ON p.scan_id = s.scan_id GROUP BY s.scan_id) SELECT scan_id, n > 0 AS has_peak, n FROM i")
def has_peak_near_precursor(spark, d):
    """Whether a spectrum has peaks around its precursor, and how many."""
    s = view(spark, d, "v_peak_scan").select("scan_id", "precursor_mz")
    inside = F.col("mz").between(F.col("precursor_mz") - 2, F.col("precursor_mz") + 3)
    i = s.join(view(spark, d, "v_peak").select("scan_id", "mz"), "scan_id").groupBy("scan_id").agg(F.count(F.when(inside, 1)).alias("n"))
    return i.select("scan_id", (F.col("n") > 0).alias("has_peak"), "n")
