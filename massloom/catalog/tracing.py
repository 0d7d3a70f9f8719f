"""Tracing in drift time, merging by signal, isolation windows demultiplexed, gap-aware smoothing, frames processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from massloom.catalog import query
from massloom.catalog.dependence import CHARGES, CHOSEN, TOLERANCE, WEIGHTED, product_scans
from massloom.catalog.featuremaps import MAP, feature_map, feature_points, near_links
from massloom.functions.mass import PROTON, neutral_mass
from massloom.operators import dependence as D
from massloom.operators import tracing as T
from massloom.operators.graph import connected_components
from massloom.operators.joins import nearest_join
from massloom.operators.ordered import previous_where, sessionize
from massloom.plans.store import materialize
from massloom.plans.views import view


def ions(spark, d):
    """(id, charge, mass, drift, time, intensity): ions of frames in time."""
    v = view(spark, d, "v_ion_point")
    return v.select("id", "charge", neutral_mass(F.col("mz"), F.col("charge")).alias("mass"), "drift", F.col("frame_id").alias("time"), "intensity")


@query()
def trace_mobility_features(spark, d):
    """Features of neutral mass, drift time and time: charge, means, span and number of their ions."""
    p = ions(spark, d)
    f = T.trace_in_drift(p, 2e-5, 0.04)
    mean = lambda c: F.sum(F.col(c) * F.col("intensity")) / F.sum("intensity")
    return f.groupBy("chain", "feature").agg(F.min("id").alias("id"), F.min("charge").alias("charge"), mean("mass").alias("mass"), mean("drift").alias("drift"), F.min("time").alias("start"), F.max("time").alias("end"), F.count("*").alias("n"), F.sum("intensity").alias("intensity")).drop("chain", "feature")


@query()
def merge_features(spark, d):
    """Features of a channel absorbed by stronger ones near in m/z that they overlap in time."""
    f = feature_map(spark, d).select("channel", "id", F.col("mz").alias("value"), F.col("s").alias("start"), F.col("e").alias("end"), "total")
    m = T.merge_by_signal(f, 5e-3, ("channel",)).join(f, "id")
    return m.groupBy(F.col("merged").alias("id")).agg(F.count("*").alias("members"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("total").alias("total"), (F.sum(F.col("value") * F.col("total")) / F.sum("total")).alias("mz"))


#: Isolation windows of 28 m/z, 20 apart, so that neighbours share 8; product peaks with window, survey scan and time.
WINDOWED = """o AS (SELECT *, max(CASE WHEN ms_level = 1 THEN scan_id END) OVER (ORDER BY scan_time, scan_id ROWS UNBOUNDED PRECEDING) AS survey FROM v_peak_scan),
pr AS (SELECT scan_id, scan_time, survey, CAST(floor(precursor_mz / 20) AS BIGINT) AS win, floor(precursor_mz / 20) * 20 - 4 AS lo, floor(precursor_mz / 20) * 20 + 24 AS hi FROM o WHERE ms_level = 2),
pp AS MATERIALIZED (SELECT pr.scan_id, scan_time, survey, win, mz, intensity, ord, part FROM pr JOIN v_peak p ON p.scan_id = pr.scan_id)"""
ATOMS = """bo AS (SELECT DISTINCT unnest([lo, hi]) AS atom_lo FROM pr), nx AS (SELECT atom_lo, lead(atom_lo) OVER (ORDER BY atom_lo) AS atom_hi FROM bo),
atoms AS MATERIALIZED (SELECT atom_lo, atom_hi, list_sort(list_distinct(list(win))) AS windows FROM nx JOIN pr ON lo <= atom_lo AND atom_hi <= hi GROUP BY atom_lo, atom_hi)"""


def windows(spark, d):
    """Product scans with the window they were isolated by."""
    k = F.floor(F.col("precursor_mz") / 20)
    return product_scans(spark, d).select("scan_id", "scan_time", "survey", k.alias("window"), (k * 20.0 - 4).alias("lo"), (k * 20.0 + 24).alias("hi"))


def product_peaks(spark, d):
    p = view(spark, d, "v_peak").select("scan_id", "mz", "intensity", "ord", "part")
    return windows(spark, d).join(p, "scan_id")


@query(f"WITH {WINDOWED}, {ATOMS} SELECT atom_lo, atom_hi, len(windows) AS n_windows, windows[1] AS first, windows[-1] AS last FROM atoms")
def window_atoms(spark, d):
    """The m/z ranges between the bounds of overlapping isolation windows, and the windows that cover each."""
    a = T.window_atoms(windows(spark, d), 28.0)
    return a.select("atom_lo", "atom_hi", F.size("windows").cast("long").alias("n_windows"), F.get("windows", F.lit(0)).alias("first"), F.element_at("windows", -1).alias("last"))


FRAGMENTS = f"""{WINDOWED}, ga AS (SELECT *, CASE WHEN (mz - lag(mz) OVER w) / mz <= 4e-5 THEN 0 ELSE 1 END AS new FROM pp WINDOW w AS (PARTITION BY survey ORDER BY mz, scan_id, ord, part)),
fr AS MATERIALIZED (SELECT survey, win, mz, intensity, sum(new) OVER (PARTITION BY survey ORDER BY mz, scan_id, ord, part ROWS UNBOUNDED PRECEDING) AS fragment FROM ga)"""


@query(f"""WITH {FRAGMENTS}, {ATOMS}, se AS (SELECT survey, fragment, win FROM fr GROUP BY ALL), me AS (SELECT atom_lo, atom_hi, windows, unnest(windows) AS win FROM atoms),
ab AS MATERIALIZED (SELECT survey, fragment, atom_lo, atom_hi, windows FROM se JOIN me USING (win) GROUP BY ALL HAVING count(*) = len(windows)),
ke AS (SELECT * FROM ab a WHERE NOT EXISTS (SELECT 1 FROM ab b WHERE b.survey IS NOT DISTINCT FROM a.survey AND b.fragment = a.fragment AND len(b.windows) > len(a.windows) AND list_has_all(b.windows, a.windows))),
me2 AS (SELECT survey, fragment, round(sum(mz * intensity) / sum(intensity) + 1e-8, 4) AS mz, count(*) AS n FROM fr GROUP BY survey, fragment)
SELECT survey, mz, n, atom_lo, atom_hi FROM ke JOIN me2 USING (survey, fragment)""")
def demultiplex_fragments(spark, d):
    """Fragments of each cycle assigned to the m/z ranges that the windows holding them have in common."""
    p = product_peaks(spark, d).dropna(subset=["survey"])
    gap = ~F.coalesce((F.col("mz") - F.col("_prev.mz")) / F.col("mz") <= 4e-5, F.lit(False))
    f = sessionize(p, ["survey"], ["mz", "scan_id", "ord", "part"], gap, "fragment")
    about = f.groupBy("survey", "fragment").agg(F.round(F.sum(F.col("mz") * F.col("intensity")) / F.sum("intensity") + 1e-8, 4).alias("mz"), F.count("*").alias("n"), F.collect_set("window").alias("held"))
    return T.atoms_of_held(about, T.window_atoms(windows(spark, d), 28.0), ["survey", "fragment"]).select("survey", "mz", "n", "atom_lo", "atom_hi")


@query(f"""WITH {WINDOWED}, ga AS (SELECT *, CASE WHEN (mz - lag(mz) OVER w) / mz <= 4e-5 THEN 0 ELSE 1 END AS new FROM pp WINDOW w AS (PARTITION BY win ORDER BY mz, scan_id, ord, part)),
ch AS (SELECT *, sum(new) OVER (PARTITION BY win ORDER BY mz, scan_id, ord, part ROWS UNBOUNDED PRECEDING) AS chain FROM ga),
gt AS (SELECT *, CASE WHEN scan_time - lag(scan_time) OVER w <= 20 THEN 0 ELSE 1 END AS new2 FROM ch WINDOW w AS (PARTITION BY win, chain ORDER BY scan_time, mz, ord, part)),
fe AS (SELECT *, sum(new2) OVER (PARTITION BY win, chain ORDER BY scan_time, mz, ord, part ROWS UNBOUNDED PRECEDING) AS piece FROM gt)
SELECT win AS window, round(sum(mz * intensity) / sum(intensity) + 1e-8, 4) AS mz, count(*) AS n, min(scan_time) AS start_time, max(scan_time) AS end_time, sum(intensity) AS total FROM fe GROUP BY win, chain, piece HAVING count(*) > 1""")
def window_features(spark, d):
    """Product features of each isolation window: points of near m/z, cut at gaps in time, of two points or more."""
    p = product_peaks(spark, d)
    gap = (F.col("mz") - F.col("_prev.mz")) / F.col("mz") > 4e-5
    c = T.chain_ids(p, ["window"], ["mz", "scan_id", "ord", "part"], gap, "chain")
    f = T.chain_ids(c, ["chain"], ["scan_time", "mz", "ord", "part"], F.col("scan_time") - F.col("_prev.scan_time") > 20, "piece")
    g = f.groupBy("window", "piece").agg(F.round(F.sum(F.col("mz") * F.col("intensity")) / F.sum("intensity") + 1e-8, 4).alias("mz"), F.count("*").alias("n"), F.min("scan_time").alias("start_time"), F.max("scan_time").alias("end_time"), F.sum("intensity").alias("total"))
    return g.filter("n > 1").drop("piece")


def smoothed(edges: str, bridge: float) -> str:
    """SQL: members of each component of the feature graph in time, cut again where the gap is longer than the bridge."""
    return f"""WITH RECURSIVE {MAP}, e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM ft a JOIN ft b ON a.id < b.id AND a.s - {bridge} <= b.e AND b.s <= a.e + {bridge} AND {edges}),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(x, y) AS (SELECT a, b FROM u UNION SELECT r.x, u.b FROM r JOIN u ON r.y = u.a), c AS (SELECT x AS id, least(x, min(y)) AS c FROM r GROUP BY x),
pt AS (SELECT coalesce(c.c, q.id) AS merged, q.id, event_id, t, intensity, mz FROM q LEFT JOIN c ON c.id = q.id), gp AS (SELECT *, CASE WHEN t - lag(t) OVER w <= {bridge} + 24 THEN 0 ELSE 1 END AS new FROM pt WINDOW w AS (PARTITION BY merged ORDER BY t, event_id)),
pc AS (SELECT *, sum(new) OVER (PARTITION BY merged ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS piece FROM gp)
SELECT merged, CAST(piece AS BIGINT) AS piece, count(*) AS n, count(DISTINCT id) AS members, round(min(t), 4) AS start_time, round(max(t), 4) AS end_time, round(sum(intensity), 3) AS total FROM pc GROUP BY merged, piece"""


def smooth(spark, d, edges, bridge):
    """Components of the feature graph, whose edges bridge a gap in time, cut again where their points lie further apart than a feature's and the bridge."""
    c = connected_components(edges.select("a", "b"), "a", "b").select("id", "component")
    p = feature_points(spark, d).join(c, "id", "left").withColumn("merged", F.coalesce("component", "id"))
    cut = T.chain_ids(p.select("merged", "id", "event_id", "t", "intensity"), ["merged"], ["t", "event_id"], F.col("t") - F.col("_prev.t") > bridge + 24, "chain")
    g = cut.groupBy("merged", "chain").agg(F.count("*").alias("n"), F.countDistinct("id").alias("members"), F.round(F.min("t"), 4).alias("start_time"), F.round(F.max("t"), 4).alias("end_time"), F.round(F.sum("intensity"), 3).alias("total"))
    first = g.groupBy("merged").agg(F.min("chain").alias("first"))  # chains are numbered in the order of merged and time, one by one
    return g.join(first, "merged").withColumn("piece", F.col("chain") - F.col("first") + 1).drop("chain", "first")


@query(smoothed("abs(b.mz - a.mz) <= a.mz * 2e-3", 6.0))
def gap_aware_smooth(spark, d):
    """Features near in m/z joined over gaps of up to six hours, cut again where the gap is longer."""
    return smooth(spark, d, near_links(spark, d, "mz", 2e-3, 6.0), 6.0)


@query(smoothed("a.charge = b.charge AND abs(b.mass - a.mass) <= a.mass * 2e-3", 6.0))
def gap_aware_mass_smooth(spark, d):
    """The same for neutral masses of one charge."""
    return smooth(spark, d, near_links(spark, d, "mass", 2e-3, 6.0, ["charge"]), 6.0)


@query(smoothed("a.charge = b.charge AND abs(b.mass - a.mass) <= a.mass * 2e-3 AND abs(a.drift - b.drift) <= 0.5", 6.0))
def gap_aware_mobility_smooth(spark, d):
    """The same with drift times that are near."""
    return smooth(spark, d, near_links(spark, d, "mass", 2e-3, 6.0, ["charge"], ("drift", 0.5)), 6.0)


#: Features of each frame as the peaks of one list: points of near m/z over drift time, two or more.
FRAMES = """fg AS (SELECT *, CASE WHEN (mz - lag(mz) OVER w) / mz <= 2e-5 THEN 0 ELSE 1 END AS new FROM v_ion WINDOW w AS (PARTITION BY frame_id ORDER BY mz, drift, intensity)),
fs AS (SELECT *, sum(new) OVER (PARTITION BY frame_id ORDER BY mz, drift, intensity ROWS UNBOUNDED PRECEDING) AS chain FROM fg),
ff AS MATERIALIZED (SELECT frame_id AS scan_id, round(sum(mz * intensity) / sum(intensity), 6) AS mz, sum(intensity) AS intensity, count(*) AS snr, min(drift) AS d0, max(drift) AS d1 FROM fs GROUP BY frame_id, chain),
pk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY mz, intensity, d0) AS n FROM ff)"""
SOLVED_FRAMES = f"""{FRAMES}, {CHOSEN}, so AS MATERIALIZED (SELECT f.scan_id, f.fit, mono_mz, charge, f.signal, f.n_peaks, score FROM taken t JOIN fit f ON f.fit = t.fit),
sd AS MATERIALIZED (SELECT so.fit, any_value(so.scan_id) AS scan_id, any_value(mono_mz) AS mono_mz, any_value(so.charge) AS charge, any_value(signal) AS signal, any_value(n_peaks) AS n_peaks, any_value(so.score) AS score, min(d0) AS first_drift, max(d1) AS last_drift FROM so JOIN link l ON l.fit = so.fit JOIN pk ON pk.scan_id = l.scan_id AND pk.n = l.peak GROUP BY so.fit)"""


def frame_features(spark, d):
    """(scan_id, mz, intensity, snr, d0, d1, n): the features of each frame, numbered by m/z."""
    gap = ~F.coalesce((F.col("mz") - F.col("_prev.mz")) / F.col("mz") <= 2e-5, F.lit(False))
    c = sessionize(view(spark, d, "v_ion"), ["frame_id"], ["mz", "drift", "intensity"], gap, "chain")
    f = c.groupBy(F.col("frame_id").alias("scan_id"), "chain").agg(F.round(F.sum(F.col("mz") * F.col("intensity")) / F.sum("intensity"), 6).alias("mz"), F.sum("intensity").alias("intensity"), F.count("*").alias("snr"), F.min("drift").alias("d0"), F.max("drift").alias("d1"))
    return D.numbered_peaks(f.drop("chain"), "d0")


def solved_frames(spark, d):
    """Isotopic series among each frame's features, none sharing one, with the drift times that they span."""
    f = frame_features(spark, d)
    taken = materialize(D.greedy_disjoint(D.isotopic_fits(f, CHARGES, TOLERANCE)), "taken")
    span = D.links(taken).select("scan_id", F.col("peak").alias("n"), "fit").join(f.select("scan_id", "n", "d0", "d1"), ["scan_id", "n"]).groupBy("fit").agg(F.min("d0").alias("first_drift"), F.max("d1").alias("last_drift"))
    return taken.join(span, "fit")


@query(f"""WITH {FRAMES}, {WEIGHTED}, m AS (SELECT (th.scan_id * {D.PEAK_SLOTS} + mono) * {D.CHARGE_SLOTS} + charge AS fit, th.scan_id, d0, d1 FROM th JOIN pk ON pk.scan_id = th.scan_id AND pk.n = th.n WHERE weight >= 0.1)
SELECT scan_id AS frame_id, fit, min(d0) AS start_drift, min(d1) AS end_drift FROM m GROUP BY scan_id, fit""")
def fit_bounds(spark, d):
    """Where a fit over features starts and ends: the earliest start and the earliest end of the members that hold a tenth of the pattern."""
    f = frame_features(spark, d)
    m = D.fit_members(f, CHARGES, TOLERANCE).filter("weight >= 0.1").select("scan_id", "fit", "n")
    return m.join(f.select("scan_id", "n", "d0", "d1"), ["scan_id", "n"]).groupBy(F.col("scan_id").alias("frame_id"), "fit").agg(F.min("d0").alias("start_drift"), F.min("d1").alias("end_drift"))


@query(f"WITH RECURSIVE {SOLVED_FRAMES} SELECT scan_id AS frame_id, round(mono_mz * charge - charge * {PROTON}, 4) AS neutral_mass, charge, n_peaks, signal, first_drift, last_drift, score FROM sd")
def deconvolute_frames(spark, d):
    """Deconvoluted features of every frame: mass, charge, signal and span in drift time."""
    s = solved_frames(spark, d)
    return s.select(F.col("scan_id").alias("frame_id"), F.round(neutral_mass(F.col("mono_mz"), F.col("charge")), 4).alias("neutral_mass"), "charge", "n_peaks", "signal", "first_drift", "last_drift", "score")


@query(f"WITH RECURSIVE {SOLVED_FRAMES} SELECT scan_id AS frame_id, CAST(floor(mono_mz * charge - charge * {PROTON}) AS BIGINT) AS mass, charge, count(*) AS n, max(score) AS score, sum(signal) AS signal FROM sd GROUP BY ALL")
def frame_peak_set(spark, d):
    """A frame's deconvoluted features as one list over nominal mass and charge, drift time left out."""
    s = solved_frames(spark, d)
    mass = F.floor(neutral_mass(F.col("mono_mz"), F.col("charge")))
    return s.groupBy(F.col("scan_id").alias("frame_id"), mass.alias("mass"), "charge").agg(F.count("*").alias("n"), F.max("score").alias("score"), F.sum("signal").alias("signal"))


@query(f"""WITH RECURSIVE {SOLVED_FRAMES}, hd AS (SELECT *, max(CASE WHEN ms_level = 1 THEN scan_id END) OVER (ORDER BY scan_time, scan_id ROWS UNBOUNDED PRECEDING) AS survey FROM v_peak_scan),
nr AS (SELECT h.scan_id, h.survey, h.charge AS given, precursor_mz, s.fit, row_number() OVER (PARTITION BY h.scan_id ORDER BY abs(s.mono_mz - precursor_mz), s.mono_mz, s.charge) AS r FROM hd h JOIN sd s ON s.scan_id = h.survey WHERE ms_level = 2)
SELECT nr.scan_id AS frame_id, survey, round(precursor_mz, 6) AS precursor_mz, round(s.mono_mz, 6) AS mz, s.charge, s.charge = given AS as_given, round(s.mono_mz * s.charge - s.charge * {PROTON}, 4) AS neutral_mass, first_drift, last_drift FROM nr JOIN sd s ON s.fit = nr.fit WHERE r = 1""")
def process_frames(spark, d):
    """Frames end to end: features, deconvolution, and for each product frame the survey frame's nearest deconvoluted feature with its drift times."""
    s = solved_frames(spark, d)
    heads = previous_where(view(spark, d, "v_peak_scan"), ["scan_time", "scan_id"], F.col("ms_level") == 1, "scan_id", "survey").filter("ms_level = 2 and survey is not null")
    first = s.groupBy(F.col("scan_id").alias("survey"), "mono_mz").agg(F.min(F.struct("charge", "first_drift", "last_drift")).alias("p"))
    asked = heads.select("scan_id", "survey", F.col("charge").alias("given"), "precursor_mz")
    near = nearest_join(asked, first, "precursor_mz", "mono_mz", ["survey"], ["p"]).filter("p is not null")
    z, mz = F.col("p.charge"), F.col("nearest_mono_mz")
    return near.select(F.col("scan_id").alias("frame_id"), "survey", F.round("precursor_mz", 6).alias("precursor_mz"), F.round(mz, 6).alias("mz"), z.alias("charge"), (z == F.col("given")).alias("as_given"), F.round(neutral_mass(mz, z), 4).alias("neutral_mass"), "p.first_drift", "p.last_drift")
