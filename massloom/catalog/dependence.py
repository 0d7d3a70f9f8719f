"""Graph deconvolution: fits over peaks, clusters of fits that share peaks, disjoint solutions, precursor processing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from massloom.catalog import query
from massloom.functions.mass import ISOTOPE_GAP, PROTON, neutral_mass
from massloom.operators import dependence as D
from massloom.operators import isotopes
from massloom.operators import solutions as S
from massloom.operators.compositions import composition_members, composition_theory
from massloom.operators.joins import best_match, interval_join, nearest_join, range_join
from massloom.operators.ordered import coalesce_spans, previous_where
from massloom.plans.store import materialize
from massloom.plans.views import view

CHARGES, TOLERANCE = [1, 2, 3], 4e-5

PEAKS = "pk AS MATERIALIZED (SELECT scan_id, mz, intensity, snr, row_number() OVER (PARTITION BY scan_id ORDER BY mz, intensity, ord, part) AS n FROM v_peak)"
FITTED = f"""want AS (SELECT scan_id, n AS mono, mz AS mono_mz, z AS charge, k, mz + k * {ISOTOPE_GAP} / z AS want FROM pk, (SELECT unnest({CHARGES}) AS z), (SELECT unnest(range(0, 4)) AS k)),
hit AS (SELECT w.*, p.n, p.mz, p.intensity, p.snr, row_number() OVER (PARTITION BY w.scan_id, mono, charge, k ORDER BY abs(p.mz - want), p.n) AS r FROM want w JOIN pk p ON p.scan_id = w.scan_id AND abs(p.mz - want) <= want * {TOLERANCE}),
obs AS (SELECT *, sum(intensity) OVER (PARTITION BY scan_id, mono, charge) AS total, count(*) OVER (PARTITION BY scan_id, mono, charge) AS found, (mono_mz * charge - charge * {PROTON}) / 1800.0 AS l FROM hit WHERE r = 1),
th AS (SELECT *, abs(mz - want) AS err, pow(l, k) / CASE k WHEN 3 THEN 6 WHEN 2 THEN 2 ELSE 1 END / (1 + l + pow(l, 2) / 2 + pow(l, 3) / 6) * total AS theory FROM obs WHERE found > 1),
sc AS (SELECT *, CASE WHEN snr < 1 THEN 0 ELSE sqrt(theory) * CASE WHEN err <= 0.02 THEN 1 - err / 0.02 ELSE 0 END * greatest(CASE WHEN intensity < theory THEN 1 - (theory - intensity) / intensity ELSE sqrt(greatest(1 - (intensity - theory) / intensity, 0)) END, 0) END AS term FROM th),
fit AS MATERIALIZED (SELECT * FROM (SELECT scan_id, (scan_id * {D.PEAK_SLOTS} + mono) * {D.CHARGE_SLOTS} + charge AS fit, charge, mono, mono_mz, list_sort(list_distinct(list(n))) AS peaks, min(mz) AS lo, max(mz) AS hi, sum(intensity) AS signal, max(found) AS n_peaks, round(sum(term) + 1e-9, 6) AS score FROM sc GROUP BY scan_id, mono, mono_mz, charge) WHERE score > 0)"""
LINKS = "link AS MATERIALIZED (SELECT scan_id, unnest(peaks) AS peak, fit, charge, score FROM fit)"
SOLVED = f"{FITTED},\n{LINKS}"
FITS = f"{PEAKS}, {SOLVED}"
WITH = f"WITH {FITS}"
CLUSTERED = f"""{SOLVED},
star AS MATERIALIZED (SELECT DISTINCT fit, min(fit) OVER (PARTITION BY scan_id, peak) AS first FROM link),
edge AS MATERIALIZED (SELECT fit AS a, first AS b FROM star WHERE fit <> first UNION SELECT first, fit FROM star WHERE fit <> first),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
cl AS MATERIALIZED (SELECT f.*, coalesce(least(f.fit, m.low), f.fit) AS cluster FROM fit f LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) m ON m.a = f.fit)"""
CLUSTERS = f"WITH RECURSIVE {PEAKS}, {CLUSTERED}"
CHOSEN = f"""{CLUSTERED},
seq AS (SELECT cluster, list({{'used': peaks, 'taken': [fit]}} ORDER BY score DESC, fit) AS l FROM cl GROUP BY cluster),
taken AS MATERIALIZED (SELECT cluster, unnest(list_reduce(l, lambda acc, x: CASE WHEN list_has_any(acc.used, x.used) THEN acc ELSE {{'used': list_concat(acc.used, x.used), 'taken': list_concat(acc.taken, x.taken)}} END).taken) AS fit FROM seq)"""
GREEDY = f"WITH RECURSIVE {PEAKS}, {CHOSEN}"


def fits(spark, d) -> DataFrame:
    p = D.numbered_peaks(view(spark, d, "v_peak").select("scan_id", "mz", "intensity", "snr", "ord", "part"), "ord", "part")
    return D.isotopic_fits(p, CHARGES, TOLERANCE)


@query(f"{WITH} SELECT scan_id, fit, charge, mono, n_peaks, round(lo, 6) AS lo, round(hi, 6) AS hi, score FROM fit")
def isotopic_fits(spark, d):
    """Every fit of two peaks or more: the hyperedges of the dependence graph."""
    return fits(spark, d).select("scan_id", "fit", "charge", "mono", "n_peaks", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "score")


@query(f"{WITH} SELECT scan_id, peak, count(*) AS n_fits, max(score) AS best FROM link GROUP BY scan_id, peak")
def peak_links(spark, d):
    """How many fits depend on each peak, and the best of their scores."""
    return D.links(fits(spark, d)).groupBy("scan_id", "peak").agg(F.count("*").alias("n_fits"), F.max("score").alias("best"))


@query(f"{WITH} SELECT fit, score FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, peaks ORDER BY score DESC, fit) AS r FROM fit) WHERE r = 1")
def best_exact_fits(spark, d):
    """Of fits over the same peaks the best stays."""
    return D.best_exact(fits(spark, d)).select("fit", "score")


@query(f"{WITH} SELECT fit, charge, score FROM fit f WHERE NOT EXISTS (SELECT 1 FROM link l WHERE l.scan_id = f.scan_id AND l.peak = f.mono AND l.charge = f.charge AND l.score > f.score)")
def drop_superceded(spark, d):
    """Drop fits whose lightest peak a better fit of the same charge uses."""
    return D.not_superceded(fits(spark, d)).select("fit", "charge", "score")


@query(f"{WITH} SELECT fit, n_peaks, score FROM fit WHERE NOT 4 - n_peaks > 1")
def drop_gapped_fits(spark, d):
    """Drop fits that miss more than one peak of their pattern."""
    return D.not_gapped(fits(spark, d)).select("fit", "n_peaks", "score")


@query(f"{CLUSTERS} SELECT fit, cluster FROM cl")
def dependence_clusters(spark, d):
    """Fits that depend on each other through shared peaks, directly or not."""
    return D.clusters(fits(spark, d)).select("fit", "cluster")


@query(f"{CLUSTERS} SELECT scan_id, cluster, count(*) AS n_fits, round(min(lo), 6) AS start, round(max(hi), 6) AS end, max(score) AS best_score, arg_max(fit, (score, -fit)) AS best_fit FROM cl GROUP BY scan_id, cluster")
def cluster_spans(spark, d):
    """Each cluster's size, m/z range and best fit: also the one that the top solver takes."""
    best = F.max_by("fit", F.struct("score", -F.col("fit")))
    return D.clusters(fits(spark, d)).groupBy("scan_id", "cluster").agg(F.count("*").alias("n_fits"), F.round(F.min("lo"), 6).alias("start"), F.round(F.max("hi"), 6).alias("end"), F.max("score").alias("best_score"), best.alias("best_fit"))


@query(f"""{CLUSTERS}, s AS (SELECT scan_id, cluster, min(lo) AS lo, max(hi) AS hi FROM cl GROUP BY scan_id, cluster),
g AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY scan_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM s), i AS (SELECT *, sum(new) OVER (PARTITION BY scan_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT scan_id, round(min(lo), 6) AS start, round(max(hi), 6) AS end FROM i GROUP BY scan_id, k""")
def non_overlapping_intervals(spark, d):
    """Clusters whose m/z ranges overlap become one interval."""
    s = D.clusters(fits(spark, d)).groupBy("scan_id", "cluster").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("scan_id", "lo", "hi")
    return coalesce_spans(s, ["scan_id"], "lo", "hi").select("scan_id", F.round("lo", 6).alias("start"), F.round("hi", 6).alias("end"))


@query(f"{GREEDY} SELECT t.cluster, t.fit, f.score FROM taken t JOIN fit f ON f.fit = t.fit")
def disjoint_best_fits(spark, d):
    """The greedy solution of every cluster: fits by falling score, none sharing a peak."""
    return D.greedy_disjoint(fits(spark, d)).select("cluster", "fit", "score")


#: First fit by falling score: a fit's layer is the lowest that no placed fit with a common peak has.
LAYERED = f"""{CLUSTERED},
place AS (SELECT cluster, list({{'peaks': peaks, 'fit': fit, 'layer': 0}} ORDER BY score DESC, fit) AS l FROM cl GROUP BY cluster),
laid AS (SELECT cluster, unnest(list_reduce(list_prepend(l[1:0], list_transform(l, lambda x: [x])), lambda acc, x: list_append(acc, {{'peaks': x[1].peaks, 'fit': x[1].fit,
'layer': list_min(list_filter(range(0, len(acc) + 1), lambda i: NOT list_contains(list_transform(list_filter(acc, lambda p: list_has_any(p.peaks, x[1].peaks)), lambda p: p.layer), i)))}}))) AS p FROM place)"""


@query(f"WITH RECURSIVE {PEAKS}, {LAYERED} SELECT cluster, p.fit AS fit, CAST(p.layer AS INT) AS layer FROM laid")
def layout_layers(spark, d):
    """Fits of a cluster stacked so that none shares a peak with another of its layer, the best lowest."""
    return D.clusters(fits(spark, d)).select("cluster", "fit", "layer")


@query(f"""{WITH}, o AS (SELECT scan_id, list({{'lo': lo, 'hi': hi, 's': CAST(round(score * 1e6) AS BIGINT), 'best': 0::BIGINT, 'path': [fit]}} ORDER BY hi, lo, fit) AS l FROM fit GROUP BY scan_id),
w AS (SELECT scan_id, list_reduce(list_prepend(l[1:0], list_transform(l, lambda x: [x])), lambda acc, x: list_append(acc, {{'lo': x[1].lo, 'hi': x[1].hi, 's': x[1].s,
'best': greatest(coalesce(acc[-1].best, 0), coalesce(list_filter(acc, lambda p: p.hi < x[1].lo)[-1].best, 0) + x[1].s),
'path': CASE WHEN coalesce(list_filter(acc, lambda p: p.hi < x[1].lo)[-1].best, 0) + x[1].s > coalesce(acc[-1].best, 0)
THEN list_concat(coalesce(list_filter(acc, lambda p: p.hi < x[1].lo)[-1].path, []), x[1].path) ELSE acc[-1].path END}})) AS l FROM o)
SELECT scan_id, unnest(l[-1].path) AS fit, l[-1].best / 1e6 AS weight FROM w""")
def heaviest_path(spark, d):
    """The fits of greatest total score whose m/z ranges do not overlap, for each spectrum."""
    return S.heaviest_paths(fits(spark, d))


ROUNDS = 10


def rounds_sql(members: str) -> str:
    """The rounds of the solver with subtraction, one after another, from a SELECT of members."""
    out = [f"r0 AS MATERIALIZED ({members})"]
    for k in range(ROUNDS):
        out.append(f"""a{k} AS (SELECT *, weight * sum(intensity) OVER (PARTITION BY scan_id, fit) AS theory, count(*) OVER (PARTITION BY scan_id, fit) AS found FROM r{k} WHERE intensity > 1),
b{k} AS (SELECT *, round(sum(CASE WHEN snr < 1 THEN 0 ELSE sqrt(theory) * CASE WHEN abs(mz - want) <= 0.02 THEN 1 - abs(mz - want) / 0.02 ELSE 0 END * greatest(CASE WHEN intensity < theory THEN 1 - (theory - intensity) / intensity ELSE sqrt(greatest(1 - (intensity - theory) / intensity, 0)) END, 0) END) OVER (PARTITION BY scan_id, fit) + 1e-9, 5) AS score FROM a{k} WHERE found > 1),
c{k} AS (SELECT *, row_number() OVER (PARTITION BY scan_id, n ORDER BY score DESC, fit) = 1 AS own FROM b{k} WHERE score > 0),
d{k} AS (SELECT *, bool_and(own) OVER (PARTITION BY scan_id, fit) AS takes FROM c{k}),
e{k} AS MATERIALIZED (SELECT *, max(CASE WHEN takes THEN theory END) OVER (PARTITION BY scan_id, n) AS spent FROM d{k}),
r{k + 1} AS MATERIALIZED (SELECT scan_id, fit, n, want, mz, snr, weight, CASE WHEN spent IS NULL THEN intensity WHEN intensity - spent < 0 OR spent > 0.7 * intensity THEN 1.0 ELSE round(intensity - spent, 6) END AS intensity FROM e{k} WHERE NOT takes)""")
    out.append("solved AS (" + " UNION ALL ".join(f"SELECT scan_id, fit, {k} AS round, max(score) AS score, sum(theory) AS signal, count(*) AS n_peaks FROM e{k} WHERE takes GROUP BY scan_id, fit" for k in range(ROUNDS)) + ")")
    return ",\n".join(out)


WEIGHTED = FITTED.replace("AS theory FROM obs", "AS theory, pow(l, k) / CASE k WHEN 3 THEN 6 WHEN 2 THEN 2 ELSE 1 END / (1 + l + pow(l, 2) / 2 + pow(l, 3) / 6) AS weight FROM obs")
MEMBERS = f"SELECT scan_id, (scan_id * {D.PEAK_SLOTS} + mono) * {D.CHARGE_SLOTS} + charge AS fit, n, want, mz, snr, weight, intensity FROM th"


@query(f"""WITH {PEAKS}, {WEIGHTED},
{rounds_sql(MEMBERS)} SELECT scan_id, fit, CAST(round AS INT) AS round, score, round(signal + 1e-7, 2) AS signal, n_peaks FROM solved""")
def solve_subgraphs(spark, d):
    """Every cluster solved with subtraction: the best fits taken, their theory subtracted, the others scored again, in rounds."""
    p = D.numbered_peaks(view(spark, d, "v_peak").select("scan_id", "mz", "intensity", "snr", "ord", "part"), "ord", "part")
    return S.solve_with_subtraction(D.fit_members(p, CHARGES, TOLERANCE), ROUNDS).withColumn("signal", F.round(F.col("signal") + 1e-7, 2))


@query(f"""{WITH}, r AS (SELECT scan_id, peak, fit, charge, score, count(*) OVER (PARTITION BY scan_id, peak) AS n, row_number() OVER (PARTITION BY scan_id, peak ORDER BY score DESC, fit) AS r FROM link) SELECT scan_id, peak, fit, charge, score, r AS place FROM r WHERE r <= greatest(least(n // 2, 100), 10)""")
def explore_local(spark, d):
    """The fits kept of those that use a peak: half of them, ten at least and a hundred at most, the best first."""
    at = D.links(fits(spark, d))
    w = W.partitionBy("scan_id", "peak")
    ranked = at.withColumn("n", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "fit")).cast("long"))
    kept = F.greatest(F.least(F.floor(F.col("n") / 2), F.lit(100)), F.lit(10))
    return ranked.filter(F.col("place") <= kept).select("scan_id", "peak", "fit", "charge", "score", "place")


#: A few sugars; the isotopes of each at each charge.
KNOWN = [(f"hex{h}hexnac{n}", {"C": 6 * h + 8 * n, "H": 10 * h + 13 * n + 2, "N": n, "O": 5 * h + 5 * n + 1}) for h in range(1, 9) for n in range(1, 6)]
THEORY, KNOWN_TOLERANCE = composition_theory(KNOWN, CHARGES), 2e-4
KNOWN_SQL = f"""know AS (SELECT * FROM (VALUES {", ".join(f"({a}, '{b}', {c}, {k}, {x!r}, {p!r})" for a, b, c, k, x, p in THEORY)}) x(number, name, charge, k, want, weight)),
near AS (SELECT scan_id, number, name, charge, want, CAST(weight AS DOUBLE) AS weight, n, mz, intensity, snr, row_number() OVER (PARTITION BY scan_id, number, charge, k ORDER BY abs(mz - want), n) AS r FROM know JOIN pk ON abs(mz - want) <= want * {KNOWN_TOLERANCE}),
comp AS MATERIALIZED (SELECT *, -((scan_id * 100000 + number) * 16 + charge) - 1 AS fit FROM (SELECT *, count(*) OVER (PARTITION BY scan_id, number, charge) AS found FROM near WHERE r = 1) WHERE found > 1)"""
COMPOSED = "SELECT scan_id, fit, n, want, mz, snr, weight, intensity FROM comp"


def composed(p):
    return composition_members(p, THEORY, KNOWN_TOLERANCE)


@query(f"""WITH {PEAKS}, {KNOWN_SQL}, {rounds_sql(COMPOSED)}, nm AS (SELECT DISTINCT fit, name, charge FROM comp) SELECT scan_id, name, charge, CAST(round AS INT) AS round, score, n_peaks FROM solved JOIN nm USING (fit)""")
def composition_graph(spark, d):
    """Known compositions in the dependence graph: their fits compete for peaks, the best are taken and subtracted, in rounds."""
    p = D.numbered_peaks(view(spark, d, "v_peak").select("scan_id", "mz", "intensity", "snr", "ord", "part"), "ord", "part")
    m = composed(p)
    out = S.solve_with_subtraction(m, ROUNDS)
    return out.join(m.select("fit", "name", "charge").distinct(), "fit").select("scan_id", "name", "charge", "round", "score", "n_peaks")


@query(f"""WITH {PEAKS}, {WEIGHTED}, {KNOWN_SQL}, {rounds_sql(f"{MEMBERS} UNION ALL {COMPOSED}")} SELECT scan_id, fit, fit < 0 AS known, CAST(round AS INT) AS round, score, n_peaks FROM solved""")
def hybrid_graph(spark, d):
    """Known compositions and averagine patterns compete for the same peaks in one graph."""
    p = D.numbered_peaks(view(spark, d, "v_peak").select("scan_id", "mz", "intensity", "snr", "ord", "part"), "ord", "part")
    kept = ["scan_id", "fit", "n", "want", "mz", "snr", "weight", "intensity"]
    both = D.fit_members(p, CHARGES, TOLERANCE).select(*kept).unionByName(composed(p).select(*kept))
    return S.solve_with_subtraction(both, ROUNDS).select("scan_id", "fit", (F.col("fit") < 0).alias("known"), "round", "score", "n_peaks")


#: From a pattern's largest peak to its first, in neutrons, by neutral mass.
STEP = 100.0
OFFSETS = isotopes.base_peak_offsets(isotopes.AVERAGINES["peptide"], 2300.0 * max(CHARGES), STEP)


@query(f"""WITH {PEAKS}, o AS (SELECT scan_id, n, mz, unnest({CHARGES}) AS charge FROM pk), w AS (SELECT *, mz * charge - charge * {PROTON} AS mass, {OFFSETS}[CAST(floor((mz * charge - charge * {PROTON}) / {STEP}) AS BIGINT) + 1] AS off FROM o),
h AS (SELECT w.scan_id, w.n, charge, off, p.n AS mono, row_number() OVER (PARTITION BY w.scan_id, w.n, charge ORDER BY abs(p.mz - (w.mz - off * {ISOTOPE_GAP} / charge)), p.n) AS r FROM w JOIN pk p ON p.scan_id = w.scan_id AND abs(p.mz - (w.mz - off * {ISOTOPE_GAP} / charge)) <= (w.mz - off * {ISOTOPE_GAP} / charge) * {TOLERANCE} WHERE off > 0)
SELECT scan_id, n AS base_peak, charge, CAST(off AS INT) AS neutrons, mono FROM h WHERE r = 1""")
def monoisotopic_offset(spark, d):
    """Each peak taken for the largest of a pattern: the peak that would be its first, where the expected number of neutrons below there is one."""
    p = D.numbered_peaks(view(spark, d, "v_peak").select("scan_id", "mz", "intensity", "snr", "ord", "part"), "ord", "part").select("scan_id", "n", "mz")
    q = p.select("scan_id", F.col("n").alias("base_peak"), F.col("mz").alias("base"), F.explode(F.array(*map(F.lit, CHARGES))).alias("charge"))
    mass = neutral_mass(F.col("base"), F.col("charge"))
    q = q.withColumn("neutrons", F.get(F.array(*map(F.lit, OFFSETS)), F.floor(mass / STEP).cast("int"))).filter("neutrons > 0")
    q = q.withColumn("want", F.col("base") - F.col("neutrons") * F.lit(ISOTOPE_GAP) / F.col("charge"))
    hits = range_join(q, p.withColumnRenamed("n", "mono"), "want", "mz", TOLERANCE, ["scan_id"], spread="found")
    return best_match(hits, ["scan_id", "base_peak", "charge"], F.abs(F.col("mz") - F.col("want")), F.col("mono")).select("scan_id", "base_peak", "charge", "neutrons", "mono")


@query(f"{GREEDY} SELECT p.scan_id, p.n AS peak, max(t.fit) AS fit, max(t.fit) IS NOT NULL AS claimed FROM pk p LEFT JOIN link l ON l.scan_id = p.scan_id AND l.peak = p.n LEFT JOIN taken t ON t.fit = l.fit GROUP BY p.scan_id, p.n")
def solution_for_peak(spark, d):
    """The chosen fit that claims each peak, if one does."""
    p = D.numbered_peaks(view(spark, d, "v_peak").select("scan_id", "mz", "intensity", "snr", "ord", "part"), "ord", "part")
    taken = D.links(D.greedy_disjoint(D.isotopic_fits(p, CHARGES, TOLERANCE))).select("scan_id", "peak", "fit")
    return p.select("scan_id", F.col("n").alias("peak")).join(taken, ["scan_id", "peak"], "left").select("scan_id", "peak", "fit", F.col("fit").isNotNull().alias("claimed"))


@query(f"{GREEDY} SELECT f.scan_id, round(mono_mz * charge - charge * {PROTON}, 5) AS neutral_mass, charge, signal AS intensity, n_peaks, score FROM taken t JOIN fit f ON f.fit = t.fit")
def deconvoluted_peaks(spark, d):
    """Deconvoluted peaks of every spectrum: the chosen fits with their neutral masses."""
    f = D.greedy_disjoint(fits(spark, d))
    return f.select("scan_id", F.round(neutral_mass(F.col("mono_mz"), F.col("charge")), 5).alias("neutral_mass"), "charge", F.col("signal").alias("intensity"), "n_peaks", "score")


@query(f"""{CLUSTERS}, m AS (SELECT l.fit, p.mz FROM link l JOIN pk p ON p.scan_id = l.scan_id AND p.n = l.peak), t AS (SELECT DISTINCT target_mass FROM v_target)
SELECT target_mass, c.cluster, count(DISTINCT c.fit) AS n_fits FROM t JOIN m ON abs(m.mz - target_mass) <= target_mass * 1e-5 JOIN cl c ON c.fit = m.fit GROUP BY target_mass, c.cluster""")
def cluster_fits_using_mz(spark, d):
    """The clusters that use a given m/z, with the number of their fits that do."""
    p = D.numbered_peaks(view(spark, d, "v_peak").select("scan_id", "mz", "intensity", "snr", "ord", "part"), "ord", "part")
    used = D.clusters(D.isotopic_fits(p, CHARGES, TOLERANCE)).select("cluster", "fit", F.explode("mzs").alias("mz"))
    t = view(spark, d, "v_target").select("target_mass").distinct()
    return range_join(t, used, "target_mass", "mz", 1e-5).groupBy("target_mass", "cluster").agg(F.countDistinct("fit").alias("n_fits"))


@query(f"""{CLUSTERS} SELECT a.cluster, count(*) AS pairs, sum(CASE WHEN list_has_any(a.peaks, b.peaks) THEN 1 ELSE 0 END)::BIGINT AS share_peaks, sum(CASE WHEN a.lo <= b.hi AND b.lo <= a.hi THEN 1 ELSE 0 END)::BIGINT AS share_span FROM cl a JOIN cl b ON a.cluster = b.cluster AND a.fit < b.fit GROUP BY a.cluster""")
def fit_overlaps(spark, d):
    """Pairs of fits in a cluster: how many share a peak, and how many overlap in m/z."""
    c = materialize(D.clusters(fits(spark, d)).select("scan_id", "cluster", "fit", "peaks", "lo", "hi"), "fits")
    at = c.select("cluster", "scan_id", F.explode("peaks").alias("peak"), "fit")  # few fits use a peak
    share = at.join(at.withColumnRenamed("fit", "other"), ["cluster", "scan_id", "peak"]).filter("fit < other").select("cluster", "fit", "other").distinct().groupBy("cluster").agg(F.count("*").alias("share_peaks"))
    # apart: for each start the ends before it
    ends = c.select("cluster", F.explode(F.array(F.struct(F.col("lo").alias("v"), F.lit(0).alias("is_end")), F.struct(F.col("hi").alias("v"), F.lit(1).alias("is_end")))).alias("e")).select("cluster", "e.*")
    before = F.sum("is_end").over(W.partitionBy("cluster").orderBy("v", "is_end").rowsBetween(W.unboundedPreceding, 0))
    apart = ends.withColumn("before", before).filter("is_end = 0").groupBy("cluster").agg(F.sum("before").alias("apart"), F.count("*").alias("n"))
    pairs = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    return apart.filter("n > 1").join(share, "cluster", "left").select("cluster", pairs.alias("pairs"), F.coalesce("share_peaks", F.lit(0).cast("long")).alias("share_peaks"), (pairs - F.col("apart")).alias("share_span"))


#: Product scans with the survey scan before them, and the survey's peak nearest to the precursor.
TARGETS = """o AS (SELECT *, max(CASE WHEN ms_level = 1 THEN scan_id END) OVER (ORDER BY scan_time, scan_id ROWS UNBOUNDED PRECEDING) AS survey FROM v_peak_scan),
pr AS (SELECT * FROM o WHERE ms_level = 2), nearest AS (SELECT pr.scan_id, pr.survey, precursor_mz, pr.charge AS given, n, mz, intensity, row_number() OVER (PARTITION BY pr.scan_id ORDER BY abs(mz - precursor_mz), n) AS r FROM pr JOIN pk ON pk.scan_id = pr.survey),
target AS MATERIALIZED (SELECT *, abs(mz - precursor_mz) <= precursor_mz * 2e-5 AS exact, abs(mz - precursor_mz) > 1.5 AS rejected FROM nearest WHERE r = 1)"""


def product_scans(spark, d):
    """Product scans with ``survey``, the last MS1 scan before them."""
    s = view(spark, d, "v_peak_scan")
    return previous_where(s, ["scan_time", "scan_id"], F.col("ms_level") == 1, "scan_id", "survey").filter("ms_level = 2")


def precursor_peaks(products, peaks):
    """For each product scan the survey's peak nearest to its precursor: exact within 2e-5, rejected beyond the window's half width of 1.5."""
    first = peaks.groupBy(F.col("scan_id").alias("survey"), "mz").agg(F.min(F.struct("n", "intensity")).alias("p"))  # the first of equal ones
    asked = products.select("scan_id", "survey", "precursor_mz", F.col("charge").alias("given")).dropna(subset=["survey"])
    near = nearest_join(asked, first.select("survey", "mz", "p.n", "p.intensity"), "precursor_mz", "mz", ["survey"], ["n", "intensity"])
    near = near.withColumnRenamed("nearest_mz", "mz").filter("mz is not null")
    off = F.abs(F.col("mz") - F.col("precursor_mz"))
    return near.select("scan_id", "survey", "precursor_mz", "given", "n", "mz", "intensity", (off <= F.col("precursor_mz") * 2e-5).alias("exact"), (off > 1.5).alias("rejected"))


@query(f"{WITH}, {TARGETS} SELECT scan_id, survey, round(precursor_mz, 6) AS precursor_mz, n AS peak, round(mz, 6) AS mz, exact, rejected FROM target")
def process_scan_group(spark, d):
    """The priority targets of each scan group: the survey peak that each product scan was taken from."""
    p = D.numbered_peaks(view(spark, d, "v_peak").select("scan_id", "mz", "intensity", "snr", "ord", "part"), "ord", "part")
    t = precursor_peaks(product_scans(spark, d), p)
    return t.select("scan_id", "survey", F.round("precursor_mz", 6).alias("precursor_mz"), F.col("n").alias("peak"), F.round("mz", 6).alias("mz"), "exact", "rejected")


#: Of the survey's fits that use the target peak the best; then the rules for what a precursor becomes.
PROCESSED = f"""{TARGETS}, cand AS (SELECT t.scan_id, l.fit, row_number() OVER (PARTITION BY t.scan_id ORDER BY l.score DESC, l.fit) AS r FROM target t JOIN link l ON l.scan_id = t.survey AND l.peak = t.n WHERE NOT t.rejected),
sol AS (SELECT t.*, f.fit, f.charge AS solved, f.mono_mz, f.signal FROM target t LEFT JOIN cand c ON c.scan_id = t.scan_id AND c.r = 1 LEFT JOIN fit f ON f.fit = c.fit),
win AS (SELECT t.scan_id, sum(p.intensity) AS total FROM target t JOIN pk p ON p.scan_id = t.survey AND p.mz BETWEEN t.precursor_mz - 1.5 AND t.precursor_mz + 1.5 GROUP BY t.scan_id),
inwin AS (SELECT s.scan_id, sum(p.intensity) AS own FROM sol s JOIN link l ON l.fit = s.fit JOIN pk p ON p.scan_id = l.scan_id AND p.n = l.peak AND p.mz BETWEEN s.precursor_mz - 1.5 AND s.precursor_mz + 1.5 GROUP BY s.scan_id),
done AS (SELECT s.scan_id, s.survey, CASE WHEN fit IS NULL THEN 'orphan' WHEN solved = 1 OR solved <> given THEN 'default' ELSE 'extracted' END AS outcome, s.given, s.solved, s.precursor_mz, s.mono_mz, s.signal, coalesce(own, 0) / total AS purity FROM sol s LEFT JOIN win USING (scan_id) LEFT JOIN inwin USING (scan_id))"""


def processed(spark, d, trust_charge_hint=True):
    """What becomes of each product scan's precursor.

    Without a solution around its peak it keeps its declared values as an
    orphan; a solution of charge 1, or of another charge than a trusted hint,
    leaves the defaults; else mass, charge and signal are taken from the fit.
    The fits of all scans come with it.
    """
    p = D.numbered_peaks(view(spark, d, "v_peak").select("scan_id", "mz", "intensity", "snr", "ord", "part"), "ord", "part")
    f = materialize(D.isotopic_fits(p, CHARGES, TOLERANCE).drop("mzs"), "fits")
    t = precursor_peaks(product_scans(spark, d), p)
    at = D.links(f).select(F.col("scan_id").alias("survey"), F.col("peak").alias("n"), "fit", "score")
    best = t.filter("not rejected").join(at, ["survey", "n"]).groupBy("scan_id").agg(F.max_by("fit", F.struct("score", -F.col("fit"))).alias("fit"))
    chosen = f.select("fit", F.col("charge").alias("solved"), "mono_mz", "signal", "peaks")
    s = t.join(best, "scan_id", "left").join(chosen, "fit", "left")
    window = p.select(F.col("scan_id").alias("survey"), F.col("n").alias("m"), F.col("mz").alias("at"), F.col("intensity").alias("i"))
    spans = s.select("scan_id", "survey", "peaks", (F.col("precursor_mz") - 1.5).alias("from"), (F.col("precursor_mz") + 1.5).alias("to"))
    share = interval_join(spans, window.withColumn("end", F.col("at")), ("from", "to"), ("at", "end"), 3.0, ["survey"])
    share = share.groupBy("scan_id").agg((F.coalesce(F.sum(F.when(F.array_contains("peaks", F.col("m")), F.col("i"))), F.lit(0.0)) / F.sum("i")).alias("purity"))
    unlike = (F.col("solved") == 1) | ((F.col("solved") != F.col("given")) & F.lit(trust_charge_hint))
    outcome = F.when(F.col("fit").isNull(), "orphan").when(unlike, "default").otherwise("extracted")
    return s.join(share, "scan_id", "left").withColumn("outcome", outcome), f


MASS = f"round(CASE WHEN outcome = 'extracted' THEN mono_mz * solved - solved * {PROTON} ELSE precursor_mz * given - given * {PROTON} END, 5)"


@query(f"""{WITH}, {PROCESSED} SELECT scan_id, survey, outcome, {MASS} AS neutral_mass, CASE WHEN outcome = 'extracted' THEN solved ELSE given END AS charge, round(purity, 6) AS purity FROM done""")
def process_scans(spark, d):
    """Scan processing: every precursor located, solved and corrected in its survey scan, with its purity."""
    done, _ = processed(spark, d)
    own = F.col("outcome") == "extracted"
    z, mz = F.when(own, F.col("solved")).otherwise(F.col("given")), F.when(own, F.col("mono_mz")).otherwise(F.col("precursor_mz"))
    return done.select("scan_id", "survey", "outcome", F.round(neutral_mass(mz, z), 5).alias("neutral_mass"), z.alias("charge"), F.round("purity", 6).alias("purity"))


@query(f"""{WITH}, {PROCESSED}, r AS (SELECT f.scan_id, f.fit, f.charge, f.score, row_number() OVER (PARTITION BY f.scan_id, f.mono ORDER BY f.score DESC, f.charge) AS r FROM fit f JOIN v_peak_scan s ON s.scan_id = f.scan_id AND s.ms_level = 2 LEFT JOIN done d ON d.scan_id = f.scan_id WHERE f.charge <= CASE WHEN outcome = 'extracted' THEN solved ELSE s.charge END)
SELECT scan_id, fit, charge, score FROM r WHERE r = 1""")
def deconvolute_product_scan(spark, d):
    """The best fit at each peak of a product scan, with charges up to the precursor's.

    A scan without a survey before it, or whose survey has no peaks, keeps the
    charge that it declares, as an orphan does.
    """
    done, f = processed(spark, d)
    solved = done.filter("outcome = 'extracted'").select("scan_id", "solved")
    scans = view(spark, d, "v_peak_scan").filter("ms_level = 2").join(solved, "scan_id", "left")
    limit = scans.select("scan_id", F.coalesce("solved", "charge").alias("most"))
    rank = F.row_number().over(W.partitionBy("scan_id", "mono").orderBy(F.desc("score"), "charge"))
    return f.join(limit, "scan_id").filter("charge <= most").withColumn("r", rank).filter("r = 1").select("scan_id", "fit", "charge", "score")


@query(f"""{WITH}, t AS (SELECT s.scan_id, s.precursor_mz FROM v_peak_scan s), near AS (SELECT t.scan_id, n, row_number() OVER (PARTITION BY t.scan_id ORDER BY abs(mz - precursor_mz), n) AS r FROM t JOIN pk ON pk.scan_id = t.scan_id),
c AS (SELECT t.scan_id, f.fit, f.charge, f.score, row_number() OVER (PARTITION BY t.scan_id ORDER BY f.score DESC, f.fit) AS r FROM near t JOIN link l ON t.r = 1 AND l.scan_id = t.scan_id AND l.peak = t.n JOIN fit f ON f.fit = l.fit) SELECT scan_id, fit, charge, score FROM c WHERE r = 1""")
def targeted_deconvolution(spark, d):
    """The best fit that uses the peak nearest to a given m/z, for each spectrum that has one."""
    p = D.numbered_peaks(view(spark, d, "v_peak").select("scan_id", "mz", "intensity", "snr", "ord", "part"), "ord", "part")
    f = D.isotopic_fits(p, CHARGES, TOLERANCE)
    t = view(spark, d, "v_peak_scan").select("scan_id", "precursor_mz").join(p.select("scan_id", "mz", "n"), "scan_id")
    near = best_match(t, ["scan_id"], F.abs(F.col("mz") - F.col("precursor_mz")), F.col("n")).select("scan_id", F.col("n").alias("peak"))
    hits = D.links(f).join(near, ["scan_id", "peak"]).groupBy("scan_id").agg(F.max_by(F.struct("fit", "charge", "score"), F.struct("score", -F.col("fit"))).alias("b"))
    return hits.select("scan_id", "b.fit", "b.charge", "b.score")


#: Features of a channel and day as the peaks of one list.
FEATURES = """fe AS (SELECT (date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) * 16 + list_position(['click', 'error', 'purchase', 'signup', 'view'], channel)) AS scan_id, round(mz, 2) AS mz, sum(intensity) * 100 AS intensity, count(*) AS snr FROM v_signal GROUP BY ALL),
pk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY mz, intensity) AS n FROM fe)"""


@query(f"WITH RECURSIVE {FEATURES}, {CHOSEN} SELECT f.scan_id AS list_id, round(mono_mz * charge - charge * {PROTON}, 4) AS neutral_mass, charge, n_peaks, score FROM taken t JOIN fit f ON f.fit = t.fit")
def deconvolute_features(spark, d):
    """Isotopic series among the features of each channel and day: fits over features, clusters of them and a disjoint choice."""
    out = D.greedy_disjoint(feature_fits(spark, d))
    return out.select(F.col("scan_id").alias("list_id"), F.round(neutral_mass(F.col("mono_mz"), F.col("charge")), 4).alias("neutral_mass"), "charge", "n_peaks", "score")


#: Masses for each expected heavy isotope: an averagine rich in carbon and one rich in oxygen.
AVERAGES = {"peptide": 1800.0, "glycan": 2300.0}


def averaged(daltons, name):
    """The SQL of the fits with another averagine, under names of their own."""
    import re

    sql = re.sub(r"\b(want|hit|obs|th|sc|fit)\b(?= AS (MATERIALIZED )?\()", rf"{name}_\1", FITTED.replace("/ 1800.0", f"/ {daltons}"))
    return re.sub(r"\b(FROM|JOIN) (want|hit|obs|th|sc)\b", rf"\1 {name}_\2", sql)


@query(f"""WITH {PEAKS}, {averaged(1800.0, "p")}, {averaged(2300.0, "g")}, b AS (SELECT scan_id, fit, charge, 'peptide' AS averagine, score FROM p_fit UNION ALL SELECT scan_id, fit, charge, 'glycan', score FROM g_fit),
r AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, averagine) AS r FROM b) SELECT scan_id, fit, charge, averagine, score FROM r WHERE r = 1""")
def multi_averagine_fits(spark, d):
    """Every fit with the averagine that suits it best, of several."""
    p = D.numbered_peaks(view(spark, d, "v_peak").select("scan_id", "mz", "intensity", "snr", "ord", "part"), "ord", "part")
    every = None
    for name, daltons in AVERAGES.items():
        f = D.isotopic_fits(p, CHARGES, TOLERANCE, daltons).select("scan_id", "fit", "charge", F.lit(name).alias("averagine"), "score")
        every = f if every is None else every.unionByName(f)
    r = F.row_number().over(W.partitionBy("fit").orderBy(F.desc("score"), "averagine"))
    return every.withColumn("r", r).filter("r = 1").drop("r")


def feature_fits(spark, d):
    """Fits over the features of each channel and day."""
    v = view(spark, d, "v_signal")
    kinds = F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"]))
    number = F.datediff(F.to_date("ts"), F.lit("2020-01-01")).cast("long") * 16 + F.array_position(kinds, F.col("channel"))
    features = v.groupBy(number.alias("scan_id"), F.round("mz", 2).alias("mz")).agg((F.sum("intensity") * 100).alias("intensity"), F.count("*").alias("snr"))
    return D.isotopic_fits(D.numbered_peaks(features), CHARGES, TOLERANCE)


@query(f"WITH {FEATURES}, {SOLVED} SELECT fit, n_peaks, 4 - n_peaks AS null_features, score FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, peaks ORDER BY score DESC, fit) AS r FROM fit) WHERE r = 1")
def feature_best_exact_fits(spark, d):
    """Of fits over the same features the best, with the features that it has and that it misses."""
    return D.best_exact(feature_fits(spark, d)).select("fit", "n_peaks", (F.lit(D.ISOTOPES) - F.col("n_peaks")).alias("null_features"), "score")


@query(f"WITH {FEATURES}, {SOLVED} SELECT fit, charge, score FROM fit f WHERE NOT EXISTS (SELECT 1 FROM link l WHERE l.scan_id = f.scan_id AND l.peak = f.mono AND l.charge = f.charge AND l.score > f.score)")
def feature_drop_superceded(spark, d):
    """Drop fits whose lightest feature a better fit of the same charge uses."""
    return D.not_superceded(feature_fits(spark, d)).select("fit", "charge", "score")


@query(f"""{GREEDY}, m AS (SELECT f.*, mono_mz * charge - charge * {PROTON} AS mass FROM taken t JOIN fit f ON f.fit = t.fit), k AS (SELECT a.fit, count(*) AS n FROM m a JOIN m b ON a.scan_id = b.scan_id AND abs(b.mass - (a.mass + 18.0106)) <= (a.mass + 18.0106) * 2e-4 GROUP BY a.fit)
SELECT m.fit, coalesce(n, 0) AS supporters, round(score * (1 + 0.1 * coalesce(n, 0)) + 1e-9, 5) AS score FROM m LEFT JOIN k ON k.fit = m.fit""")
def mass_shift_support(spark, d):
    """Solutions that a partner of a given mass shift supports score higher."""
    m = materialize(D.greedy_disjoint(fits(spark, d)).select("scan_id", "fit", "score", neutral_mass(F.col("mono_mz"), F.col("charge")).alias("mass")), "solved")
    want = m.select("scan_id", "fit", (F.col("mass") + 18.0106).alias("want"))
    k = range_join(want, m.select("scan_id", "mass"), "want", "mass", 2e-4, ["scan_id"]).groupBy("fit").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return m.join(k, "fit", "left").select("fit", n.alias("supporters"), F.round(F.col("score") * (1 + 0.1 * n) + 1e-9, 5).alias("score"))


#: Isotopes of a declared precursor where its survey scan has them, else signal 1; the window's half width.
HALF = 1.5


@query(f"""WITH {PEAKS}, {TARGETS}, k AS (SELECT pr.scan_id, pr.survey, pr.precursor_mz, pr.charge, i, precursor_mz + i * {ISOTOPE_GAP} / pr.charge AS want FROM pr, (SELECT unnest(range(0, 4)) AS i) WHERE survey IS NOT NULL),
h AS (SELECT k.scan_id, i, p.intensity, row_number() OVER (PARTITION BY k.scan_id, i ORDER BY abs(p.mz - want), p.n) AS r FROM k JOIN pk p ON p.scan_id = k.survey AND abs(p.mz - want) <= want * {TOLERANCE}),
e AS (SELECT k.scan_id, k.survey, precursor_mz, want, coalesce(h.intensity, 1.0) AS intensity, h.intensity IS NOT NULL AS real FROM k LEFT JOIN h ON h.scan_id = k.scan_id AND h.i = k.i AND h.r = 1),
ow AS (SELECT scan_id, any_value(survey) AS survey, any_value(precursor_mz) AS precursor_mz, count(*) FILTER (real) AS n_found, coalesce(sum(intensity) FILTER (want BETWEEN precursor_mz - {HALF} AND precursor_mz + {HALF}), 0) AS own FROM e GROUP BY scan_id),
tt AS (SELECT ow.scan_id, sum(p.intensity) AS total FROM ow JOIN pk p ON p.scan_id = ow.survey AND p.mz BETWEEN precursor_mz - {HALF} AND precursor_mz + {HALF} GROUP BY ow.scan_id)
SELECT ow.scan_id, n_found, round(least(own / total, 1.0), 6) AS purity FROM ow JOIN tt ON tt.scan_id = ow.scan_id""")
def default_envelope_purity(spark, d):
    """Purity of a window by the declared precursor's own pattern: its isotopes as the survey scan has them, signal 1 where it has not."""
    p = D.numbered_peaks(view(spark, d, "v_peak").select("scan_id", "mz", "intensity", "snr", "ord", "part"), "ord", "part").select(F.col("scan_id").alias("survey"), "n", "mz", "intensity")
    t = product_scans(spark, d).dropna(subset=["survey"]).select("scan_id", "survey", "precursor_mz", "charge")
    k = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("want", F.col("precursor_mz") + F.col("i") * F.lit(ISOTOPE_GAP) / F.col("charge"))
    hits = range_join(k.select("scan_id", "survey", "i", "want"), p, "want", "mz", TOLERANCE, ["survey"])
    near = hits.groupBy("scan_id", "i").agg(F.min_by("intensity", F.struct(F.abs(F.col("mz") - F.col("want")), F.col("n"))).alias("found"))
    inside = F.col("want").between(F.col("precursor_mz") - HALF, F.col("precursor_mz") + HALF)
    own = k.join(near, ["scan_id", "i"], "left").groupBy("scan_id").agg(F.count("found").alias("n_found"), F.coalesce(F.sum(F.when(inside, F.coalesce("found", F.lit(1.0)))), F.lit(0.0)).alias("own"))
    spans = t.select("scan_id", "survey", (F.col("precursor_mz") - HALF).alias("from"), (F.col("precursor_mz") + HALF).alias("to"))
    total = interval_join(spans, p.withColumn("end", F.col("mz")), ("from", "to"), ("mz", "end"), 2 * HALF, ["survey"]).groupBy("scan_id").agg(F.sum("intensity").alias("total"))
    return own.join(total, "scan_id").select("scan_id", "n_found", F.round(F.least(F.col("own") / F.col("total"), F.lit(1.0)), 6).alias("purity"))
