"""Isotopic patterns, fits and their selection, as expressions and windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from massloom.catalog import query
from massloom.functions import envelopes as E
from massloom.functions import scoring as S
from massloom.functions.mass import ISOTOPE_GAP, PROTON, neutral_mass
from massloom.operators.ordered import sessionize, top_k
from massloom.plans.views import view

# fixed values: atoms of an average amino acid and their monoisotopic masses
PEPTIDE = {"C": 4.9384, "H": 7.7583, "N": 1.3577, "O": 1.4773, "S": 0.0417}
ATOM_MASS = {"C": 12.0, "H": 1.00782503207, "N": 14.0030740048, "O": 15.99491461956, "S": 31.972071}
UNIT = sum(n * ATOM_MASS[a] for a, n in PEPTIDE.items())

#: A fit for each scan and charge: its four strongest peaks in m/z order against a Poisson pattern scaled to their sum.
FITS = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, charge ORDER BY intensity DESC, mz, ord, part) AS r FROM v_peak),
o AS (SELECT scan_id, charge, mz, intensity AS obs, snr, row_number() OVER (PARTITION BY scan_id, charge ORDER BY mz, intensity, ord, part) - 1 AS k, sum(intensity) OVER (PARTITION BY scan_id, charge) AS total, min(mz) OVER (PARTITION BY scan_id, charge) AS mono, count(*) OVER (PARTITION BY scan_id, charge) AS n FROM r WHERE r <= 4),
q AS (SELECT *, (mono * charge - charge * {PROTON}) / 1800 AS l FROM o WHERE n = 4),
w AS (SELECT *, pow(l, k) * exp(-l) / CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 6 END AS p FROM q),
fit AS (SELECT *, p / sum(p) OVER (PARTITION BY scan_id, charge) * total AS theo FROM w)"""


def fits(spark, d):
    w = W.partitionBy("scan_id", "charge")
    o = top_k(view(spark, d, "v_peak"), ["scan_id", "charge"], [F.desc("intensity"), "mz", "ord", "part"], 4)
    o = o.select("scan_id", "charge", "mz", F.col("intensity").alias("obs"), "snr", (F.row_number().over(w.orderBy("mz", "intensity", "ord", "part")) - 1).alias("k"), F.sum("intensity").over(w).alias("total"), F.min("mz").over(w).alias("mono"), F.count("*").over(w).alias("n")).filter("n = 4")
    rate = neutral_mass(F.col("mono"), F.col("charge")) / 1800
    p = o.withColumn("l", rate).withColumn("p", F.pow("l", "k") * F.exp(-F.col("l")) / F.factorial("k"))
    return p.withColumn("theo", F.col("p") / F.sum("p").over(w) * F.col("total"))


def score(name: str, sql: str, spark_score):
    """Register one score of all fits."""

    def f(spark, d):
        return fits(spark, d).groupBy("scan_id", "charge").agg(F.round(spark_score(F.col("obs"), F.col("theo")), 4).alias("score"))

    f.__name__ = name
    return query(f"{FITS} SELECT scan_id, charge, round({sql}, 4) AS score FROM fit GROUP BY scan_id, charge")(f)


g_test = score("g_test", "2 * sum(obs * ln(obs / theo))", S.g_test)
chi_square_fit = score("chi_square_fit", "sum((obs - theo) * (obs - theo) / theo)", S.chi_square)
dot_product_fit = score("dot_product_fit", "sum(obs * theo)", S.dot_product)


@query(f"""{FITS}, n AS (SELECT scan_id, charge, obs / sum(obs) OVER (PARTITION BY scan_id, charge) AS o, theo / sum(theo) OVER (PARTITION BY scan_id, charge) AS t FROM fit)
SELECT scan_id, charge, round(2 * sum(o * ln(o / t)), 6) AS score FROM n GROUP BY scan_id, charge""")
def scaled_g_test(spark, d):
    fit = ["scan_id", "charge"]
    n = fits(spark, d).select(*fit, S.share(F.col("obs"), fit).alias("o"), S.share(F.col("theo"), fit).alias("t"))
    return n.groupBy(*fit).agg(F.round(S.g_test(F.col("o"), F.col("t")), 6).alias("score"))


@query(f"""{FITS}, n AS (SELECT scan_id, charge, obs / max(obs) OVER (PARTITION BY scan_id, charge) AS o, theo / max(theo) OVER (PARTITION BY scan_id, charge) AS t FROM fit)
SELECT scan_id, charge, round(sum((o - t) * (o - t)) / sum(t * t), 6) AS score FROM n GROUP BY scan_id, charge""")
def least_squares_fit(spark, d):
    fit = ["scan_id", "charge"]
    n = fits(spark, d).select(*fit, S.of_largest(F.col("obs"), fit).alias("o"), S.of_largest(F.col("theo"), fit).alias("t"))
    return n.groupBy(*fit).agg(F.round(S.least_squares(F.col("o"), F.col("t")), 6).alias("score"))


MSD = """sum(CASE WHEN snr < 1 THEN 0 ELSE sqrt(theo) * CASE WHEN abs(mz - (mono + k * 1.0033548378 / charge)) <= 20 THEN 1 - abs(mz - (mono + k * 1.0033548378 / charge)) / 20 ELSE 0 END
 * greatest(CASE WHEN obs < theo THEN 1 - (theo - obs) / obs ELSE sqrt(greatest(1 - (obs - theo) / obs, 0)) END, 0) END)"""


def msdeconv_of(f):
    want = F.col("mono") + F.col("k") * F.lit(ISOTOPE_GAP) / F.col("charge")
    return f.groupBy("scan_id", "charge").agg(S.msdeconv(F.col("mz"), F.col("obs"), F.col("snr"), want, F.col("theo"), tolerance=20.0).alias("m"))


@query(f"{FITS} SELECT scan_id, charge, round({MSD}, 4) AS score FROM fit GROUP BY scan_id, charge")
def msdeconv_score(spark, d):
    return msdeconv_of(fits(spark, d)).select("scan_id", "charge", F.round("m", 4).alias("score"))


@query(f"""{FITS}, n AS (SELECT *, obs / sum(obs) OVER (PARTITION BY scan_id, charge) AS o, theo / sum(theo) OVER (PARTITION BY scan_id, charge) AS t FROM fit)
SELECT scan_id, charge, round({MSD} * (1 - abs(2 * sum(o * ln(o / t)))), 4) + 0 AS score FROM n GROUP BY scan_id, charge""")
def penalized_msdeconv(spark, d):
    fit = ["scan_id", "charge"]
    f = fits(spark, d)
    g = f.select(*fit, S.share(F.col("obs"), fit).alias("o"), S.share(F.col("theo"), fit).alias("t")).groupBy(*fit).agg(S.g_test(F.col("o"), F.col("t")).alias("g"))
    return msdeconv_of(f).join(g, fit).select(*fit, (F.round(S.penalized(F.col("m"), F.col("g")), 4) + F.lit(0.0)).alias("score"))


@query(f"""{FITS}, s AS (SELECT scan_id, charge, {MSD} AS m FROM fit GROUP BY scan_id, charge), b AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY round(m, 6) DESC, charge DESC) AS r FROM s)
SELECT scan_id, charge, round(m, 4) AS score FROM b WHERE r = 1""")
def best_fit_per_peak(spark, d):
    """The charge state of the best score; ties go to the larger charge."""
    return top_k(msdeconv_of(fits(spark, d)), ["scan_id"], [F.round("m", 6).desc(), F.desc("charge")], 1).select("scan_id", "charge", F.round("m", 4).alias("score"))


@query(f"""WITH t AS (SELECT target_id, target_mass, z, target_mass * z / {UNIT} AS f FROM v_target, (SELECT unnest(range(1, 5)) AS z))
SELECT target_id, z AS charge, {", ".join(f"round_even({n} * f, 0) AS {a}" for a, n in PEPTIDE.items() if a != "H")} FROM t""")
def averagine_scale(spark, d):
    """Whole atom counts of the average composition at each m/z and charge, rounded half to even."""
    t = view(spark, d, "v_target").select("target_id", "target_mass", F.explode(F.expr("sequence(1L, 4L)")).alias("charge"))
    f = F.col("target_mass") * F.col("charge") / F.lit(UNIT)
    return t.select("target_id", "charge", *[F.bround(F.lit(n) * f, 0).alias(a) for a, n in PEPTIDE.items() if a != "H"])


PATTERN = """WITH t AS (SELECT target_id, target_mass AS m, target_mass / 1800 AS l FROM v_target),
p AS (SELECT target_id, k, m + k * 1.0033548378 AS mz, pow(l, k) * exp(-l) / CASE WHEN k < 2 THEN 1 WHEN k = 2 THEN 2 WHEN k = 3 THEN 6 ELSE 24 END AS i FROM t, (SELECT unnest(range(0, 5)) AS k))"""


def pattern(spark, d):
    t = view(spark, d, "v_target")
    return t.select("target_id", E.poisson_pattern(F.col("target_mass"), 5).alias("p"))


def rows_of(df):
    return df.select("target_id", F.posexplode("p").alias("k", "x")).select("target_id", F.col("k").cast("long").alias("k"), F.round("x.mz", 6).alias("mz"), F.round("x.intensity", 8).alias("intensity"))


@query(f"{PATTERN} SELECT target_id, k, round(mz, 6) AS mz, round(i, 8) AS intensity FROM p")
def poisson_approximate(spark, d):
    return rows_of(pattern(spark, d))


@query(f"""{PATTERN}, c AS (SELECT *, coalesce(sum(i) OVER (PARTITION BY target_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p), u AS (SELECT * FROM c WHERE before < 0.95)
SELECT target_id, k, round(mz, 6) AS mz, round(i / sum(i) OVER (PARTITION BY target_id), 8) AS intensity FROM u""")
def truncate_after(spark, d):
    return rows_of(pattern(spark, d).select("target_id", E.truncate_after(F.col("p"), 0.95).alias("p")))


@query(f"""{PATTERN}, u AS (SELECT * FROM p WHERE k < 2 OR i >= 0.05) SELECT target_id, row_number() OVER (PARTITION BY target_id ORDER BY k) - 1 AS k, round(mz, 6) AS mz, round(i / sum(i) OVER (PARTITION BY target_id), 8) AS intensity FROM u""")
def ignore_below(spark, d):
    return rows_of(pattern(spark, d).select("target_id", E.ignore_below(F.col("p"), 0.05).alias("p")))


@query(f"""{PATTERN} SELECT target_id, round(max(i) FILTER (k = 0) / max(i) FILTER (k = 2), 6) AS a_to_a2, round(sum(mz * i) / sum(i), 6) AS average_mz, round(arg_max(mz, i), 6) AS most_abundant_mz, round(sum(i), 8) AS total FROM p GROUP BY target_id""")
def envelope_statistics(spark, d):
    p = F.col("p")
    return pattern(spark, d).select("target_id", F.round(E.a_to_a2_ratio(p), 6).alias("a_to_a2"), F.round(E.average_mz(p), 6).alias("average_mz"), F.round(E.most_abundant_mz(p), 6).alias("most_abundant_mz"), F.round(E.total(p), 8).alias("total"))


@query(f"""WITH m AS (SELECT scan_id, charge, mz * charge - charge * {PROTON} AS mass, intensity FROM v_peak), g AS (SELECT *, CASE WHEN mass - lag(mass) OVER (PARTITION BY scan_id, charge ORDER BY mass, intensity) < 0.5 THEN 0 ELSE 1 END AS new FROM m),
s AS (SELECT *, sum(new) OVER (PARTITION BY scan_id, charge ORDER BY mass, intensity ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT scan_id, charge, round(min(mass), 5) AS mass, sum(intensity) AS intensity FROM s GROUP BY scan_id, charge, s""")
def merge_isobaric(spark, d):
    """Neighbours of one charge closer than a gap become one peak: the first mass, the summed intensity."""
    m = view(spark, d, "v_peak").select("scan_id", "charge", neutral_mass(F.col("mz"), F.col("charge")).alias("mass"), "intensity")
    s = sessionize(m, ["scan_id", "charge"], ["mass", "intensity"], F.col("mass") - F.col("_prev.mass") >= 0.5)
    return s.groupBy("scan_id", "charge", "session").agg(F.round(F.min("mass"), 5).alias("mass"), F.sum("intensity").alias("intensity")).drop("session")


@query("""WITH b AS (SELECT *, max(intensity) OVER (PARTITION BY scan_id) AS base FROM v_peak), r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY intensity DESC, mz, ord, part) AS r FROM b WHERE intensity >= 0.05 * base AND mz <= 850)
SELECT scan_id, round(mz, 6) AS mz, intensity FROM r WHERE r <= 50""")
def topn_retention(spark, d):
    p = view(spark, d, "v_peak").withColumn("base", F.max("intensity").over(W.partitionBy("scan_id"))).filter((F.col("intensity") >= 0.05 * F.col("base")) & (F.col("mz") <= 850))
    return top_k(p, ["scan_id"], [F.desc("intensity"), "mz", "ord", "part"], 50).select("scan_id", F.round("mz", 6).alias("mz"), "intensity")


@query("""WITH b AS (SELECT *, max(intensity) OVER (PARTITION BY scan_id, floor(mz / 5)) AS base FROM v_peak) SELECT scan_id, round(mz, 6) AS mz, intensity FROM b WHERE intensity > base / 3""")
def simplify_peaks(spark, d):
    p = view(spark, d, "v_peak").withColumn("base", F.max("intensity").over(W.partitionBy("scan_id", F.floor(F.col("mz") / 5))))
    return p.filter(F.col("intensity") > F.col("base") / 3).select("scan_id", F.round("mz", 6).alias("mz"), "intensity")


@query(f"""{FITS}, s AS (SELECT scan_id, charge, min(mz) AS lo, max(mz) AS hi, sum(obs) AS used FROM fit GROUP BY scan_id, charge)
SELECT s.scan_id, s.charge, round(1 - max(used) / sum(intensity), 6) AS interference FROM s JOIN v_peak p ON s.scan_id = p.scan_id AND p.mz BETWEEN lo AND hi GROUP BY s.scan_id, s.charge""")
def interference(spark, d):
    """The share of a fit's region that the fit does not explain."""
    s = fits(spark, d).groupBy("scan_id", "charge").agg(F.min("mz").alias("lo"), F.max("mz").alias("hi"), F.sum("obs").alias("used"))
    p = view(spark, d, "v_peak").select("scan_id", "mz", "intensity")
    both = s.join(p, "scan_id").filter(F.col("mz").between(F.col("lo"), F.col("hi")))
    return both.groupBy("scan_id", "charge").agg(F.round(1 - F.max("used") / F.sum("intensity"), 6).alias("interference"))


@query("""WITH a AS (SELECT scan_id, mz, intensity, row_number() OVER (PARTITION BY scan_id ORDER BY mz, intensity, ord, part) AS n FROM v_peak),
p AS (SELECT a.scan_id, a.n, floor(1 / (b.mz - a.mz)) AS whole, 1 / (b.mz - a.mz) AS f FROM a JOIN a b ON a.scan_id = b.scan_id AND b.mz > a.mz AND b.mz - a.mz <= 1.1 AND b.intensity >= a.intensity / 4),
c AS (SELECT DISTINCT scan_id, n, CAST(floor(f + 0.5) AS BIGINT) AS charge FROM p WHERE NOT (f - whole > 0.2 AND f - whole < 0.8)) SELECT scan_id, charge, count(*) AS n_peaks FROM c WHERE charge BETWEEN 1 AND 8 GROUP BY scan_id, charge""")
def quick_charge(spark, d):
    """Plausible charges of each peak from the spacing of its right neighbours within 1.1 m/z, counted by scan."""
    a = view(spark, d, "v_peak").select("scan_id", "mz", "intensity", F.row_number().over(W.partitionBy("scan_id").orderBy("mz", "intensity", "ord", "part")).alias("n"))
    cell = F.floor(F.col("mz") / 1.1)
    left = a.withColumn("cell", F.explode(F.array(cell, cell + 1)))
    right = a.select("scan_id", F.col("mz").alias("mz_b"), F.col("intensity").alias("i_b"), cell.alias("cell"))
    gap = F.col("mz_b") - F.col("mz")
    p = left.join(right, ["scan_id", "cell"]).filter((gap > 0) & (gap <= 1.1) & (F.col("i_b") >= F.col("intensity") / 4)).select("scan_id", "n", F.try_divide(F.lit(1.0), gap).alias("f"))
    part = F.col("f") - F.floor("f")
    c = p.filter(~((part > 0.2) & (part < 0.8))).select("scan_id", "n", F.floor(F.col("f") + 0.5).alias("charge")).distinct()
    return c.filter("charge between 1 and 8").groupBy("scan_id", "charge").agg(F.count("*").alias("n_peaks"))
