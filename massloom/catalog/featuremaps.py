"""Feature maps: search, slicing, merging, graphs of features, relationships, precursor-product correlation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from massloom.catalog import query
from massloom.catalog.features import HOURS, points
from massloom.functions.mass import PROTON, neutral_mass, ratio
from massloom.functions.scoring import correlation
from massloom.operators.graph import linked_components, linking_edges
from massloom.operators.joins import interval_join, interval_join_2d, range_join
from massloom.operators.ordered import resample, sessionize
from massloom.plans.views import view

#: Points with the feature they belong to, and the features with mean m/z, mass, charge and drift time.
MAP = f"""t AS (SELECT run, channel, event_id, {HOURS} AS t, intensity, mz FROM v_signal), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY run, channel ORDER BY t, event_id) > 24 THEN 1 ELSE 0 END AS new FROM t),
s AS (SELECT *, sum(new) OVER (PARTITION BY run, channel ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS part FROM g),
q AS MATERIALIZED (SELECT * FROM (SELECT run, channel, event_id, t, intensity, mz, min(event_id) OVER w AS id, count(*) OVER w AS np FROM s WINDOW w AS (PARTITION BY run, channel, part)) WHERE np >= 2),
m AS (SELECT id, any_value(run) AS run, any_value(channel) AS channel, min(t) AS s, max(t) AS e, sum(mz * intensity) / sum(intensity) AS mz, sum(intensity) AS total, count(*) AS n, 1 + id % 3 AS charge, (id % 50) / CAST(10 AS DOUBLE) AS drift FROM q GROUP BY id),
ft AS MATERIALIZED (SELECT *, mz * charge - charge * {PROTON} AS mass FROM m)"""
WITH = f"WITH {MAP}"
NOW = 473353 + 220.0


def feature_points(spark, d):
    """(id, run, channel, event_id, t, intensity, mz): points of features of two points or more."""
    s = sessionize(points(spark, d), ["run", "channel"], ["t", "event_id"], F.col("t") - F.col("_prev.t") > 24, "part")
    w = W.partitionBy("run", "channel", "part")
    return s.withColumn("id", F.min("event_id").over(w)).withColumn("np", F.count("*").over(w)).filter("np >= 2").drop("np", "part")


def feature_map(spark, d):
    """(id, run, channel, s, e, mz, total, n, charge, drift, mass): one row for each feature."""
    m = feature_points(spark, d).groupBy("id").agg(F.min("run").alias("run"), F.min("channel").alias("channel"), F.min("t").alias("s"), F.max("t").alias("e"), ratio(F.sum(F.col("mz") * F.col("intensity")), F.sum("intensity")).alias("mz"), F.sum("intensity").alias("total"), F.count("*").alias("n"))
    m = m.withColumn("charge", 1 + F.col("id") % 3).withColumn("drift", F.col("id") % 50 / 10.0)
    return m.withColumn("mass", neutral_mass(F.col("mz"), F.col("charge")))


def wanted(spark, d):
    return view(spark, d, "v_target").select("target_id", (F.lit(100.0) + F.col("size") * 0.5).alias("want"))


WANT = "w AS (SELECT target_id, 100.0 + size * CAST(0.5 AS DOUBLE) AS want FROM v_target)"


def searched(name, value, text):
    """Register search and find_all of a value of features."""

    def hits(spark, d):
        return range_join(wanted(spark, d), feature_map(spark, d), "want", value, 1e-3)

    def search(spark, d):
        t = wanted(spark, d)
        hits = range_join(t.select("want").distinct(), feature_map(spark, d).select("id", "total", value), "want", value, 1e-3)
        first = F.struct(F.abs(F.col(value) - F.col("want")).alias("off"), (-F.col("total")).alias("weak"), "id", value)
        best = hits.groupBy("want").agg(F.min(first).alias("b"))  # targets share their values, and a minimum is kept as pairs are made
        each = t.join(best, "want").groupBy("target_id").agg(F.min("b").alias("b"))
        return each.select("target_id", "b.id", F.round(f"b.{value}", 5).alias("found"))

    def find_all(spark, d):
        return hits(spark, d).groupBy("target_id").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.round(F.sum("total"), 4).alias("total"))

    pairs = f"{WITH}, {WANT}, h AS (SELECT * FROM w JOIN ft ON abs({value} - want) <= want * 1e-3)"
    search.__name__, search.__doc__ = f"{name}_search", f"The feature of the nearest {text} within tolerance, the strongest on ties."
    find_all.__name__, find_all.__doc__ = f"{name}_find_all", f"All features of a {text} within tolerance: number, first, summed signal."
    query(f"{pairs}, r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY abs({value} - want), total DESC, id) AS r FROM h) SELECT target_id, id, round({value}, 5) AS found FROM r WHERE r = 1")(search)
    query(f"{pairs} SELECT target_id, count(*) AS n, min(id) AS first, round(sum(total), 4) AS total FROM h GROUP BY target_id")(find_all)


searched("feature_map", "mz", "m/z")
searched("mass_feature_map", "mass", "neutral mass")


@query(f"{WITH} SELECT id, round(mz, 5) AS mz FROM ft WHERE mz BETWEEN 120 AND 160")
def feature_map_between(spark, d):
    """Features of an m/z range."""
    return feature_map(spark, d).filter(F.col("mz").between(120, 160)).select("id", F.round("mz", 5).alias("mz"))


@query(f"{WITH} SELECT id, charge, round(mass, 5) AS mass FROM ft WHERE mass BETWEEN 200 AND 400")
def mass_feature_map_between(spark, d):
    """Features of a range of neutral masses."""
    return feature_map(spark, d).filter(F.col("mass").between(200, 400)).select("id", "charge", F.round("mass", 5).alias("mass"))


@query(f"{WITH} SELECT id, round(mz, 5) AS mz, charge, round(mass, 5) AS mass, round(s, 4) AS start_time, round(e, 4) AS end_time, n, round(total, 4) AS total FROM ft")
def feature_map_arrays(spark, d):
    """The map's columns: what its arrays hold, by feature."""
    return feature_map(spark, d).select("id", F.round("mz", 5).alias("mz"), "charge", F.round("mass", 5).alias("mass"), F.round("s", 4).alias("start_time"), F.round("e", 4).alias("end_time"), "n", F.round("total", 4).alias("total"))


NODE = "CAST(floor(t / 6) AS BIGINT)"


def nodes(spark, d):
    """Six-hour nodes of each feature."""
    return feature_points(spark, d).withColumn("node", F.floor(F.col("t") / 6))


@query(f"{WITH} SELECT id, {NODE} AS node, count(*) AS n, max(intensity) AS max_intensity, round(sum(intensity), 4) AS total_intensity FROM q GROUP BY id, {NODE}")
def feature_nodes(spark, d):
    """A feature's nodes in time with the number, the largest and the sum of their members: its arrays."""
    return nodes(spark, d).groupBy("id", "node").agg(F.count("*").alias("n"), F.max("intensity").alias("max_intensity"), F.round(F.sum("intensity"), 4).alias("total_intensity"))


@query(f"{WITH} SELECT id, count(*) FILTER (t < {NOW}) AS before, count(*) FILTER (t >= {NOW}) AS after, round(coalesce(sum(intensity) FILTER (t < {NOW}), 0), 4) AS signal_before, round(coalesce(sum(intensity) FILTER (t >= {NOW}), 0), 4) AS signal_after FROM q GROUP BY id HAVING min(t) < {NOW} AND max(t) >= {NOW}")
def feature_split_at(spark, d):
    """Features that a time cuts in two, with the points and signal of both parts."""
    early = F.col("t") < NOW
    g = feature_points(spark, d).groupBy("id").agg(F.count(F.when(early, 1)).alias("before"), F.count(F.when(~early, 1)).alias("after"), *[F.round(F.coalesce(F.sum(F.when(c, F.col("intensity"))), F.lit(0.0)), 4).alias(n) for n, c in (("signal_before", early), ("signal_after", ~early))])
    return g.filter("before > 0 and after > 0")


@query(f"{WITH} SELECT id, count(*) AS n, round(min(t), 4) AS start_time, round(sum(intensity), 4) AS total FROM q WHERE t >= {NOW} GROUP BY id")
def feature_truncate_before(spark, d):
    """What is left of each feature from a time on."""
    return feature_points(spark, d).filter(F.col("t") >= NOW).groupBy("id").agg(F.count("*").alias("n"), F.round(F.min("t"), 4).alias("start_time"), F.round(F.sum("intensity"), 4).alias("total"))


@query(f"{WITH} SELECT id, count(*) AS n, round(max(t), 4) AS end_time, round(sum(intensity), 4) AS total FROM q WHERE t < {NOW} GROUP BY id")
def feature_truncate_after(spark, d):
    """What is left of each feature before a time."""
    return feature_points(spark, d).filter(F.col("t") < NOW).groupBy("id").agg(F.count("*").alias("n"), F.round(F.max("t"), 4).alias("end_time"), F.round(F.sum("intensity"), 4).alias("total"))


@query(f"{WITH} SELECT id, arg_min(event_id, (abs(t - {NOW}), event_id)) AS event_id, round(min(abs(t - {NOW})), 4) AS distance FROM q GROUP BY id")
def feature_find_time(spark, d):
    """The point of each feature nearest to a time."""
    off = F.abs(F.col("t") - NOW)
    return feature_points(spark, d).groupBy("id").agg(F.min_by("event_id", F.struct(off, F.col("event_id"))).alias("event_id"), F.round(F.min(off), 4).alias("distance"))


EDGES = f"""{MAP}, e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM ft a JOIN ft b ON a.id < b.id AND a.s - 2 <= b.e AND b.s <= a.e + 2 AND abs(b.mz - a.mz) <= a.mz * 5e-3)"""


def near_features(spark, d, value="mz", tolerance=5e-3, bridge=2.0, on=(), carry=None):
    """(a, b) of features near in ``value`` that overlap in time once stretched by ``bridge``: every pair once. ``carry`` has nodes by id that come along as nodes_a and nodes_b."""
    f = feature_map(spark, d).select("id", value, "s", "e", "drift", *on)
    f = f.withColumn("nodes", F.lit(None)) if carry is None else f.join(carry, "id")
    x = f.select(F.col("id").alias("a"), F.col(value).alias("va"), (F.col("s") - bridge).alias("s"), (F.col("e") + bridge).alias("e"), F.col("drift").alias("da"), F.col("nodes").alias("nodes_a"), *on)
    y = f.select(F.col("id").alias("b"), F.col(value).alias("vb"), F.col("s").alias("t"), F.col("e").alias("f"), F.col("drift").alias("db"), F.col("nodes").alias("nodes_b"), *on)
    box = lambda df, v, lo, hi: df.withColumn(lo, F.col(v) * (1 - 2 * tolerance)).withColumn(hi, F.col(v))
    pairs = interval_join_2d(box(x, "va", "l1", "h1").withColumn("h1", F.col("va") * (1 + 2 * tolerance)), box(y, "vb", "l2", "h2").withColumn("l2", F.col("vb")), ("s", "e", "l1", "h1"), ("t", "f", "l2", "h2"), (48.0, 4.0), list(on))
    return pairs.filter((F.col("a") < F.col("b")) & (F.abs(F.col("vb") - F.col("va")) <= F.col("va") * tolerance))


def near_links(spark, d, value, tolerance, bridge, by=(), also=None):
    """Pairs of :func:`near_features`, as many as connect what all of them connect; the tolerance is of the pair's first id. ``also`` is a second value and how far it may differ."""
    f = feature_map(spark, d).select(*by, "id", F.col(value).alias("value"), "s", "e", *([also[0]] if also else [])).filter("value > 0 and not isnan(value)")
    near = lambda x, i, y, j: y - x <= (x if i < j else y) * tolerance
    cell = F.floor(F.log("value") / (math.log(1 + tolerance) * (1 - 1e-9)))
    return linking_edges(f, cell, near, lambda x, y: y - x <= y * tolerance, list(by), bridge, also)


@query(f"WITH {EDGES}, u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) SELECT a AS id, count(*) AS degree, min(b) AS first, max(b) AS last FROM u GROUP BY a")
def feature_adjacency(spark, d):
    """The rows of the feature graph's adjacency: the number of neighbours, the first and the last."""
    e = near_features(spark, d).select("a", "b")
    u = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return u.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"), F.min("b").alias("first"), F.max("b").alias("last"))


@query(f"""WITH RECURSIVE {EDGES}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(x, y) AS (SELECT a, b FROM u UNION SELECT r.x, u.b FROM r JOIN u ON r.y = u.a), c AS (SELECT x AS id, least(x, min(y)) AS c FROM r GROUP BY x)
SELECT coalesce(c.c, ft.id) AS merged, count(*) AS members, round(min(s), 4) AS start_time, round(max(e), 4) AS end_time, sum(n)::BIGINT AS n, round(sum(total), 3) AS total, round(sum(mz * total) / sum(total), 4) AS mz FROM ft LEFT JOIN c ON c.id = ft.id GROUP BY coalesce(c.c, ft.id)""")
def smooth_overlaps(spark, d):
    """Features near in m/z and time become one, through the components of their graph."""
    c = linked_components(near_links(spark, d, "mz", 5e-3, 2.0)).select("id", "component")
    f = feature_map(spark, d).join(c, "id", "left")
    out = f.groupBy(F.coalesce("component", "id").alias("merged")).agg(F.count("*").alias("members"), F.round(F.min("s"), 4).alias("start_time"), F.round(F.max("e"), 4).alias("end_time"), F.sum("n").alias("n"), F.round(F.sum("total"), 3).alias("total"), F.round(F.sum(F.col("mz") * F.col("total")) / F.sum("total"), 4).alias("mz"))
    return out


@query(f"""WITH RECURSIVE {EDGES}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(x, y) AS (SELECT a, b FROM u UNION SELECT r.x, u.b FROM r JOIN u ON r.y = u.a), c AS (SELECT x AS id, least(x, min(y)) AS c FROM r GROUP BY x)
SELECT c.c AS merged, {NODE} AS node, count(DISTINCT q.id) AS members, round(sum(intensity), 4) AS intensity FROM q JOIN c ON c.id = q.id GROUP BY c.c, {NODE}""")
def feature_merge(spark, d):
    """The nodes of merged features: members of one time join their signal."""
    c = linked_components(near_links(spark, d, "mz", 5e-3, 2.0)).select("id", F.col("component").alias("merged"))
    return nodes(spark, d).join(c, "id").groupBy("merged", "node").agg(F.countDistinct("id").alias("members"), F.round(F.sum("intensity"), 4).alias("intensity"))


@query(f"""WITH {EDGES}, k AS (SELECT DISTINCT id, {NODE} AS node FROM q) SELECT a, b, count(*) AS shared FROM e JOIN k x ON x.id = a JOIN k y ON y.id = b AND y.node = x.node GROUP BY a, b""")
def feature_common_nodes(spark, d):
    """Times that both features of an edge have a node at."""
    k = nodes(spark, d).groupBy("id").agg(F.collect_set("node").alias("nodes"))  # few, so they go along and no pair is shuffled
    shared = F.size(F.array_intersect("nodes_a", "nodes_b")).cast("long")
    return near_features(spark, d, carry=k).select("a", "b", shared.alias("shared")).filter("shared > 0")


MASS_EDGES = f"""{MAP}, e AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.drift AS da, b.drift AS db FROM ft a JOIN ft b ON a.id < b.id AND a.charge = b.charge AND a.s - 2 <= b.e AND b.s <= a.e + 2 AND abs(b.mass - a.mass) <= a.mass * 5e-3)"""


@query(f"WITH {MASS_EDGES} SELECT a, b FROM e")
def mass_feature_edges(spark, d):
    """Features of one charge near in neutral mass that overlap in time."""
    return near_features(spark, d, "mass", on=["charge"]).select("a", "b")


@query(f"WITH {MASS_EDGES} SELECT a, b FROM e WHERE abs(da - db) <= 0.5")
def mobility_feature_edges(spark, d):
    """Those whose drift times are near as well."""
    return near_features(spark, d, "mass", on=["charge"]).filter(F.abs(F.col("da") - F.col("db")) <= 0.5).select("a", "b")


@query(f"WITH {MASS_EDGES} SELECT a, b FROM e WHERE da <= db + 1 AND db <= da + 1")
def mobility_profile_edges(spark, d):
    """Those whose intervals of drift time overlap."""
    return near_features(spark, d, "mass", on=["charge"]).filter("da <= db + 1 and db <= da + 1").select("a", "b")


@query(f"""WITH RECURSIVE {MASS_EDGES}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(x, y) AS (SELECT a, b FROM u UNION SELECT r.x, u.b FROM r JOIN u ON r.y = u.a), c AS (SELECT x AS id, least(x, min(y)) AS c FROM r GROUP BY x)
SELECT coalesce(c.c, ft.id) AS merged, any_value(charge) AS charge, count(*) AS members, sum(n)::BIGINT AS n, round(sum(mass * total) / sum(total), 3) AS mass FROM ft LEFT JOIN c ON c.id = ft.id GROUP BY coalesce(c.c, ft.id)""")
def mass_smooth_overlaps(spark, d):
    """Features of one charge near in neutral mass and time become one."""
    c = linked_components(near_links(spark, d, "mass", 5e-3, 2.0, ["charge"])).select("id", "component")
    f = feature_map(spark, d).join(c, "id", "left")
    return f.groupBy(F.coalesce("component", "id").alias("merged")).agg(F.min("charge").alias("charge"), F.count("*").alias("members"), F.sum("n").alias("n"), F.round(F.sum(F.col("mass") * F.col("total")) / F.sum("total"), 3).alias("mass"))


RELATED = f"""{MAP}, rel AS (SELECT a.id, b.id AS partner FROM ft a JOIN ft b ON a.id <> b.id AND a.mass >= 100 AND abs(b.mass - (a.mass + 18.0106)) <= (a.mass + 18.0106) * 1e-3 AND a.s <= b.e AND b.s <= a.e)"""


def related(spark, d):
    """Features with a partner one water heavier in the same time."""
    f = feature_map(spark, d)
    a = f.filter("mass >= 100").select("id", "s", "e", (F.col("mass") + 18.0106).alias("want"))
    b = f.select(F.col("id").alias("partner"), "mass", F.col("s").alias("t"), F.col("e").alias("f"))
    return range_join(a, b, "want", "mass", 1e-3).filter("id <> partner and s <= f and t <= e").select("id", "partner")


@query(f"WITH {RELATED} SELECT id, partner FROM rel")
def mass_shift_relationship(spark, d):
    """Partners a given mass shift apart that overlap in time."""
    return related(spark, d)


@query(f"WITH {RELATED}, k AS (SELECT id, count(*) AS supporters FROM rel GROUP BY id) SELECT ft.id, coalesce(supporters, 0) AS supporters, round(total * (1 + 0.05 * coalesce(supporters, 0)), 4) AS score FROM ft LEFT JOIN k ON k.id = ft.id")
def relationship_scores(spark, d):
    """A feature's score grows by a twentieth for each partner that supports it."""
    k = related(spark, d).groupBy("id").agg(F.count("*").alias("supporters"))
    n = F.coalesce("supporters", F.lit(0).cast("long"))
    return feature_map(spark, d).join(k, "id", "left").select("id", n.alias("supporters"), F.round(F.col("total") * (1 + 0.05 * n), 4).alias("score"))


#: Precursor and product features of a run that overlap in time, correlated over their common nodes.
PAIRED = f"""{MAP}, h AS (SELECT id, {NODE} AS node, sum(intensity) AS i FROM q GROUP BY id, {NODE}), pair AS (SELECT a.id AS precursor, b.id AS product, b.total FROM ft a JOIN ft b ON a.run = b.run AND a.channel = 'click' AND b.channel <> 'click' AND a.s <= b.e AND b.s <= a.e AND b.mass <= a.mass AND b.charge <= a.charge),
sc AS (SELECT precursor, product, any_value(pair.total) AS total, count(*) AS n, CASE WHEN count(*) < 2 OR var_pop(x.i) = 0 OR var_pop(y.i) = 0 THEN -1 ELSE round(corr(x.i, y.i), 6) END AS score FROM pair JOIN h x ON x.id = precursor JOIN h y ON y.id = product AND y.node = x.node GROUP BY precursor, product),
ed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY precursor ORDER BY score DESC, product) AS r FROM sc WHERE score >= 0.1) WHERE r <= 1500)"""


def correlated(spark, d, top=1500):
    """(precursor, product, n, total, score): products in a precursor's time, not heavier nor of higher charge, of correlation 0.1 or more; the ``top`` best of each."""
    f = feature_map(spark, d)
    a = f.filter("channel = 'click'").select(F.col("id").alias("precursor"), "run", "s", "e", F.col("mass").alias("ma"), F.col("charge").alias("za"))
    b = f.filter("channel <> 'click'").select(F.col("id").alias("product"), "run", F.col("s").alias("t"), F.col("e").alias("f"), F.col("mass").alias("mb"), F.col("charge").alias("zb"), "total")
    pairs = interval_join(a, b, ("s", "e"), ("t", "f"), 48.0, ["run"]).filter("mb <= ma and zb <= za").select("precursor", "product", "total")
    h = nodes(spark, d).groupBy("id", "node").agg(F.sum("intensity").alias("i"))
    both = pairs.join(h.toDF("precursor", "node", "x"), "precursor").join(h.toDF("product", "node", "y"), ["product", "node"])
    g = both.groupBy("precursor", "product").agg(F.min("total").alias("total"), F.count("*").alias("n"), correlation("x", "y").alias("r"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    score = F.when((F.col("n") < 2) | (F.col("vx") == 0) | (F.col("vy") == 0), -1.0).otherwise(F.round("r", 6))
    rank = F.row_number().over(W.partitionBy("precursor").orderBy(F.desc("score"), "product"))
    return g.withColumn("score", score).filter("score >= 0.1").withColumn("rank", rank).filter(F.col("rank") <= top).select("precursor", "product", "n", "total", "score")


@query(f"WITH {PAIRED} SELECT precursor, product, n, score FROM ed")
def precursor_product_edges(spark, d):
    """Product features whose chromatograms follow a precursor's."""
    return correlated(spark, d).select("precursor", "product", "n", "score")


@query(f"WITH {PAIRED} SELECT precursor, product, round(total * score * score, 4) AS intensity, round(total / max(total) OVER (PARTITION BY precursor), 6) AS relative FROM ed")
def pseudo_spectra(spark, d):
    """Pseudo product spectra: a product's signal weighted by the squared correlation, and its share of the strongest."""
    w = W.partitionBy("precursor")
    return correlated(spark, d).select("precursor", "product", F.round(F.col("total") * F.col("score") * F.col("score"), 4).alias("intensity"), F.round(F.col("total") / F.max("total").over(w), 6).alias("relative"))


@query(f"{WITH} SELECT CAST(round(t, 0) AS BIGINT) AS scan_hour, count(*) AS n_peaks, count(DISTINCT id) AS n_features, round(sum(intensity), 4) AS total FROM q GROUP BY CAST(round(t, 0) AS BIGINT)")
def features_to_scans(spark, d):
    """A feature map turned back into scans, by rounded time."""
    return feature_points(spark, d).groupBy(F.round("t", 0).cast("long").alias("scan_hour")).agg(F.count("*").alias("n_peaks"), F.countDistinct("id").alias("n_features"), F.round(F.sum("intensity"), 4).alias("total"))


@query(f"""{WITH}, h AS (SELECT run, channel, {NODE} AS node, sum(intensity) AS i FROM q WHERE channel IN ('click', 'view') GROUP BY ALL), a AS (SELECT * FROM h WHERE channel = 'click'), b AS (SELECT * FROM h WHERE channel = 'view')
SELECT coalesce(a.run, b.run) AS run, coalesce(a.node, b.node) AS node, round(coalesce(a.i, 0) + coalesce(b.i, 0), 4) AS intensity FROM a FULL JOIN b ON a.run = b.run AND a.node = b.node""")
def feature_sum(spark, d):
    """Two features added node by node: a time that only one has keeps its own."""
    h = nodes(spark, d).groupBy("run", "channel", "node").agg(F.sum("intensity").alias("i"))
    side = lambda c, n: h.filter(F.col("channel") == c).select("run", "node", F.col("i").alias(n))
    both = side("click", "x").join(side("view", "y"), ["run", "node"], "full")
    return both.select("run", "node", F.round(F.coalesce("x", F.lit(0.0)) + F.coalesce("y", F.lit(0.0)), 4).alias("intensity"))


@query(f"""{WITH}, x AS (SELECT *, max(intensity) OVER (PARTITION BY id) AS top FROM q), b AS (SELECT id, min(t) AS lo, max(t) AS hi FROM x WHERE intensity >= 0.1 * top GROUP BY id)
SELECT q.id, count(*) AS n, round(min(lo), 4) AS start_time, round(max(hi), 4) AS end_time, round(sum(intensity), 4) AS total FROM q JOIN b ON q.id = b.id AND t BETWEEN lo AND hi GROUP BY q.id""")
def extract_fitted_region(spark, d):
    """The part of each feature between its first and last point of a tenth of its height."""
    w = W.partitionBy("id")
    x = feature_points(spark, d).withColumn("top", F.max("intensity").over(w))
    high = F.when(F.col("intensity") >= 0.1 * F.col("top"), F.col("t"))
    x = x.withColumn("lo", F.min(high).over(w)).withColumn("hi", F.max(high).over(w)).filter("t between lo and hi")
    return x.groupBy("id").agg(F.count("*").alias("n"), F.round(F.min("lo"), 4).alias("start_time"), F.round(F.max("hi"), 4).alias("end_time"), F.round(F.sum("intensity"), 4).alias("total"))


@query(f"{WITH} SELECT id, round(drift, 4) AS drift, n FROM ft WHERE drift BETWEEN 1 AND 2 AND e >= {NOW}")
def between_ion_mobilities(spark, d):
    """Features of a range of drift times that reach into a time range."""
    return feature_map(spark, d).filter((F.col("drift").between(1, 2)) & (F.col("e") >= NOW)).select("id", F.round("drift", 4).alias("drift"), "n")


@query(f"{WITH}, win AS (SELECT scan_id, 100 + (precursor_mz - 500) / 5 AS lo, 100 + (precursor_mz - 500) / 5 + 3 AS hi FROM v_peak_scan) SELECT scan_id, count(*) AS n, min(id) AS first, round(sum(total), 4) AS total FROM win JOIN ft ON mz BETWEEN lo AND hi GROUP BY scan_id")
def features_in_isolation_window(spark, d):
    """The features inside each scan's isolation window."""
    lo = F.lit(100.0) + (F.col("precursor_mz") - 500) / 5
    win = view(spark, d, "v_peak_scan").select("scan_id", lo.alias("lo"), (lo + 3).alias("hi"))
    f = feature_map(spark, d).select("id", "total", F.col("mz").alias("at"), F.col("mz").alias("to"))
    return interval_join(win, f, ("lo", "hi"), ("at", "to"), 3.0).groupBy("scan_id").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.round(F.sum("total"), 4).alias("total"))


@query(f"{WITH}, p AS (SELECT scan_id, 473353 + scan_time AS t, 100 + (precursor_mz - 500) / 5 AS want FROM v_peak_scan WHERE ms_level = 2), h AS (SELECT scan_id, id, total, row_number() OVER (PARTITION BY scan_id ORDER BY total DESC, id) AS r FROM p JOIN ft ON t BETWEEN s AND e AND abs(mz - want) <= want * 2e-2) SELECT scan_id, id FROM h WHERE r = 1")
def find_precursor_feature(spark, d):
    """The strongest feature at each precursor's time and m/z."""
    want = F.lit(100.0) + (F.col("precursor_mz") - 500) / 5
    p = view(spark, d, "v_peak_scan").filter("ms_level = 2").select("scan_id", (F.lit(473353.0) + F.col("scan_time")).alias("t"), want.alias("want"))
    f = feature_map(spark, d).select("id", "s", "e", "mz", "total")
    h = range_join(p, f, "want", "mz", 2e-2).filter("t between s and e")
    return h.groupBy("scan_id").agg(F.max_by("id", F.struct("total", -F.col("id"))).alias("id"))


@query()
def trace_mass_features(spark, d):
    """Features of neutral mass traced over time, each charge for itself."""
    from massloom.operators.spectra import trace_features

    v = view(spark, d, "v_signal").withColumn("charge", (1 + F.col("event_id") % 3).cast("int"))
    p = v.select("charge", F.col("event_id").alias("id"), neutral_mass(F.col("mz"), F.col("charge")).alias("mz"), F.unix_micros("ts").alias("time"), "intensity")
    return trace_features(p.filter("mz > 0"), 2e-5, ("charge",))


@query(f"{WITH}, k AS (SELECT id, row_number() OVER (PARTITION BY run ORDER BY total DESC, id) AS place, sum(total) OVER (PARTITION BY run ORDER BY total DESC, id ROWS UNBOUNDED PRECEDING) / sum(total) OVER (PARTITION BY run) AS share FROM ft) SELECT id, place, round(share, 6) AS share FROM k")
def features_by_signal(spark, d):
    """Features of a run by falling signal with the share that they make up so far: the order in which a merger takes them."""
    w = W.partitionBy("run").orderBy(F.desc("total"), "id")
    so_far = F.sum("total").over(w.rowsBetween(W.unboundedPreceding, 0)) / F.sum("total").over(W.partitionBy("run"))
    return feature_map(spark, d).select("id", F.row_number().over(w).cast("long").alias("place"), F.round(so_far, 6).alias("share"))


#: Features on a grid of one hour, by straight lines between their points.
GRID = """ut AS (SELECT id, t, sum(intensity) AS y FROM q GROUP BY id, t), sg AS (SELECT *, lead(t) OVER w AS t2, lead(y) OVER w AS y2 FROM ut WINDOW w AS (PARTITION BY id ORDER BY t)),
gr AS (SELECT *, unnest(range(CAST(ceil(t) AS BIGINT), CASE WHEN t2 IS NULL THEN CAST(floor(t) AS BIGINT) + 1 ELSE CAST(ceil(t2) AS BIGINT) END)) AS grid FROM sg),
rs AS MATERIALIZED (SELECT id, grid, CASE WHEN t2 IS NULL THEN y ELSE y + (y2 - y) / (t2 - t) * (grid - t) END AS y FROM gr)"""


def resampled(spark, d):
    return resample(feature_points(spark, d).select("id", "t", "intensity"), ["id"], "t", "intensity", 1.0)


@query(f"{WITH}, {GRID} SELECT id, count(*) AS n, min(grid) AS first, max(grid) AS last, round(sum(y) + 1e-9, 4) AS area FROM rs GROUP BY id")
def interpolate_feature(spark, d):
    """Each feature resampled on a grid of one hour: its points, span and area."""
    return resampled(spark, d).groupBy("id").agg(F.count("*").alias("n"), F.min("grid").alias("first"), F.max("grid").alias("last"), F.round(F.sum("intensity") + 1e-9, 4).alias("area"))


@query(f"""WITH {PAIRED}, {GRID}, rc AS (SELECT precursor, product, count(*) AS n, var_pop(x.y) AS vx, var_pop(z.y) AS vz, corr(x.y, z.y) AS r FROM pair JOIN rs x ON x.id = precursor JOIN rs z ON z.id = product AND z.grid = x.grid GROUP BY precursor, product)
SELECT precursor, product, n, round(r, 5) AS score FROM rc WHERE n >= 3 AND vx > 1e-9 AND vz > 1e-9 AND r >= 0.5""")
def resampled_correlation(spark, d):
    """Precursors and products whose resampled chromatograms go together: correlation 0.5 or more over three common hours or more."""
    f = feature_map(spark, d)
    a = f.filter("channel = 'click'").select(F.col("id").alias("precursor"), "run", "s", "e", F.col("mass").alias("ma"), F.col("charge").alias("za"))
    b = f.filter("channel <> 'click'").select(F.col("id").alias("product"), "run", F.col("s").alias("t"), F.col("e").alias("f"), F.col("mass").alias("mb"), F.col("charge").alias("zb"))
    pairs = interval_join(a, b, ("s", "e"), ("t", "f"), 48.0, ["run"]).filter("mb <= ma and zb <= za").select("precursor", "product")
    g = resampled(spark, d)
    both = pairs.join(g.toDF("precursor", "grid", "x"), "precursor").join(g.toDF("product", "grid", "y"), ["product", "grid"])
    r = both.groupBy("precursor", "product").agg(F.count("*").alias("n"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), correlation("x", "y").alias("r"))
    return r.filter("n >= 3 and vx > 1e-9 and vy > 1e-9 and r >= 0.5").select("precursor", "product", "n", F.round("r", 5).alias("score"))
