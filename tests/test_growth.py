"""Steps that have to grow with their input: divisions by no signal, look-ahead, fits of one spectrum, near features, sums over pairs."""

import math

from pyspark.sql import functions as F

from massloom.functions.mass import ratio
from massloom.functions.scoring import correlation, msdeconv_term
from massloom.operators import dependence as D
from massloom.operators.ordered import next_where


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_signals_of_zero_score_nothing_and_raise_nothing(spark):
    p = spark.createDataFrame([(1, 100.0, 0.0, 5.0), (1, 100.0, 4.0, 5.0), (2, 100.0, 0.0, 0.0)], "k int, mz double, obs double, theo double")
    s = {r.k: r.s for r in p.groupBy("k").agg(F.sum(msdeconv_term(F.col("mz"), F.col("obs"), F.lit(2), F.col("mz"), F.col("theo"))).alias("s")).collect()}
    assert math.isclose(s[1], math.sqrt(5.0) * 0.75) and math.isnan(s[2])
    r = [x.r for x in p.orderBy("k", "obs").select(ratio(F.col("theo"), F.col("obs")).alias("r")).collect()]
    assert r[:2] == [math.inf, 1.25] and math.isnan(r[2])


def test_a_constant_has_no_correlation(spark):
    p = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 2.0), (2, 2.0, 4.0), (2, 3.0, 5.0)], "k int, x double, y double")
    c = {r.k: r.c for r in p.groupBy("k").agg(correlation("x", "y").alias("c")).collect()}
    assert math.isnan(c[1]) and math.isclose(c[2], 0.9819805060619657)


def test_look_ahead_reads_each_row_once(spark):
    rows = spark.range(500).withColumn("even", F.col("id") % 2 == 0)
    out = next_where(rows, ["id"], F.col("even"), "id", "n")
    assert {r.id: r.n for r in out.collect()} == {i: next((k for k in range(i + 1, 500) if k % 2 == 0), None) for i in range(500)}
    assert "unboundedfollowing" not in plan(out).lower()


def test_fits_and_their_solution_shuffle_peaks_once(spark):
    p = spark.createDataFrame([(1, 500.0, 9.0, 2.0), (1, 501.0034, 5.0, 2.0), (1, 502.0067, 2.0, 2.0), (1, 502.0067, 1.0, 2.0), (2, 500.0, 9.0, 2.0), (2, 500.5017, 5.0, 2.0)], "scan_id long, mz double, intensity double, snr double")
    fits = D.isotopic_fits(D.numbered_peaks(p), [1, 2], 4e-5)
    got = {(r.scan_id, r.mono, r.charge): (r.peaks, r.mzs, r.n_peaks) for r in fits.collect()}
    # equal m/z: the first counts, so the second is found by no fit; alone it is the lightest of a fit of itself, which is dropped
    assert got == {(1, 1, 1): ([1, 2, 3], [500.0, 501.0034, 502.0067], 3), (1, 2, 1): ([2, 3], [501.0034, 502.0067], 2), (2, 1, 2): ([1, 2], [500.0, 500.5017], 2), (1, 1, 2): ([1, 2], [500.0, 501.0034], 2), (1, 2, 2): ([2, 3], [501.0034, 502.0067], 2)}
    solved = D.greedy_disjoint(fits)
    assert sorted((r.scan_id, r.charge, r.layer) for r in solved.collect()) == [(1, 1, 0), (2, 2, 0)]
    fresh = plan(D.greedy_disjoint(fits))
    assert fresh.count("Exchange") <= 3 and "Join" not in fresh
    assert "Join" not in plan(D.not_superceded(fits))


def test_mean_similarity_of_a_group_makes_no_pairs(spark, tmp_path):
    from massloom.catalog.similarity import cluster_avg_similarity, cosine

    peaks = [(s, 1, k, k, 50.0 * (10 * s % 7 + k), 1.0 + (s + k) % 5, 0.0) for s in range(12) for k in range(8)]
    spark.createDataFrame(peaks, "l_suppkey long, l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_quantity double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(s, 20.0 * (s % 5)) for s in range(12)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    total = sum(r.s for r in cosine(spark, str(tmp_path)).collect())
    found = cluster_avg_similarity(spark, str(tmp_path))
    (row,) = found.collect()
    assert row["size"] == 12 and abs(row.similarity - total / 66) < 1e-6
    assert "cell" not in plan(found)


def test_few_links_connect_what_all_pairs_connect(spark):
    import math as m
    import random

    from massloom.operators.graph import connected_components, linking_edges

    rng, tol = random.Random(4), 0.02
    rows = [(i, "xy"[i % 2], 100 * m.exp(rng.random() * 0.4), t := rng.randrange(60) / 1.0, t + rng.randrange(5)) for i in rng.sample(range(1000), 300)]
    near = lambda x, i, y, j: y - x <= (x if i < j else y) * tol
    root = {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for i, g, v, s, e in rows:
        for j, h, w, t, f in rows:
            if i < j and g == h and s - 1 <= f and t - 1 <= e and (near(v, i, w, j) if v <= w else near(w, j, v, i)):
                pairs += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(rows, "id long, kind string, value double, s double, e double")
    links = linking_edges(df, F.floor(F.log("value") / (m.log(1 + tol) * (1 - 1e-9))), near, lambda x, y: y - x <= y * tol, ["kind"], 1.0)
    got = {r.id: r.component for r in connected_components(links, "a", "b").collect()}
    assert {r[0]: got.get(r[0], r[0]) for r in rows} == {r[0]: find(r[0]) for r in rows}
    assert links.distinct().count() < 3 * len(rows) and pairs > links.distinct().count()


def test_a_spectrum_whose_fits_all_drop_out_has_no_solution(spark):
    from massloom.operators.solutions import solve_with_subtraction

    rows = [(1, 7, n, 500.0 + n, 500.5 + n, 5.0, 40.0, 0.5) for n in range(2)]  # too far off to score
    m = spark.createDataFrame(rows, "scan_id long, fit long, n long, want double, mz double, snr double, intensity double, weight double")
    assert solve_with_subtraction(m).collect() == []


def test_many_fits_made_side_by_side_are_what_each_is_alone():
    import numpy as np

    from massloom.operators import profiles

    rng, x = np.random.default_rng(5), np.arange(30.0)
    held = [(x[:n], 50 * np.exp(-((x[:n] - n / 2) ** 2) / 8) + rng.random(n) * 20) for n in (3, 5, 9, 17, 24, 30, 30)]
    together = profiles.adaptive_fits(held, 1)
    for (a, b), (kind, way, test, centres) in zip(held, together, strict=True):
        alone = profiles.adaptive_fit(a, b, 1)
        assert (kind, way, len(centres)) == (alone[0], alone[1], len(alone[3])) and math.isclose(test, alone[2], abs_tol=1e-6)
    assert np.allclose(profiles.shape_scores(held, "gaussian", 1), [profiles.shape_score(a, b, "gaussian", 1) for a, b in held], atol=1e-6)
    p = np.array([20.0, 60.0, 3.0, 0.5])
    y = profiles.skewed_gaussian(x, p)
    assert all(np.abs(profiles.skewed_gaussian(x, q) - y).max() < 1e-3 for q in profiles.fit_shapes([(x, y, "skewed", 100, 1e-12)] * 3))


def test_costly_kernels_of_few_bytes_are_dealt_over_all_partitions(spark, tmp_path):
    from massloom.catalog.kernels import adaptive_shape_fit, profile_split, shape_fit

    spark.sql("select id as event_id, timestamp_seconds(1704067200 + id * 40000) as ts, id % 8 as user_id, 'view' as event_type, double(id % 7) as value from range(200)").write.parquet(f"{tmp_path}/events.parquet")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for query in (adaptive_shape_fit, shape_fit, profile_split):
        found = query(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() == n and len({r.run for r in found.collect()}) == 8


def test_patterns_of_equal_atom_counts_are_made_once(spark, tmp_path):
    from functools import lru_cache

    from massloom.catalog.kernels import isotopic_cluster
    from massloom.operators import isotopes

    unit, pattern = isotopes.AVERAGINES["peptide"], lru_cache(None)(isotopes.truncated_pattern)
    for k in range(300):
        x, p = isotopes.isotopic_cluster(unit, 900 + k / 100, 1 + k % 3, pattern=pattern)
        y, q = isotopes.isotopic_cluster(unit, 900 + k / 100, 1 + k % 3)
        assert x.tolist() == y.tolist() and p.tolist() == q.tolist()
    assert pattern.cache_info().misses < 60
    spark.sql("select id as p_partkey, 'b' as p_brand, 900 + id / double(10) as p_retailprice, 1 as p_size from range(40)").write.parquet(f"{tmp_path}/part.parquet")
    found = isotopic_cluster(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and found.count() == 120


def test_pairs_of_spectra_are_compared_without_shuffling_matches(spark):
    import random

    from massloom.operators.pairing import matched_pairs

    rng = random.Random(7)
    rows = [(s, 500.0 + (37 * s) % 90, 100 + rng.randrange(40) * 7 + rng.choice([0.0, 0.004]) + (37 * s % 90 if k % 3 == 0 else 0), float(rng.randrange(9))) for s in range(14) for k in range(12)]
    want: dict = {}
    for a, ma, p, x in rows:
        for b, mb, q, y in rows:
            if a < b and abs(mb - ma) <= 50:
                moved = p + mb - ma
                kind = 0 if abs(q - p) <= p * 5e-5 else 1 if moved > 0 and abs(q - moved) <= moved * 5e-5 else None
                if kind is not None:
                    w = want.setdefault((a, b), [0, 0.0, 0, 0.0])
                    w[2 * kind] += 1
                    w[2 * kind + 1] += x * y
    assert any(w[2] for w in want.values())
    peaks = spark.createDataFrame(rows, "scan_id long, m double, mz double, i double")
    for block in (1, 3, 100, None):
        found = matched_pairs(peaks, 50.0, 5e-5, block)
        got = {(r.a, r.b): [r.n_direct, r.direct, r.n_shifted, r.shifted] for r in found.collect()}
        assert got == want
    assert "_bin" not in plan(found)


def test_few_links_connect_what_pairs_near_in_two_values_connect(spark):
    import math as m
    import random

    from massloom.operators.graph import connected_components, linking_edges

    rng, tol = random.Random(8), 0.02
    rows = [(i, 100 * m.exp(rng.random() * 0.3), t := rng.randrange(80) / 1.0, t + rng.randrange(4), rng.randrange(50) / 10.0) for i in rng.sample(range(1000), 300)]
    root = {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for i, v, s, e, x in rows:
        for j, w, t, f, y in rows:
            if i < j and s - 1 <= f and t - 1 <= e and abs(w - v) <= v * tol and abs(x - y) <= 0.5:
                pairs += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(rows, "id long, value double, s double, e double, drift double")
    near = lambda x, i, y, j: y - x <= (x if i < j else y) * tol
    links = linking_edges(df, F.floor(F.log("value") / (m.log(1 + tol) * (1 - 1e-9))), near, lambda x, y: y - x <= y * tol, [], 1.0, ("drift", 0.5))
    got = {r.id: r.component for r in connected_components(links, "a", "b").collect()}
    assert pairs > 50 and {r[0]: got.get(r[0], r[0]) for r in rows} == {r[0]: find(r[0]) for r in rows}


def test_links_joined_in_tasks_connect_what_rounds_over_tables_do(spark):
    import random

    from massloom.operators.graph import connected_components, linked_components

    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + k, 1001 + k) for k in range(50)] + [(7, 7), (None, 3), (2000, 2000)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    want = {(r.id, r.component) for r in connected_components(df, "a", "b").collect()}
    for held in (1, 40, 1 << 19):
        assert {(r.id, r.component) for r in linked_components(df, held).collect()} == want
    assert linked_components(df.filter("a < 0")).collect() == []


def test_merged_features_make_no_pairs(spark, monkeypatch):
    from massloom.catalog import featuremaps as M

    monkeypatch.setattr(M, "near_features", lambda *a, **k: 1 / 0)
    for query in (M.smooth_overlaps, M.feature_merge, M.mass_smooth_overlaps):
        assert query(spark, "/root/testdata/sf0.001").count() > 0


def test_nearest_of_each_group_shuffles_points_and_no_pairs(spark):
    import random

    from massloom.operators.joins import nearest_by_group

    rng, tol = random.Random(3), 1e-3
    queries = [(k, 100.0 + rng.randrange(400) / 8) for k in range(60)] + [(None, 120.0), (90, 0.0), (91, None), (92, 1000.0), (93, 125.0)]
    points = [(rng.randrange(5), 100.0 + rng.randrange(5000) / 100) for _ in range(900)] + [(None, 120.01), (7, 1000.0 + 1.0), (8, 1000.0), (7, 125.0625), (7, 124.9375), (9, None), (9, -1.0)]
    want = set()
    for q, v in queries:
        near = [(g, x) for g, x in points if v and x is not None and abs(x - v) < v * tol]
        for g in {g for g, _ in near}:
            want.add((q, g, min((abs(x - v), x) for h, x in near if h == g)[1]))
    q, p = spark.createDataFrame(queries, "query long, value double"), spark.createDataFrame(points, "group long, at double")
    found = nearest_by_group(q, p.withColumn("shown", F.col("at")), tol)
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    # at the very tolerance is no match; of two as near the lower counts
    assert (92, 8, 1000.0) in want and (92, 7, 1001.0) not in want and (93, 7, 124.9375) in want
    assert "Window" not in plan(found) and plan(found).index("MapInArrow") < plan(found).index("Exchange")


def test_searched_features_are_ranked_once_for_each_value(spark):
    from massloom.catalog import QUERIES

    for name in ("feature_map_search", "mass_feature_map_search"):
        found = plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "Window [row_number() windowspecdefinition(target_id" not in found and "partial_min" in found


def test_cosines_of_pairs_shuffle_spectra_and_no_matches(spark, monkeypatch):
    import math as m
    import random

    from massloom.catalog import similarity as C
    from massloom.operators.pairing import products, spectra_of

    rng = random.Random(9)
    rows = [(s, 500.0 + (37 * s) % 90, float(mz), None if rng.random() < 0.2 or s in (2, 3) else float(rng.randrange(9))) for s in range(14) for mz in rng.sample(range(-3, 25), 9)]
    for tol, odd in ((0.0, None), (0.05, None), (0.0, m.inf), (0.0, 1e9)):
        data = [(s, c, mz, odd if odd == m.inf and s == 5 else i) for s, c, mz, i in rows] + ([(s, 500.0 + (37 * s) % 90, odd + s, 1.0) for s in range(14)] if odd == 1e9 else [])
        norm, want = {}, {}
        for a, ma, p, x in data:
            for b, mb, q, y in data:
                if a <= b and abs(mb - ma) <= 50 and abs(q - p) <= p * tol:
                    own = norm if a == b else want
                    w = own.setdefault((a, b), None)
                    if x is not None and y is not None:
                        own[a, b] = (w or 0.0) + x * y
        peaks = spark.createDataFrame(data, "scan_id long, m double, mz double, i double")
        for block in (1, 3, 100, None):
            found = products(spectra_of(peaks), 50.0, tol, True, block)
            got = {(r.a, r.b): r.dot for r in found.collect()}
            assert got.keys() == want.keys() and None in got.values()
            assert all(got[k] == v or m.isnan(got[k]) and m.isnan(v) for k, v in want.items())
    assert {(r.a, r.norm_a) for r in found.collect()} <= {(a, v or 0.0) for (a, _), v in norm.items()}
    for query in (C.cosine_binned, C.cosine_ppm):
        made = plan(query(spark, "/root/testdata/sf0.001"))
        assert "cell" not in made and "_bin" not in made and "(a#" not in made.split("MapInArrow")[1]


def test_correlations_shuffle_series_and_no_common_places(spark):
    import random

    from massloom.operators.pairing import correlations, spectra_of

    rng = random.Random(12)
    rows = [(s, 100.0 + 37 * s % 11, float(p), float(rng.randrange(9))) for s in range(16) for p in rng.sample(range(9), 6)]
    rows += [(20, 103.0, float(p), 5.0) for p in range(9)] + [(21, 103.0, float(p), 1e6 + 1e-3 * p) for p in range(9)] + [(22, 103.0, float(p), None if p == 2 else p % 4.0) for p in range(9)]
    held, centre = {}, {r[0]: r[1] for r in rows}
    for s, _, p, v in rows:
        held.setdefault(s, {})[p] = v
    want = {}
    for a in held:
        for b in held:
            common = held[a].keys() & held[b].keys()
            x, y = ([held[k][p] for p in common] for k in (a, b))
            if a < b and abs(centre[a] - centre[b]) <= 2 and len(common) >= 3 and min(len(set(x) - {None}), len(set(y) - {None})) > 1:
                x, y = zip(*((p, q) for p, q in zip(x, y, strict=True) if p is not None and q is not None), strict=True)
                mx, my = sum(x) / len(x), sum(y) / len(y)
                r = sum((p - mx) * (q - my) for p, q in zip(x, y, strict=True)) / math.sqrt(sum((p - mx) ** 2 for p in x) * sum((q - my) ** 2 for q in y))
                want[a, b] = (len(common), r)
    series = spectra_of(spark.createDataFrame(rows, "scan_id long, m double, mz double, i double"))
    assert any(22 in k for k in want) and any(21 in k for k in want) and not any(20 in k for k in want)
    for block in (1, None):
        found = correlations(series, 2.0, 3, block)
        got = {(r.a, r.b): (r.n, r.r) for r in found.collect()}
        assert got.keys() == want.keys() and all(got[k][0] == n and abs(got[k][1] - r) < 1e-6 for k, (n, r) in want.items())
    assert "(a#" not in plan(found).split("MapInArrow")[1]


def test_common_nodes_are_counted_beside_the_pair(spark):
    from massloom.catalog.featuremaps import feature_common_nodes

    found = feature_common_nodes(spark, "/root/testdata/sf0.001")
    made = plan(found)
    assert "array_intersect" in made and "node#" not in made.split("array_intersect")[0]
