"""Tracing, merging and demultiplexing against plain versions that go through everything at once."""

import random

from massloom.operators import tracing as T


def plain_trace(points, tolerance, drift):
    features = []  # [charge, mass, drift, total, ids]
    for i, z, mass, at, _, y in sorted(points, key=lambda p: (p[4], p[2], p[0])):
        near = [(abs(f[1] - mass), k) for k, f in enumerate(features) if f[0] == z and abs(f[1] - mass) <= mass * tolerance and abs(f[2] - at) <= drift]
        if near:
            f = features[min(near)[1]]
            f[3] += y
            f[1] += (mass - f[1]) * y / f[3]
            f[2] += (at - f[2]) * y / f[3]
            f[4].append(i)
        else:
            features.append([z, mass, at, y, [i]])
    return {frozenset(f[4]) for f in features}


def test_tracing_in_drift_equals_one_pass_over_all_features(spark):
    rng = random.Random(4)
    centres = [(rng.randrange(1, 3), 500.0 + 0.004 * rng.randrange(60), rng.randrange(8) / 4) for _ in range(40)]
    points = []
    for i in range(600):
        z, mass, at = rng.choice(centres)
        points.append((i, z, mass + rng.gauss(0, 0.002), at + rng.gauss(0, 0.05), float(rng.randrange(30)), rng.random() * 100 + 1))
    df = spark.createDataFrame([*points, (9000, 1, None, 0.1, 1.0, 1.0)], "id long, charge int, mass double, drift double, time double, intensity double")
    got = {}
    for r in T.trace_in_drift(df, 1e-5, 0.1).collect():
        got.setdefault((r.chain, r.feature), set()).add(r.id)
    assert {frozenset(x) for x in got.values()} == plain_trace(points, 1e-5, 0.1)
    assert T.trace_in_drift(df.limit(0)).collect() == []


def plain_merge(features, tolerance):
    held, out = [], {}  # [centre, start, end, total, id]
    for _, i, value, start, end, total in sorted(features, key=lambda f: (-f[5], f[1])):
        near = sorted(h for h in held if value - value * tolerance <= h[0] <= value + value * tolerance and h[1] <= end and start <= h[2])
        if near:
            h = next(x for x in held if x is near[0])
            h[0] += (value - h[0]) * total / (h[3] + total)
            h[1], h[2], h[3] = min(h[1], start), max(h[2], end), h[3] + total
            out[i] = h[4]
        else:
            held.append([value, start, end, total, i])
            out[i] = i
    return out


def test_merging_by_signal_equals_one_pass_over_all_features(spark):
    rng = random.Random(6)
    features = []
    for i in range(400):
        start = rng.random() * 50
        features.append((rng.choice("ab"), i, 300.0 + 0.003 * rng.randrange(300) + rng.random() * 1e-3, start, start + rng.random() * 6, float(rng.randrange(1, 300))))
    df = spark.createDataFrame(features, "channel string, id long, value double, start double, end double, total double")
    got = {r.id: r.merged for r in T.merge_by_signal(df, 1e-5, ("channel",)).collect()}
    want = plain_merge([f for f in features if f[0] == "a"], 1e-5) | plain_merge([f for f in features if f[0] == "b"], 1e-5)
    assert got == want and 20 < sum(k != v for k, v in want.items()) < 380


def test_two_overlapping_windows_and_what_they_hold(spark):
    windows = spark.createDataFrame([(1, 400.0, 428.0), (2, 420.0, 448.0), (3, 500.0, 528.0)], "window long, lo double, hi double")
    atoms = T.window_atoms(windows, 28.0)
    assert {(r.atom_lo, r.atom_hi): r.windows for r in atoms.collect()} == {(400.0, 420.0): [1], (420.0, 428.0): [1, 2], (428.0, 448.0): [2], (500.0, 528.0): [3]}
    seen = spark.createDataFrame([("both", 1), ("both", 2), ("left", 1), ("right", 2), ("far", 1), ("far", 3), ("all", 1), ("all", 2), ("all", 3)], "fragment string, window long")
    got = {}
    for r in T.assign_to_atoms(seen, atoms, ["fragment"]).collect():
        got.setdefault(r.fragment, set()).add(r.atom_lo)
    assert got == {"both": {420.0}, "left": {400.0}, "right": {428.0}, "far": {400.0, 500.0}, "all": {420.0, 500.0}}


def test_points_of_one_id_keep_their_own_figures(spark):
    points = [(1, 1, 500.0, 0.1, 1.0, 2.0), (1, 1, 700.0, 0.1, 2.0, 3.0), (2, 1, 500.001, 0.1, 3.0, 4.0)]
    df = spark.createDataFrame(points, "id long, charge int, mass double, drift double, time double, intensity double")
    found = T.trace_in_drift(df, 1e-5, 0.1)
    assert sorted((r.id, r.charge, r.mass, r.drift, r.time, r.intensity) for r in found.collect()) == sorted(points)


def test_atoms_of_a_fragment_need_no_second_look_at_its_peaks(spark):
    atoms = spark.createDataFrame([(400.0, 420.0, [1]), (420.0, 428.0, [1, 2])], "atom_lo double, atom_hi double, windows array<long>")
    held = spark.createDataFrame([("x", [1, 2], 7), ("y", [1], 8), ("z", [2], 9)], "fragment string, held array<long>, n int")
    out = T.atoms_of_held(held, atoms, ["fragment"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Join") == 1
    assert sorted((r.fragment, r.n, r.atom_lo) for r in out.collect()) == [("x", 7, 420.0), ("y", 8, 400.0)]
