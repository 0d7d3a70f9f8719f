"""Solvers over fits that share peaks, against going through them one after another."""

import random
from itertools import combinations

import pytest

from massloom.operators import solutions as S


def random_fits(rng, scans=6, peaks=25, fits=30):
    out = []
    for s in range(scans):
        for f in range(rng.randrange(fits)):
            held = rng.sample(range(peaks), rng.randrange(1, 5))
            out.append((s, s * 100 + f, sorted(held), float(rng.randrange(1, 12))))
    return out


@pytest.fixture(scope="module")
def fits():
    return random_fits(random.Random(3))


def links(spark, fits):
    return spark.createDataFrame([(s, f, n, y) for s, f, held, y in fits for n in held], "scan_id long, fit long, n long, score double")


def first_fit(fits):
    laid = {}
    for s, f, held, y in sorted(fits, key=lambda x: (-x[3], x[1])):
        taken = {laid[g] for t, g, other, _ in fits if t == s and g in laid and set(held) & set(other)}
        laid[f] = next(k for k in range(len(fits)) if k not in taken)
    return laid


def test_greedy_and_layers_equal_going_by_score(spark, fits):
    want = first_fit(fits)
    rows = links(spark, fits)
    assert {r.fit: r.layer for r in S.layers(rows).collect()} == want
    assert {r.fit for r in S.greedy_rounds(rows).collect()} == {f for f, k in want.items() if k == 0}


def test_a_long_chain_of_falling_scores_needs_many_rounds(spark):
    chain = [(1, k, [k, k + 1], 100.0 - k) for k in range(23)]
    got = {r.fit: r.layer for r in S.layers(links(spark, chain)).collect()}
    assert got == {k: k % 2 for k in range(23)}
    assert {r.fit for r in S.greedy_rounds(links(spark, chain)).collect()} == set(range(0, 23, 2))


def test_heaviest_path_weighs_as_much_as_the_best_of_all_subsets(spark):
    rng = random.Random(5)
    spans = []
    for s in range(8):
        for f in range(rng.randrange(1, 11)):
            lo = rng.randrange(40) / 2
            spans.append((s, s * 100 + f, lo, lo + rng.randrange(6), float(rng.randrange(1, 9))))
    got = {}
    for r in S.heaviest_paths(spark.createDataFrame(spans, "scan_id long, fit long, lo double, hi double, score double")).collect():
        got.setdefault(r.scan_id, []).append((r.fit, r.weight))
    for s in {x[0] for x in spans}:
        own = [x for x in spans if x[0] == s]
        best = 0
        for k in range(1, len(own) + 1):
            for some in combinations(own, k):
                if all(a[3] < b[2] or b[3] < a[2] for a, b in combinations(some, 2)):
                    best = max(best, sum(x[4] for x in some))
        chosen = [x for x in own if x[1] in {f for f, _ in got[s]}]
        assert {w for _, w in got[s]} == {best} and sum(x[4] for x in chosen) == best
        assert all(a[3] < b[2] or b[3] < a[2] for a, b in combinations(chosen, 2))
    assert S.heaviest_paths(spark.createDataFrame([], "scan_id long, fit long, lo double, hi double, score double")).collect() == []


def term(mz, y, snr, want, theory):
    accuracy = max(0.0, 1 - abs(mz - want) / 0.02)
    agree = 1 - (theory - y) / y if y < theory else max(0.0, 1 - (y - theory) / y) ** 0.5
    return 0.0 if snr < 1 else theory**0.5 * accuracy * max(agree, 0.0)


def plain_rounds(members, rounds):
    signal = {(s, n): y for s, _, n, _, _, _, _, y in members}
    live, out = {}, {}
    for s, f, n, want, mz, snr, w, _ in members:
        live.setdefault((s, f), []).append((n, want, mz, snr, w))
    for number in range(rounds):
        scored = {}
        for (s, f), own in list(live.items()):
            own = [m for m in own if signal[s, m[0]] > 1]
            total = sum(signal[s, m[0]] for m in own)
            score = round(sum(term(m[2], signal[s, m[0]], m[3], m[1], m[4] * total) for m in own) + 1e-9, 5)
            if len(own) > 1 and score > 0:
                live[s, f], scored[s, f] = own, (score, -f, total)
            else:
                del live[s, f]
        best = {}
        for (s, f), x in scored.items():
            for m in live[s, f]:
                best[s, m[0]] = max(best.get((s, m[0]), x), x)
        taken = [k for k, x in scored.items() if all(best[k[0], m[0]] == x for m in live[k])]
        for s, f in taken:
            score, _, total = scored[s, f]
            out[f] = (number, score, len(live[s, f]))
            for n, _, _, _, w in live.pop((s, f)):
                y, spent = signal[s, n], w * total
                signal[s, n] = 1.0 if y - spent < 0 or spent > 0.7 * y else round(y - spent, 6)
    return out


def test_subtraction_in_rounds_equals_a_plain_solver(spark):
    rng = random.Random(8)
    members = []
    for s in range(5):
        signal = {n: float(rng.randrange(50, 5000)) for n in range(18)}
        for f in range(14):
            first, weights = rng.randrange(14), [rng.random() + 0.05 for _ in range(4)]
            for k in sorted(rng.sample(range(4), rng.randrange(2, 5))):
                mz = 500.0 + first + k
                members.append((s, s * 100 + f, first + k, mz + rng.random() * 0.01, mz, 5.0 * (rng.random() > 0.05), weights[k] / sum(weights), signal[first + k]))
    df = spark.createDataFrame(members, "scan_id long, fit long, n long, want double, mz double, snr double, weight double, intensity double")
    got = {r.fit: (r["round"], r.score, r.n_peaks) for r in S.solve_with_subtraction(df, 10).collect()}
    want = plain_rounds(members, 10)
    assert got.keys() == want.keys() and max(k for k, *_ in want.values()) >= 2
    assert all(got[f][0] == want[f][0] and got[f][2] == want[f][2] and abs(got[f][1] - want[f][1]) < 1e-4 for f in want)


def test_product_scans_without_a_survey_are_deconvoluted_too(spark, tmp_path):
    import duckdb

    from massloom.catalog import ORACLE_SQL
    from massloom.catalog.dependence import deconvolute_product_scan

    # scans 1 and 2 come before the first survey, 5; that of scan 11, 10, has no peaks
    peaks = [(s, 10 * s + k, k, k + 1, 50.0 * (500 - 100 + k * 1.00335 / z), 10.0 - k, 0.05) for s, z in ((1, 1), (2, 2), (5, 2), (6, 2), (11, 2)) for k in range(3)]
    spark.createDataFrame(peaks, "l_suppkey long, l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_quantity double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(s, -1000.0) for s in (1, 2, 5, 6, 10, 11)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted(map(tuple, deconvolute_product_scan(spark, str(tmp_path)).collect()))
    assert {r[0] for r in got} == {1, 2, 6, 11} and {r[2] for r in got if r[0] == 2} == {2}
    con = duckdb.connect()
    for name in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(con.execute(ORACLE_SQL["deconvolute_product_scan"]).fetchall()) == got
