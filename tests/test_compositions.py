import itertools
import random

import numpy as np

from massloom.operators import compositions as c
from massloom.operators.isotopes import AVERAGINES, isotopic_cluster, isotopic_variants


def test_known_compositions_are_found():
    glucose, other = {"C": 6, "H": 12, "O": 6}, {"C": 30, "H": 50, "O": 25, "N": 2}
    mz, y = [], []
    for comp, z, total in ((glucose, 1, 1e4), (other, 2, 5e4)):
        x, p = isotopic_variants(comp, 6, z)
        mz += list(x)
        y += list(p * total)
    got = c.fit_compositions(np.array(mz), np.array(y), [("glucose", glucose), ("other", other), ("absent", {"C": 50, "H": 80, "O": 10})])
    assert {(n, z) for n, z, *_ in got} == {("glucose", 1), ("other", 2)}


def test_features_form_series():
    x, p = isotopic_cluster(AVERAGINES["peptide"], 600.0, 2)
    k = len(x)
    mz, y = np.r_[x, 700.0], np.r_[p * 1e5, 1e3]
    got = c.deconvolute_features(mz, np.r_[np.zeros(k), 50], np.r_[np.full(k, 10.0), 60], y, lambda m: isotopic_cluster(AVERAGINES["peptide"], m + 1.00727646677, 1)[1])
    best = max(got, key=lambda f: f[5])
    assert best[1] == 2 and sorted(best[6]) == list(range(k)) and (best[2], best[3]) == (0, 10)


def test_exact_disjoint_choice():
    rng = random.Random(1)
    for _ in range(20):
        fits = [(rng.random() * 10, frozenset(rng.sample(range(8), rng.randrange(1, 4)))) for _ in range(9)]
        want = max(sum(fits[i][0] for i in s) for n in range(10) for s in itertools.combinations(range(9), n) if sum(len(fits[i][1]) for i in s) == len(frozenset().union(*[fits[i][1] for i in s])))
        got = c.best_disjoint(fits)
        assert abs(sum(fits[i][0] for i in got) - want) < 1e-9
    assert sorted(c.greedy_disjoint(fits)) == c.greedy_disjoint(fits) and c.greedy_disjoint(fits)


def test_table_of_scans(spark):
    x, p = isotopic_variants({"C": 6, "H": 12, "O": 6}, 4, 1)
    rows = [(1, float(m), float(i)) for m, i in zip(x, p * 1e4, strict=True)] + [(2, 100.0, 5.0)]
    got = c.deconvolute_compositions(spark.createDataFrame(rows, "scan_id long, mz double, intensity double"), [("glucose", {"C": 6, "H": 12, "O": 6})]).collect()
    assert [(r.scan_id, r.name, r.charge) for r in got] == [(1, "glucose", 1)]


def test_members_of_compositions_equal_a_search_of_every_spectrum(spark):
    rng = random.Random(2)
    known = [(f"c{k}", {"C": 6 * k, "H": 10 * k, "O": 5 * k}) for k in range(3, 9)]
    theory = c.composition_theory(known, (1, 2))
    rows = []
    for s in range(6):
        mz = sorted(x * (1 + rng.gauss(0, 2e-5)) for x in rng.sample([t[4] for t in theory], 14)) + [rng.random() * 900 + 100 for _ in range(10)]
        rows += [(s, n, x, 100.0, 5.0) for n, x in enumerate(sorted(mz))]
    got = {(r.scan_id, r.number, r.charge, r.n) for r in c.composition_members(spark.createDataFrame(rows, "scan_id long, n long, mz double, intensity double, snr double"), theory, 3e-5).collect()}
    want = set()
    for s in range(6):
        own = [(n, x) for t, n, x, *_ in rows if t == s]
        for number in range(len(known)):
            for z in (1, 2):
                hits = [min((abs(x - w), n) for n, x in own) + (w,) for a, _, b, _, w, _ in theory if (a, b) == (number, z)]
                hits = [n for off, n, w in hits if off <= w * 3e-5]
                want |= {(s, number, z, n) for n in hits} if len(hits) > 1 else set()
    assert got == want and want
    shares = {}
    for a, _, z, _, _, p in theory:
        shares[a, z] = shares.get((a, z), 0) + p
    assert all(abs(x - 1) < 1e-9 for x in shares.values())


def test_base_peaks_move_away_from_the_first_peak_with_mass():
    from massloom.operators import isotopes

    unit = isotopes.AVERAGINES["peptide"]
    offsets = isotopes.base_peak_offsets(unit, 6000.0)
    assert len(offsets) == 61 and offsets[:15] == [0] * 15 and offsets == sorted(offsets) and offsets[-1] >= 3
    for k in (20, 40, 60):  # largest of the whole pattern, not of a truncated one
        assert offsets[k] == int(np.argmax(isotopes.isotopic_cluster(unit, (k + 1) * 100.0, 1, 1.0)[1]))
