import numpy as np

from massloom.functions.mass import ISOTOPE_GAP, PROTON
from massloom.operators import isotopes, spectra


def test_pattern_of_an_average_peptide():
    x, p = isotopes.isotopic_cluster(isotopes.AVERAGINES["peptide"], 1000.0, 1)
    assert np.allclose(p, [0.587117, 0.314399, 0.098484], atol=2e-3)
    assert np.allclose(x, [1000, 1001.00294, 1002.005551], atol=2e-3)


def test_patterns_sum_to_one_and_glucose_mass():
    m, p = isotopes.isotopic_variants({"C": 6, "H": 12, "O": 6})
    assert abs(p.sum() - 1) < 1e-12 and abs(m[0] - 180.063388) < 1e-5


def planted(points):
    mz, y = [], []
    for first, z, total in points:
        x, p = isotopes.isotopic_cluster(isotopes.AVERAGINES["peptide"], first, z, 0.999)
        mz += list(x)
        y += list(p * total)
    return np.array(mz), np.array(y)


def test_planted_envelopes_are_found():
    mz, y = planted([(576.5, 3, 8e4), (862.1, 2, 15e4)])
    found = spectra.deconvolute_spectrum(mz, y, np.full(len(mz), 10.0))
    best = sorted(found, key=lambda f: -f[3])[:2]
    assert {(f[1], round(f[4], 1)) for f in best} == {(3, 576.5), (2, 862.1)}


def test_disjoint_and_bounded_signal():
    rng = np.random.default_rng(1)
    mz, y = np.sort(rng.uniform(300, 800, 400)), rng.uniform(10, 1e4, 400)
    found = spectra.deconvolute_spectrum(mz, y, np.full(400, 5.0), tolerance=1e-4)
    assert all(f[1] >= 1 and f[0] > 0 for f in found)


def test_picked_centroids():
    x = np.arange(0, 20, 0.01)
    y = 100 * np.exp(-((x - 7.003) ** 2) / (2 * 0.05**2)) + 50 * np.exp(-((x - 12) ** 2) / (2 * 0.05**2))
    got = spectra.pick_peaks(x, y)
    assert len(got) == 2 and abs(got[0][0] - 7.003) < 1e-3 and abs(got[0][1] - 100) < 0.5 and abs(got[0][2] - 0.1177) < 2e-3


def test_average_of_two_grids():
    grid, y = spectra.average_profiles([(np.array([0.0, 1, 2]), np.array([0.0, 2, 0])), (np.array([0.0, 2]), np.array([2.0, 2]))], 1.0)
    assert grid.tolist() == [0, 1, 2] and y.tolist() == [1, 2, 1]


def test_traces(spark):
    rows = [(k * 10 + t, 500.0 * (1 + k * 1e-3) * (1 + (t % 3 - 1) * 2e-6), float(t), 10.0) for k in range(4) for t in range(8)]
    df = spark.createDataFrame(rows, "id long, mz double, time double, intensity double")
    got = spectra.trace_features(df, 1e-5).collect()
    by = {}
    for r in got:
        by.setdefault((r.chain, r.feature), set()).add(r.id // 10)
    assert len(by) == 4 and all(len(v) == 1 for v in by.values())


def test_gap():
    assert abs(ISOTOPE_GAP - 1.00335) < 1e-4


def test_heavy_patterns_are_whole_up_to_the_truncation():
    for mass in (1000.0, 10_000.0, 17_000.0, 60_000.0):
        _, whole = isotopes.isotopic_variants(isotopes.scale_averagine(isotopes.AVERAGINES["peptide"], mass + PROTON), 400)
        p, kept = spectra.theories(np.array([mass / 8 + PROTON]), 8, 0.8, "peptide")
        n = int(np.searchsorted(np.cumsum(whole), 0.8)) + 1
        assert kept.sum() == n and np.allclose(p[0], whole[:n] / whole[:n].sum(), atol=1e-12)


def test_a_planted_heavy_ion_is_found_whole():
    unit, z, mass = isotopes.AVERAGINES["peptide"], 8, 14_000.0
    _, whole = isotopes.isotopic_variants(isotopes.scale_averagine(unit, mass + PROTON), 64)
    n = int(np.searchsorted(np.cumsum(whole), 0.8)) + 1
    mz, y = mass / z + PROTON + np.arange(n) * ISOTOPE_GAP / z, whole[:n] / whole[:n].sum() * 1e7
    found = spectra.deconvolute_spectrum(mz, y, np.full(n, 10.0))
    best = max(found, key=lambda f: f[3])
    assert n > 8 and best[1] == z and abs(best[0] - mass) < 0.01 and best[5] == n and abs(best[2] - 1e7) < 1


def test_heavy_patterns_end_where_truncation_says_and_averagines_differ():
    unit = isotopes.AVERAGINES["peptide"]
    x, p = isotopes.isotopic_cluster(unit, 3001.0, 20, 0.9999)
    assert len(x) > 40 and abs(p.sum() - 1) < 1e-9  # 60 kDa
    sulphated, plain = (isotopes.scale_averagine(isotopes.AVERAGINES[a], 2000.0) for a in ("heparan_sulfate", "heparin"))
    assert sulphated["S"] >= 2 * plain["S"]
