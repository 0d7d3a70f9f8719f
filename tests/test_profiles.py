import numpy as np

from massloom.operators import profiles as p

X = np.linspace(0, 10, 201)


def test_smoothing_levels():
    y = np.array([0.0, 3, 0, 0, 9])
    assert np.allclose(p.smooth(X[:5], y, 1), [1, 1, 1, 3, 3]) and np.allclose(p.sliding_median(y), [0, 0, 0, 0, 0])
    flat = p.gaussian_smooth(X, np.full(len(X), 2.0), 0.2)
    assert np.allclose(flat, 2)


def test_maxima_and_valleys():
    y = p.gaussian(X, (3, 0.5, 10)) + p.gaussian(X, (7, 0.5, 6))
    assert np.allclose(X[p.maxima(y, 1.0)], [3, 7]) and p.maxima(np.array([0, 2, 2, 1.0])).tolist() == [1]
    (k,) = p.valleys(X, y)
    assert 4.5 < X[k] < 5.6 and len(p.split_profile(X, y)) == 2
    assert not p.is_flat(X, y) and p.is_flat(X, np.full(len(X), 3.0) + 0.1 * np.sin(X))


def test_shapes_are_recovered():
    for kind, truth in (("gaussian", (4, 0.7, 20)), ("bigaussian", (4, 0.4, 1.1, 20)), ("skewed", (4, 10, 1.0, 1.5))):
        y = p.SHAPES[kind](X, np.array(truth))
        _, fitted = p.fit_shape(X, y, kind)
        assert p.line_test(X, y, fitted) < 1e-2, kind
    assert p.shape_score(X, p.bigaussian(X, (4, 0.4, 1.1, 20))) > 0.95
    assert p.shape_score(X[:3], X[:3]) == 0.5


def test_multimodal():
    y = p.gaussian(X, (3, 0.4, 10)) + p.gaussian(X, (7, 0.4, 8))
    centers = sorted(f[0] for f in p.multimodal_fit(X, y))
    assert len(centers) == 2 and abs(centers[0] - 3) < 0.2 and abs(centers[1] - 7) < 0.2


def test_reprofile_and_denoise():
    x, y = p.reprofile(np.array([100.0, 101.0]), np.array([5.0, 9.0]), np.array([0.1, 0.1]))
    assert abs(y.max() - 9) < 0.05 and abs(x[np.argmax(y)] - 101) < 0.01
    noise = np.full(200, 1.0)
    noise[100] = 500.0
    out = p.denoise(np.linspace(100, 110, 200), noise)
    assert out[100] > 400 and np.count_nonzero(out) == 1


def test_adaptive_fit_finds_planted_peaks_and_their_number():
    x = np.arange(0.0, 40.0, 0.5)
    one = 100 * np.exp(-((x - 17) ** 2) / (2 * np.where(x < 17, 2.0, 4.0) ** 2))
    two = 80 * np.exp(-((x - 10) ** 2) / 8) + 60 * np.exp(-((x - 27) ** 2) / 10)
    kind, _, test, centres = p.adaptive_fit(x, one, 0)
    assert len(centres) == 1 and abs(centres[0] - 17) < 0.5 and test < 0.01
    _, _, test, centres = p.adaptive_fit(x, two, 0)
    assert len(centres) == 2 and abs(centres[0] - 10) < 0.5 and abs(centres[1] - 27) < 0.5 and test < 0.01
    assert p.adaptive_fit(x[:4], two[:4]) == ("", "", 0.5, [])
    cut = p.splitting_fit(x, two, "gaussian", 3, 0)
    assert len(cut) == 2 and cut[0][0] == 0 and cut[0][1] == cut[1][0] and cut[1][1] == len(x)
    whole = p.splitting_fit(x, two, "gaussian", 0, 0)
    assert len(whole) == 1


def test_penalty_keeps_extreme_shapes_away():
    x = np.linspace(0.0, 10.0, 60)
    (center, _, sigma, gamma), _ = p.fit_shape(x, np.exp(-((x - 5) ** 2) / 2), "penalized")
    assert 0 < center < 10 and abs(sigma) < 3 and abs(gamma) < 40
