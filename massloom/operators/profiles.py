"""Chromatographic profiles: smoothing, splitting at valleys, shape fits."""

from __future__ import annotations

from collections.abc import Callable, Generator

import numpy as np


def sliding_mean(y: np.ndarray) -> np.ndarray:
    """Three-point mean, zero outside."""
    p = np.concatenate([[0.0], y, [0.0]])
    return (p[:-2] + p[1:-1] + p[2:]) / 3


def sliding_median(y: np.ndarray) -> np.ndarray:
    """Three-point median, zero outside."""
    p = np.concatenate([[0.0], y, [0.0]])
    return np.median(np.stack([p[:-2], p[1:-1], p[2:]]), axis=0)


def gaussian_smooth(x: np.ndarray, y: np.ndarray, width: float = 0.05) -> np.ndarray:
    """Weighted mean of the points within ``width``: a Gaussian around the mean of their positions, of their own variance.

    The window runs from the last point at or before its lower edge up to, not
    including, the last one at or before its upper edge; a window of one point
    leaves the value as it is.
    """
    edge = lambda at: np.maximum(np.searchsorted(x, at, "right") - 1, 0)
    out = np.array(y, dtype=float)
    for i, (lo, hi) in enumerate(zip(edge(x - width), edge(x + width), strict=True)):
        if hi - lo > 1:
            off = x[lo:hi] - x[lo:hi].mean()
            w = np.exp(-(off**2) / (2 * off.var()))
            out[i] = (w * y[lo:hi]).sum() / w.sum()
    return out


def smooth(x: np.ndarray, y: np.ndarray, level: float = 0) -> np.ndarray:
    """0 none, 1 mean, 2 mean of medians, 3 Gaussian of 0.05, else Gaussian of that width."""
    if level == 0:
        return y
    if level == 1:
        return sliding_mean(y)
    if level == 2:
        return sliding_mean(sliding_median(y))
    return gaussian_smooth(x, y, 0.05 if level == 3 else level)


def maxima(y: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Indices of local maxima; a plateau counts once, at its start."""
    keep = np.concatenate([[True], y[1:] != y[:-1]])
    at = np.flatnonzero(keep)
    z = y[at]
    before, after = np.concatenate([[-np.inf], z[:-1]]), np.concatenate([z[1:], [-np.inf]])
    return at[(z > before) & (z > after) & (z >= least)]


def valleys(x: np.ndarray, y: np.ndarray, scale: float = 0.3, level: float = 1) -> list[int]:
    """Indices of the lowest points between neighbouring maxima that lie below ``scale`` of the lower one, the deepest first."""
    s = smooth(x, y, level)
    tops = maxima(s)
    out = []
    for a, b in zip(tops[:-1], tops[1:], strict=True):
        k = int(a + np.argmin(s[a : b + 1]))
        floor = min(s[a], s[b])
        if floor > 0 and s[k] / floor < scale:
            out.append((floor - s[k], k))
    return [k for _, k in sorted(out, reverse=True)]


def split_profile(x: np.ndarray, y: np.ndarray, scale: float = 0.3, level: float = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """The profile cut at every valley."""
    cuts = sorted(valleys(x, y, scale, level))
    edges = [0, *cuts, len(x)]
    return [(x[a:b], y[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def is_flat(x: np.ndarray, y: np.ndarray, fraction: float = 0.5, level: float = 1) -> bool:
    """Whether both ends stay above a fraction of the smoothed apex."""
    s = smooth(x, y, level)
    return bool(s[0] > fraction * s.max() and s[-1] > fraction * s.max())


def gaussian(x, p):
    center, sigma, height = p
    return height * np.exp(-((x - center) ** 2) / (2 * sigma**2))


def bigaussian(x, p):
    center, left, right, height = p
    return height * np.exp(-((x - center) ** 2) / (2 * np.where(x < center, left, right) ** 2))


def skewed_gaussian(x, p):
    center, height, sigma, gamma = p
    z = gamma * (x - center) / (sigma * np.sqrt(2))
    # error function by the rational form 7.1.26 of Abramowitz and Stegun
    t = 1 / (1 + 0.3275911 * np.abs(z))
    erf = np.sign(z) * (1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-(z**2)))
    return height * np.exp(-((x - center) ** 2) / (2 * sigma**2)) * (1 + erf)


def guess(kind: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    k = int(np.argmax(y))
    w = max(float(np.sqrt((y * (x - x[k]) ** 2).sum() / max(y.sum(), 1e-12))), float(np.diff(x).mean()) if len(x) > 1 else 1e-3)
    return np.array({"gaussian": [x[k], w, y[k]], "bigaussian": [x[k], w, w, y[k]], "skewed": [x[k], y[k], w, 0.1]}[kind])


def penalized_gaussian(x, p):
    """The skewed Gaussian, put off where its width, its skew or its centre is extreme for the data."""
    center, _, sigma, gamma = p
    wide = np.where(np.abs(sigma) > 2, sigma / 2, 1.0)
    bent = np.where(np.abs(gamma) > 40, gamma / 2, 1.0)
    away = np.where((x[0] <= center) & (center <= x[-1]), 1.0, center)
    return skewed_gaussian(x, p) * wide * bent * away


#: What is fitted, and what a fit is drawn with.
SHAPES = {"gaussian": gaussian, "bigaussian": bigaussian, "skewed": skewed_gaussian, "penalized": penalized_gaussian}
DRAWN = SHAPES | {"penalized": skewed_gaussian}


def fit_shape(x: np.ndarray, y: np.ndarray, kind: str = "bigaussian", steps: int = 100, gain: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(parameters, fitted values) by damped least squares with a numerical Jacobian; fewer points than parameters keep the first guess."""
    (p,) = fit_shapes([(x, y, kind, steps, gain)])
    return p, DRAWN[kind](x, p)


#: Fits are made side by side where they have the same shape, steps and gain and lengths of one bucket so wide.
BUCKET, TOGETHER = 8, 2048


def fit_shapes(asked: list[tuple[np.ndarray, np.ndarray, str, int, float]]) -> list[np.ndarray]:
    """The parameters of many fits (x, y, kind, steps, gain); each is what it is alone."""
    out: list = [None] * len(asked)
    alike: dict = {}
    for i, (x, y, kind, steps, gain) in enumerate(asked):
        first = guess("skewed" if kind == "penalized" else kind, x, y)
        if len(first) > len(x):
            out[i] = first
        else:
            alike.setdefault((kind, steps, gain, -(-len(x) // BUCKET)), []).append((i, x, y, first))
    for (kind, steps, gain, _), members in alike.items():
        for a in range(0, len(members), TOGETHER):
            part = members[a : a + TOGETHER]
            for (i, *_), p in zip(part, damped_fits([m[1] for m in part], [m[2] for m in part], np.array([m[3] for m in part]), SHAPES[kind], steps, gain), strict=True):
                out[i] = p
    return out


def damped_fits(xs: list[np.ndarray], ys: list[np.ndarray], p: np.ndarray, shape: Callable, steps: int, gain: float) -> np.ndarray:
    """Parameters of fits that begin at the rows of ``p``, all a step at a time; one that has ended is left out of further steps.

    Profiles are filled up to one length by their last point, which then counts nothing.
    """
    width = max(map(len, xs))
    x, y, counts = (np.zeros((len(xs), width)) for _ in range(3))
    for i, (u, v) in enumerate(zip(xs, ys, strict=True)):
        x[i, : len(u)], x[i, len(u) :], y[i, : len(u)], counts[i, : len(u)] = u, u[-1], v, 1.0
    n, k = p.shape
    draw = lambda rows, q: shape(x[rows].T, q.T).T
    p, damp, live = p.copy(), np.full(n, 1e-2), np.arange(n)
    r = np.where(counts[live] > 0, y - draw(live, p), 0.0)
    cost = np.einsum("ij,ij->i", r, r)
    for _ in range(steps):
        if not len(live):
            break
        base, jac = draw(live, p[live]), np.empty((len(live), width, k))
        for j in range(k):
            h = 1e-6 * np.maximum(1e-3, np.abs(p[live, j]))
            q = p[live].copy()
            q[:, j] += h
            jac[:, :, j] = np.where(counts[live] > 0, (draw(live, q) - base) / h[:, None], 0.0)
        back = jac.transpose(0, 2, 1)
        a = back @ jac
        at = np.arange(k)
        diagonal = a[:, at, at]
        a[:, at, at] += damp[live, None] * (diagonal + 1e-12)
        step = np.zeros((len(live), k))
        sound = np.isfinite(a).all(axis=(1, 2))
        step[sound] = (np.linalg.pinv(a[sound], rcond=np.finfo(float).eps * k) @ (back[sound] @ r[live[sound], :, None]))[:, :, 0]
        new = np.where(counts[live] > 0, y[live] - draw(live, p[live] + step), 0.0)
        left = np.einsum("ij,ij->i", new, new)
        better = sound & np.isfinite(new).all(axis=1) & (left < cost[live])
        won, lost = live[better], live[~better]
        done = cost[won] - left[better] < gain * cost[won]
        p[won] += step[better]
        r[won], cost[won] = new[better], left[better]
        damp[won] /= 3
        damp[lost] *= 4
        live = np.concatenate([won[~done], lost[damp[lost] <= 1e10]])
    return p


def side_by_side(tasks: list[Generator]) -> list:
    """What each generator returns, where each asks for lists of fits and is sent their parameters: the fits that all of them ask for are made together."""
    out: list = [None] * len(tasks)
    sent: dict = dict.fromkeys(range(len(tasks)))
    while sent:
        asked = {}
        for i, p in sent.items():
            try:
                asked[i] = tasks[i].send(p)
            except StopIteration as end:
                out[i] = end.value
        fits = iter(fit_shapes([f for a in asked.values() for f in a]))
        sent = {i: [next(fits) for _ in a] for i, a in asked.items()}
    return out


def line_test(x: np.ndarray, y: np.ndarray, fitted: np.ndarray) -> float:
    """Residuals of the shape over the residuals of a straight line; 0 is a perfect shape, 1 no better than a line."""
    slope, icpt = np.polyfit(x, y, 1)
    line = ((y - slope * x - icpt) ** 2).sum()
    return float(((y - fitted) ** 2).sum() / line) if line > 0 else 1.0


def shape_score(x: np.ndarray, y: np.ndarray, kind: str = "bigaussian", level: float = 0.15) -> float:
    """One less the line test of a fitted shape; under five points 0.5."""
    if len(x) < 5:
        return 0.5
    s = smooth(x, y, level)
    _, fitted = fit_shape(x, s, kind)
    return 1 - min(1.0, line_test(x, s, fitted))


def shape_scores(profiles: list[tuple[np.ndarray, np.ndarray]], kind: str = "bigaussian", level: float = 0.15) -> list[float]:
    """:func:`shape_score` of many profiles (x, y), fitted side by side."""
    ask = [(x, smooth(x, y, level), kind, 100, 1e-10) for x, y in profiles if len(x) >= 5]
    fits = zip(ask, fit_shapes(ask), strict=True)
    tests = iter([line_test(x, s, DRAWN[kind](x, p)) for (x, s, *_), p in fits])
    return [1 - min(1.0, next(tests)) if len(x) >= 5 else 0.5 for x, _ in profiles]


def multimodal_fit(x: np.ndarray, y: np.ndarray, most: int = 5, relative: float = 0.5, kind: str = "bigaussian", steps: int = 100, gain: float = 1e-10) -> list[np.ndarray]:
    """Fit the highest peak between its valleys, subtract it and go on with what is left, while that is high enough."""
    return side_by_side([subtracting(x, y, most, relative, kind, steps, gain)])[0]


def subtracting(x: np.ndarray, y: np.ndarray, most: int, relative: float, kind: str, steps: int, gain: float) -> Generator:
    """:func:`multimodal_fit`, asking for its fits."""
    out, rest, top = [], y.astype(float).copy(), float(y.max())
    while len(out) < most and rest.max() > relative * top:
        k, falls = int(np.argmax(rest)), np.diff(rest)
        left = np.flatnonzero(falls[:k] <= 0)
        right = np.flatnonzero(falls[k:] >= 0)
        a, b = (int(left[-1]) + 1 if len(left) else 0), (k + int(right[0]) + 1 if len(right) else len(x))
        if b - a < 5:
            break
        (p,) = yield [(x[a:b], rest[a:b], kind, steps, gain)]
        out.append(p)
        rest = np.maximum(rest - DRAWN[kind](x, p), 0)
        rest[a:b] = 0
    return out


def splitting_fit(x: np.ndarray, y: np.ndarray, kind: str = "bigaussian", most: int = 3, level: float = 1) -> list[tuple[int, int, np.ndarray]]:
    """(from, to, parameters) of the pieces of a profile, cut at its deepest valleys and fitted each for itself.

    A piece is cut again, ``most`` times at the most, while its two parts leave
    smaller squared residuals than it does as a whole.
    """
    return side_by_side([cutting(x, y, kind, most, level)])[0]


def cutting(x: np.ndarray, y: np.ndarray, kind: str, most: int, level: float) -> Generator:
    """:func:`splitting_fit`, asking for its fits."""

    def residual(a: int, b: int, p: np.ndarray) -> float:
        return float(((y[a:b] - DRAWN[kind](x[a:b], p)) ** 2).sum())

    quick = lambda a, b: (x[a:b], y[a:b], kind, 30, 1e-4)
    (whole,) = yield [quick(0, len(x))]
    done, todo = [], [(0, len(x), whole)]
    while todo:
        a, b, p = todo.pop()
        cuts = valleys(x[a:b], y[a:b], 0.99, level) if b - a >= 6 and most else []
        if cuts and 0 < cuts[0] < b - a - 1:
            k = a + cuts[0] + 1
            left, right = yield [quick(a, k), quick(k, b)]
            parts = [(a, k, left), (k, b, right)]
            if sum(residual(*part) for part in parts) < residual(a, b, p):
                todo += parts
                most -= 1
                continue
        done.append((a, b, p))
    return sorted(done, key=lambda f: f[0])


def adaptive_fit(x: np.ndarray, y: np.ndarray, level: float = 0.15, kinds: tuple[str, ...] = ("bigaussian", "penalized"), most: int = 3) -> tuple[str, str, float, list[float]]:
    """(shape, way, line test, centres): of each shape, by cutting and by subtracting, the fit that leaves least beside a straight line.

    Under five points nothing is fitted and the line test is 0.5.
    """
    return adaptive_fits([(x, y)], level, kinds, most)[0]


def adaptive_fits(profiles: list[tuple[np.ndarray, np.ndarray]], level: float = 0.15, kinds: tuple[str, ...] = ("bigaussian", "penalized"), most: int = 3) -> list[tuple[str, str, float, list[float]]]:
    """:func:`adaptive_fit` of many profiles (x, y), fitted side by side."""
    ways, tasks = [], []
    smoothed = [(x, smooth(x, y, level)) for x, y in profiles]
    for i, (x, s) in enumerate(smoothed):
        for order, kind in enumerate(kinds if len(x) >= 5 else ()):
            ways += [(i, order, kind, "cut"), (i, order, kind, "subtract")]
            tasks += [cutting(x, s, kind, most, 0), subtracting(x, s, most + 1, 0.5, kind, 30, 1e-4)]
    found: list[list] = [[] for _ in profiles]
    for (i, order, kind, way), parts in zip(ways, side_by_side(tasks), strict=True):
        x, s = smoothed[i]
        if way == "cut":
            drawn = np.concatenate([DRAWN[kind](x[a:b], p) for a, b, p in parts])
            parts = [p for _, _, p in parts]
        elif parts:
            drawn = sum(DRAWN[kind](x, p) for p in parts)
        else:
            continue
        found[i].append((round(line_test(x, s, drawn), 9), order, int(way == "subtract"), kind, way, parts))
    best = [min(f, key=lambda f: f[:3]) if f else (0.5, 0, 0, "", "", []) for f in found]
    return [(kind, way, test, sorted(float(p[0]) for p in parts)) for test, _, _, kind, way, parts in best]


def reprofile(mz: np.ndarray, intensity: np.ndarray, fwhm: np.ndarray, dx: float = 0.005) -> tuple[np.ndarray, np.ndarray]:
    """Centroids back to a profile: a Gaussian for each on a common grid."""
    if not len(mz):
        return np.zeros(0), np.zeros(0)
    grid = np.arange(mz.min() - 1, mz.max() + 1 + dx / 2, dx)
    out = np.zeros(len(grid))
    for m, h, w in zip(mz, intensity, fwhm, strict=True):
        s = w / 2.3548200450309493
        a, b = np.searchsorted(grid, m - 5 * s), np.searchsorted(grid, m + 5 * s)
        out[a:b] += h * np.exp(-((grid[a:b] - m) ** 2) / (2 * s * s))
    return grid, out


def denoise(mz: np.ndarray, intensity: np.ndarray, scale: float = 5.0, window: float = 2.0) -> np.ndarray:
    """Subtract ``scale`` times the local median of the lower half of the signal; nothing below 0 stays."""
    lo, hi = np.searchsorted(mz, mz - window / 2, "left"), np.searchsorted(mz, mz + window / 2, "right")
    base = np.array([np.median(np.sort(intensity[a:b])[: max(1, (b - a) // 2)]) for a, b in zip(lo, hi, strict=True)])
    return np.maximum(intensity - scale * base, 0.0)
