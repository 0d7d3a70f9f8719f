"""Isotopic patterns of elemental compositions by convolution over neutron counts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from massloom.functions.mass import PROTON

# fixed values: (mass, natural abundance) of the stable isotopes, the lightest first
ISOTOPES = {
    "C": [(12.0, 0.9893), (13.0033548378, 0.0107)],
    "H": [(1.00782503207, 0.999885), (2.0141017778, 0.000115)],
    "N": [(14.0030740048, 0.99636), (15.0001088982, 0.00364)],
    "O": [(15.99491461956, 0.99757), (16.9991317, 0.00038), (17.9991610, 0.00205)],
    "S": [(31.97207100, 0.9499), (32.97145876, 0.0075), (33.96786690, 0.0425), (34.96903208, 0.0), (35.96708076, 0.0001)],
    "P": [(30.97376163, 1.0)],
}
# fixed values: average compositions of one residue
AVERAGINES = {
    "peptide": {"C": 4.9384, "H": 7.7583, "N": 1.3577, "O": 1.4773, "S": 0.0417},
    "glycan": {"C": 7.0, "H": 11.8333, "N": 0.5, "O": 5.16666},
    "glycopeptide": {"C": 10.93, "H": 15.75, "N": 1.6577, "O": 6.4773, "S": 0.02054},
    "heparin": {"H": 10.5, "C": 6.0, "S": 0.5, "O": 5.5, "N": 0.5},
    "heparan_sulfate": {"H": 10.667, "C": 6.0, "S": 1.333, "O": 9.0, "N": 0.667},
    "permethylated_glycan": {"C": 12.0, "H": 21.8333, "N": 0.5, "O": 5.16666},
}


def monoisotopic_mass(composition: dict[str, float]) -> float:
    return sum(n * ISOTOPES[a][0][0] for a, n in composition.items())


def power(p: np.ndarray, m: np.ndarray, n: int, peaks: int) -> tuple[np.ndarray, np.ndarray]:
    """Abundances and mean extra masses, by neutron count, of ``n`` atoms; repeated squaring."""
    out_p, out_m = np.zeros(peaks), np.zeros(peaks)
    out_p[0] = 1.0
    while n:
        if n & 1:
            out_p, out_m = combine(out_p, out_m, p, m, peaks)
        p, m = combine(p, m, p, m, peaks)
        n >>= 1
    return out_p, out_m


def combine(p: np.ndarray, m: np.ndarray, q: np.ndarray, k: np.ndarray, peaks: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.convolve(p, q)[:peaks]
    mass = (np.convolve(p * m, q) + np.convolve(p, q * k))[:peaks]
    return both, np.divide(mass, both, out=np.zeros_like(mass), where=both > 0)


def isotopic_variants(composition: dict[str, int], peaks: int = 16, charge: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(m/z or mass, relative abundance) of the first ``peaks`` isotopic peaks; charge 0 gives masses."""
    p, m = np.zeros(peaks), np.zeros(peaks)
    p[0] = 1.0
    for atom, n in composition.items():
        base = ISOTOPES[atom][0][0]
        q, k = np.zeros(peaks), np.zeros(peaks)
        for j, (mass, share) in enumerate(ISOTOPES[atom][:peaks]):
            q[j], k[j] = share, mass - base
        q, k = power(q, k, int(n), peaks)
        p, m = combine(p, m, q, k, peaks)
    mass = monoisotopic_mass(composition) + m
    if charge:
        mass = (mass + charge * PROTON) / abs(charge)
    return mass, p / p.sum()


def scale_averagine(unit: dict[str, float], mz: float, charge: int = 1) -> dict[str, int]:
    """Whole atom counts of an averagine at an m/z: rounded half to even, hydrogens take up the rest (0 at least)."""
    mass = mz * abs(charge) - charge * PROTON
    f = mass / monoisotopic_mass(unit)
    out = {a: round(n * f) for a, n in unit.items()}
    out["H"] = max(0, out["H"] + round(mass - monoisotopic_mass(out)))
    return {a: n for a, n in out.items() if n > 0}


def isotopic_cluster(unit: dict[str, float], mz: float, charge: int = 1, truncate_after: float = 0.95, ignore_below: float = 0.0, pattern: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pattern of an averagine with its first peak at ``mz``, truncated and normalised; truncation alone decides where it ends.

    ``pattern`` is :func:`truncated_pattern` or one that keeps what it has
    made: a pattern depends on whole atom counts, of which masses share many.
    """
    offsets, p = (pattern or truncated_pattern)(tuple(scale_averagine(unit, mz, charge).items()), charge, truncate_after, ignore_below)
    return offsets + mz, p


def truncated_pattern(composition: tuple[tuple[str, int], ...], charge: int, truncate_after: float, ignore_below: float) -> tuple[np.ndarray, np.ndarray]:
    """(distance from the first peak, abundance) of a composition's peaks."""
    x, p = isotopic_variants(dict(composition), peaks_of(dict(composition)), charge)
    keep = np.concatenate([[0.0], np.cumsum(p)[:-1]]) < truncate_after
    x, p = x[keep], p[keep] / p[keep].sum()
    low = (p >= ignore_below) | (np.arange(len(p)) < 2)
    x, p = x[low], p[low] / p[low].sum()
    return x - x[0], p


def peaks_of(composition: dict[str, int]) -> int:
    """Isotopic peaks up to twelve standard deviations above the mean neutron count."""
    # (neutrons, share) of each isotope of each atom
    extra = [(n, [(round(m - ISOTOPES[a][0][0]), s) for m, s in ISOTOPES[a]]) for a, n in composition.items()]
    mean = sum(n * sum(k * s for k, s in x) for n, x in extra)
    spread = sum(n * (sum(k * k * s for k, s in x) - sum(k * s for k, s in x) ** 2) for n, x in extra)
    return int(mean + 12 * spread**0.5) + 12


def base_peak_offsets(unit: dict[str, float], max_mass: float, step: float = 100.0) -> list[int]:
    """Neutrons from the first peak of a pattern to its largest, for each bin of masses: bin k stands for (k + 1) * step."""
    return [int(np.argmax(isotopic_cluster(unit, (k + 1) * step, 1, 0.999)[1])) for k in range(int(max_mass // step) + 1)]


def whole_pattern(unit: dict[str, float], mass: float) -> np.ndarray:
    """Abundances of all isotopic peaks at a mass."""
    composition = scale_averagine(unit, mass + PROTON, 1)
    return isotopic_variants(composition, peaks_of(composition))[1]
