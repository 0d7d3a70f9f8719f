"""Greedy clusters of scans, in chains of masses of any length."""

import random
import sys

import pytest

from massloom.operators import leaders, spectra

TOLERANCE = 2e-3


def greedy(scans, similarity):
    """scan_id to (chain, cluster, similarity), one scan after the other."""
    chain, prev = {}, None
    for i, mass, *_ in sorted(scans, key=lambda s: (-s[1], s[0])):
        chain[i] = 0 if prev is None else chain[prev[0]] + ((prev[1] - mass) / mass > TOLERANCE)
        prev = i, mass
    out, heads = {}, {}
    for i, mass, _, bins, values in sorted(scans, key=lambda s: (-s[2], s[0])):
        v, best, held = dict(zip(bins, values, strict=True)), None, heads.setdefault(chain[i], [])
        norm = sum(x * x for x in v.values()) ** 0.5
        for number, (m, w, size) in enumerate(held):
            if abs(mass - m) <= m * TOLERANCE and norm and size:
                s = sum(x * w.get(b, 0.0) for b, x in v.items()) / (norm * size)
                if s > similarity and (best is None or (-s, number) < best):
                    best = -s, number
        if best is None:
            best = -1.0, len(held)
            held.append((mass, v, norm))
        out[i] = chain[i], best[1], -best[0]
    return out


def dense(n, seed):
    """Scans whose masses leave few gaps, with copies, and some without signal."""
    rng, made = random.Random(seed), []
    for i in rng.sample(range(10 * n), n):
        if made and rng.random() < 0.3:
            made.append((i, *rng.choice(made)[1:]))
        else:
            bins = sorted(rng.sample(range(12), rng.choice([3, 5])))
            values = [float(rng.randrange(1, 9)) if rng.random() < 0.98 else 0.0 for _ in bins]
            values = [0.0] * len(bins) if rng.random() < 0.03 else values
            made.append((i, 500 * 1.15 ** rng.random(), sum(values), bins, values))
    return made


SCHEMA = "scan_id long, mass double, tic double, bins array<long>, values array<double>"


def largest_groups(monkeypatch):
    """Keys by which rows with spectra were dealt out, as they are asked for."""
    from pyspark.sql.classic.dataframe import DataFrame

    asked, plain = [], DataFrame.repartition

    def repartition(self, *by):
        if "values" in self.columns:
            asked.append((self, by))
        return plain(self, *by)

    monkeypatch.setattr(DataFrame, "repartition", repartition)
    return asked


@pytest.mark.parametrize("similarity", [0.3, 0.7])
def test_a_long_chain_has_the_clusters_of_one_scan_after_the_other_and_no_task_holds_it(spark, monkeypatch, similarity):
    monkeypatch.setattr(leaders, "LONG", 20)
    asked = largest_groups(monkeypatch)
    scans = dense(700, 5)
    got = {r.scan_id: (r.chain, r.cluster, r.similarity) for r in spectra.cluster_scans(spark.createDataFrame(scans, SCHEMA), TOLERANCE, similarity).collect()}
    want = greedy(scans, similarity)
    assert got == want
    chains = [c for c, *_ in want.values()]
    most = max(df.groupBy(*by).count().agg({"count": "max"}).first()[0] for df, by in asked[-1:] if by)
    assert most < max(map(chains.count, chains)) / 4


def test_chains_are_found_without_the_spectra(spark, monkeypatch):
    from massloom.operators import ordered

    seen, plain = [], ordered.materialize
    monkeypatch.setattr(ordered, "materialize", lambda df, tag="step": seen.append(df.columns) or plain(df, tag))
    scans = dense(60, 6)
    got = {r.scan_id: (r.chain, r.cluster, r.similarity) for r in spectra.cluster_scans(spark.createDataFrame(scans, SCHEMA), TOLERANCE, 0.5).collect()}
    assert got == greedy(scans, 0.5)
    assert seen and not any("values" in c for c in seen)


def test_a_group_of_one_mass_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(leaders, "LONG", 20)
    asked = largest_groups(monkeypatch)
    scans = [(i, 700.0, float(i % 7), [1 + i % 3], [5.0]) for i in range(300)]
    got = {r.scan_id: (r.chain, r.cluster, r.similarity) for r in spectra.cluster_scans(spark.createDataFrame(scans, SCHEMA), TOLERANCE, 0.5).collect()}
    assert got == greedy(scans, 0.5)
    df, by = asked[-1]
    assert df.groupBy(*by).count().agg({"count": "max"}).first()[0] < 60


def test_odd_masses_and_no_tolerance_in_cells(spark, monkeypatch):
    monkeypatch.setattr(leaders, "LONG", 5)
    scans = [(i, [500.0, 500.5, -3.0, 501.0][i % 4], float(i % 5), [1, 2], [float(i % 3), 1.0]) for i in range(40)]
    for tolerance in (TOLERANCE, 0.0):
        monkeypatch.setattr(sys.modules[__name__], "TOLERANCE", tolerance)
        got = {r.scan_id: (r.chain, r.cluster, r.similarity) for r in spectra.cluster_scans(spark.createDataFrame(scans, SCHEMA), tolerance, 0.9).collect()}
        assert got == greedy(scans, 0.9)
