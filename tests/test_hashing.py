"""Vector search: recall of hashing against brute force, exactness of the blocks."""

import os

import numpy as np
import pytest

from massloom.catalog import clusters
from massloom.operators import hashing as H


def test_blocks_equal_brute_force_and_hashing_reaches_its_recall(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 24))
    v[200:] = v[:200] + 0.9 * rng.standard_normal((200, 24))  # like the first 200, more or less
    v[7] = 0
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None)], "id long, v array<double>").repartition(3)
    queries = rows.filter("id % 5 = 0")
    unit = v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)
    s = unit @ unit.T
    want = {(a, b) for a in range(0, 400, 5) for b in range(400) if a != b and s[a, b] >= 0.5}
    for size in (H.BLOCK_BYTES, 2000):
        assert {(r.a, r.b) for r in H.block_search(queries, rows, 0.5, size).collect()} == want
    for bits in (4, 8):
        got = {(r.a, r.b) for r in H.hashed_search(queries, rows, 0.5, bits, 0.95).collect()}
        assert got <= want and len(got) >= 0.9 * len(want)
    assert H.block_search(queries.limit(0), rows, 0.5).collect() == [] and H.hashed_search(queries, rows.limit(0), 0.5).collect() == []


def test_hashed_pairs_are_those_of_a_shared_bucket_and_nothing_is_shuffled(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((300, 16))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(3)
    queries, bits, like = rows.filter("id % 4 = 0"), 3, 0.3
    tables = H.tables_needed(like, bits, 0.5)
    codes = H.sign_codes(v, H.planes_of(16, tables, bits), tables, bits)
    norm = np.sqrt((v * v).sum(axis=1))
    want = {(a, b) for a in range(0, 300, 4) for b in range(300) if a != b and v[a] @ v[b] / norm[a] / norm[b] >= like and (codes[a] == codes[b]).any()}
    for size in (3000, H.BLOCK_BYTES):
        found = H.hashed_search(queries, rows, like, bits, 0.5, size)
        assert {(r.a, r.b) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning" not in plan


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_recall_on_the_given_vectors(spark):
    d = "/root/testdata/sf0.01"
    exact = {(r.a, r.b) for r in clusters.similar_pairs(spark, d).collect()}
    found = {(r.a, r.b) for r in clusters.lsh_similar_pairs(spark, d).collect()}
    assert found <= exact and len(found) >= 0.9 * len(exact)
