import math
import random
import re
from collections import Counter

import pytest

from massloom.llm import op13_search as o

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, best=10):
    held = [(d, terms(t)) for d, t in docs]
    n, total = sum(1 for _, w in held if w), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for d, w in held:
            if w:
                tf, m = Counter(w), 25 + 75 * len(w) * n // total
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms(text) if tf[t])
                if s > 0:
                    scores.append((-s, d))
        out += [(item, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scores)[:best])]
    return sorted(out)


@pytest.mark.parametrize("bucket", [7, 4096])
def test_same_ranks_as_brute_force(spark, bucket):
    rng = random.Random(9)
    words = [*[f"w{i}" for i in range(60)], "Ä", "ä", "漢字", "x1", "UPPER", "upper"]
    skewed = lambda n: [words[min(int(rng.expovariate(0.08)), len(words) - 1)] for _ in range(n)]
    docs = [(d, rng.choice([" ", "-", ", "]).join(skewed(rng.randrange(0, 60)))) for d in range(300)]
    docs += [(400 + k, docs[5][1]) for k in range(40)] + [(500, None), (501, "..."), (502, " ".join(skewed(5000)))]
    items = [(k, " ".join(skewed(rng.randrange(1, 20)))) for k in range(25)] + [(30, "nothing held here"), (31, ""), (32, None), (33, docs[5][1])]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for how in ({}, {"block_bytes": 400}):
        assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in o.search(d, i, bucket=bucket, **how).collect()) == want


def test_bounds_prune_and_lose_nothing(spark, monkeypatch):
    rng = random.Random(1)
    docs = [(d, " ".join(f"t{rng.randrange(400)}" for _ in range(30))) for d in range(3000)] + [(5000 + k, "a b c d e") for k in range(20)]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    i = spark.createDataFrame([(1, "a b c t1")], "item_id long, text string")
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in o.search(d, i, bucket=256).collect()) == brute(docs, [(1, "a b c t1")])
    import pyarrow as pa

    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array([9.0, 5.0, 4.0]), pa.array([[0, 1], [1], [2]], pa.list_(pa.int32())), pa.array([[8, 4], [5], [4]], pa.list_(pa.int64()))], ["doc_id", "norm", "terms", "impacts"])
    import numpy as np

    b = o.Bucket([batch])
    terms_, weights = np.array([0, 1, 2]), np.array([10, 10, 1])
    assert b.candidates(terms_, weights, 200).tolist() == []  # 10*8 + 10*5 + 4 < 200: the whole bucket
    assert b.candidates(terms_, weights, 60).tolist() == [0]  # coordinates 1 and 2 alone reach 54
    assert b.candidates(terms_, weights, 1).tolist() == [0, 1, 2]
    full = np.array([10, 10, 1])
    assert b.scores(np.array([0, 1, 2]), full).tolist() == [120, 50, 4]


def test_odd_rows(spark):
    docs = [(None, "alpha beta", 1), (1, "alpha beta", 2), (1, "alpha beta", 3), (2, None, 4), (3, "", 5), (4, "gamma", 6)]
    items = [(1, "Alpha", "a"), (1, "Alpha", "a"), (1, "gamma", "b"), (None, "beta", "c")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string, score int"), spark.createDataFrame(items, "item_id long, text string, rank string")
    got = [(r.item_id, r["rank"], r.doc_id) for r in o.search(d, i).orderBy("query", "rank").collect()]
    by = sorted((k or 0, r, x) for k, r, x in got if x is not None)
    assert by == sorted([(1, 2, 1), (1, 3, 1), (1, 1, 4), (0, 2, 1), (0, 3, 1)]) and sum(x is None for *_, x in got) == 2
    assert o.search(d.limit(0), i).collect() == [] and o.search(d, i.limit(0)).collect() == []
