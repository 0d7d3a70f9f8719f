import hashlib
import random
import re

import pytest

from massloom.llm import op08_substrings as o


def brute(rows, window):
    docs = sorted((d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows)
    seen, out = set(), []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone |= set(range(i, i + window))
            seen.add(k)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def run(df, **how):
    scanned, changed = o.dedup_substrings(df, **how)
    new = {(r.doc_id, r.h): r for r in changed.collect()}
    out = []
    for r in scanned.collect():
        c = new.get((r.doc_id, r.h))
        out.append((r.doc_id, r.n_words, c.n_removed if c else 0, hashlib.sha256(c.kept_text.encode()).hexdigest() if c else r.sha))
    return sorted(out)


@pytest.mark.parametrize("hot", [2000, 3])
def test_same_words_removed_as_brute_force(spark, hot):
    rng = random.Random(2)
    words = ["a", "b", "ä", "漢", *[f"w{i}" for i in range(300)]]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for d in range(60):
        w = [rng.choice(words) for _ in range(rng.randrange(0, 90))]
        if d % 3 == 0:
            k = rng.randrange(0, 20)
            w = w[:20] + passage[k : k + 35] + w[20:]
        if d % 7 == 0:
            w = w + w
        if d % 11 == 0:
            w = ["x"] * 50
        rows.append((d, rng.choice([" ", "\n", " \t"]).join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert run(df, hot=hot) == brute(rows, 20)


def test_nulls_repeats_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(2, long, 1), (1, long, 1), (1, long, 1), (3, None, 1), (4, "", 1), (None, "a b", 1), (5, " ".join(["r"] * 25), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h int")
    got = {(d, n, gone) for d, n, gone, _ in run(df)}
    # the second of two equal starts onwards goes: words 1..24 of a run of 25
    assert got == {(1, 30, 0), (2, 30, 30), (3, 0, 0), (4, 0, 0), (o.NO_ID, 2, 0), (5, 25, 24)}
    assert run(df.limit(0)) == []


def test_one_id_with_two_texts(spark):
    long = " ".join(f"w{i}" for i in range(30))
    got = run(spark.createDataFrame([(1, long), (1, "x " + long)], "doc_id long, text string"))
    assert sorted(n for _, _, n, _ in got) == [0, 30]


def test_one_string_in_very_many_places_is_split_over_tasks(spark):
    """What meets the earliest place of a string that all documents share goes by broadcast, at any size of a bucket."""
    long = " ".join(f"w{i}" for i in range(24))
    rows = [(k, long) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    for hot in (10, 1000, 100_000):
        got = run(df, hot=hot)
        assert got == [(k, 24, 24 if k else 0, *g[3:]) for (k, *_), g in zip(rows, got, strict=True)]
