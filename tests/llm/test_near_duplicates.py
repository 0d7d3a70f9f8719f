import random
import re

import pytest

from massloom.llm import op03_neardup
from massloom.llm.op03_neardup import drop_near_duplicates, near_duplicates


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(30)]
    rows, n = [], 0
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 25)):
                own[rng.randrange(len(own))] = rng.choice(words)
            if rng.random() < 0.3:
                own = own + passage
            rows.append((n, rng.choice([" ", "\n", "\t "]).join(own)))
            n += 1
    # chains: each near its neighbour only
    chain = [rng.choice(words) for _ in range(200)]
    for k in range(5):
        rows.append((n, " ".join(chain[k * 12 : k * 12 + 140])))
        n += 1
    for k in range(60):  # a large group of near copies, and short texts around one passage
        rows.append((n, " ".join([*chain[:100], f"tail{k}", *chain[100:150]])))
        rows.append((n + 1, " ".join([*passage, *[rng.choice(words) for _ in range(rng.randrange(1, 12))]])))
        n += 2
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("part", [2000, 3])
def test_components_match_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(op03_neardup, "LIST_PART", part)  # long lists dealt over parts
    rows = corpus(1)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, 5, 1), (2, "", 5, 1), (3, " \t\n ", 5, 1), (4, "One two", 5, 1), (5, "one TWO", 5, 1), (5, "one TWO", 5, 1), (6, "ÄÖ ßx", 5, 1), (7, "äö ßx", 5, 1), (None, "one two", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, v long")
    got = sorted(near_duplicates(df).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got] == [
        (None, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, None, False), (5, 1, None, False), (5, 1, None, False), (6, 1, 6, True), (7, 1, 7, True)
    ]
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 6, 7]
    assert near_duplicates(df.limit(0)).count() == 0


def test_repeated_id_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    got = near_duplicates(spark.createDataFrame([(1, a), (2, a), (2, b), (3, b)], "doc_id long, text string"))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(1, 1), (2, 1), (3, 1)}


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(None, text("a"), 1), (None, text("a"), 2), (None, text("b"), 3), (4, text("a") + " more", 4), (5, text("c"), 5), (5, text("c"), 6), (6, text("c"), 7), (6, text("d"), 8), (7, "", 9), (7, "", 10), (3, text("d"), 11)]
    kept = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    left = [r.n for r in kept.collect()]
    assert kept.columns == ["doc_id", "text", "n"] and len(left) == len(set(left)) == 6
    assert set(left) - {1, 2, 5, 6} == {3, 9, 10, 11} and len({1, 2} & set(left)) == len({5, 6} & set(left)) == 1
