import random

from massloom.llm.op09_decontaminate import drop_contaminated, find_contained
from tests.llm.test_near_duplicates import shingles


def rows_of(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, text(n)) for i, n in enumerate([1, 3, 5, 6, 20, 40, 80, 80])]
    docs = []
    for d in range(80):
        w = text(rng.randrange(0, 150))
        if d % 2:
            own = list(rng.choice(items)[1])
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            w[10:10] = own
        docs.append((d, " ".join(w)))
    return docs, [(i, " ".join(w).upper()) for i, w in items]


def test_same_pairs_as_brute_force(spark):
    docs, items = rows_of(3)
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in docs:
        words = t.lower().split()
        held = shingles(t) | {tuple(words[i : i + n]) for n in (1, 3) for i in range(len(words) - n + 1)}  # items of one and three words
        for i, u in items:
            own = shingles(u)
            if own and len(own & held) >= 0.75 * len(own):
                want.add((d, i, len(own), len(own & held)))
    assert want
    for block in (1 << 24, 300):  # one block, and several
        got = find_contained(a, b, block_bytes=block).collect()
        assert {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in got} == want and len(got) == len(want)
    clean = drop_contaminated(a, b)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, *_ in want}


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "a b c d e f", 3), (3, "a b c d e f", 4), (3, "a b c d e f", 4)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, "A b c d e", "x"), (7, "A b c d e", "y"), (8, None, "z"), (9, " ", "z"), (None, "b c d e f", "q")], "item_id long, text string, doc_id string")
    got = sorted(((r.doc_id, r.item_id) for r in find_contained(docs, items).collect()), key=repr)
    assert got == sorted([(None, 7), (None, None), (3, 7), (3, None), (3, 7), (3, None)], key=repr)
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert find_contained(docs.limit(0), items).count() == 0 and find_contained(docs, items.limit(0)).count() == 0


def test_rows_that_share_an_id_are_judged_each_for_itself(spark):
    docs = [(None, "a b c d e f", 1), (None, "clean text of other words here", 2), (None, None, 3), (5, "x a b c d e y", 4), (5, "another clean text with other words", 5), (6, "q b c d e f", 6)]
    items = spark.createDataFrame([(1, "a b c d e"), (2, "b c d e f")], "item_id long, text string")
    for block in (1 << 24, 8):  # one block, and one for each item
        kept = drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string, n int"), items, block_bytes=block)
        assert sorted(r.n for r in kept.collect()) == [2, 3, 5]


def test_short_items_are_found_inside_longer_documents(spark):
    docs = spark.createDataFrame([(1, "the answer is forty two of course"), (2, "forty"), (3, "two forty one"), (4, "forty two")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Forty two"), (2, "answer is forty two"), (3, "forty")], "item_id long, text string")
    for block in (1 << 24, 8):
        got = {(r.doc_id, r.item_id) for r in find_contained(docs, items, block_bytes=block).collect()}
        assert got == {(1, 1), (1, 2), (1, 3), (2, 3), (3, 3), (4, 1), (4, 3)}
    assert [r.doc_id for r in drop_contaminated(docs, items.filter("item_id = 1")).collect()] == [2, 3]
