"""Rows that a corpus is not supposed to hold: null and shared ids, clashing columns, very long texts, nothing at all."""

import random

import numpy as np
import pytest

import corpus_pipeline as p
from massloom.llm import op01_sharding as o1
from massloom.llm import op02_quality as o2
from massloom.llm import op03_neardup as o3
from massloom.llm import op04_pieces as o4
from massloom.llm import op05_rules as o5
from massloom.llm import op07_toxicity as o7
from massloom.llm import op08_substrings as o8
from massloom.llm import op09_decontaminate as o9
from massloom.llm import op10_secrets as o10

ITEM = "one two three four five six seven eight nine ten"
CLEAN = "a plain text of some words that holds nothing from any list at all"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, _gone string, _bad string, shard int, component_id long, score double, kept boolean, starts int, h long, m long"
EXTRA = (1, "g", "b", 9, 5, 0.5, True, 3, 4, 5)


def docs_of(spark, pairs):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), *EXTRA) for d, t in pairs], SCHEMA)


@pytest.fixture(scope="module")
def pieces():
    letters = "abcdefghijklmnopqrstuvwxyz" + o4.MARK
    return o4.Pieces([("<unk>", 0.0, o4.UNKNOWN)] + [(c, -3.0, o4.NORMAL) for c in letters] + [("ab", -3.5, o4.NORMAL), ("bca", -4.0, o4.NORMAL)] + [(f"<0x{b:02X}>", 0.0, o4.BYTE) for b in range(256)])


def test_stages_decide_by_row_whatever_the_ids_and_columns(spark):
    rows = [(5, ITEM), (5, CLEAN), (None, "before it " + ITEM), (None, CLEAN + " and more"), (7, "same words here as there"), (7, "same words here as there"), (8, ""), (9, None)]
    docs = docs_of(spark, rows)
    items = spark.createDataFrame([(1, ITEM, "x"), (None, None, "y")], "item_id long, text string, _bad string")
    left = o9.drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in left.collect() if r.text) == [(False, 5, CLEAN), (False, 7, rows[4][1]), (False, 7, rows[5][1]), (True, 0, CLEAN + " and more")]
    assert left.filter("text is null or text = ''").count() == 2
    one = o3.drop_near_duplicates(docs)
    # the null ids come first, so their rows stay of the two pairs of near copies; of the two rows of id 7 one does
    assert one.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in one.collect()) == sorted([(0, rows[2][1]), (0, rows[3][1]), (7, rows[4][1]), (8, ""), (9, "")])
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    assert o7.drop_toxic(docs, labels).columns == docs.columns
    clean = o10.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()


def test_many_blocks_give_what_one_does(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(12))) for k in range(40)]
    docs = [(k, " ".join([word() for _ in range(20)] + [items[k][1]] * (k % 3 == 0))) for k in range(40)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    pairs = lambda b: sorted((r.doc_id, r.item_id, r.n_shared) for r in o9.find_contained(d, i, block_bytes=b).collect())
    assert pairs(1 << 20) == pairs(256) and {x for x, *_ in pairs(256)} == {k for k in range(40) if k % 3 == 0}
    assert {r.doc_id for r in o9.drop_contaminated(d, i, block_bytes=256).collect()} == {k for k in range(40) if k % 3}


def test_other_operators_with_clashing_columns(spark, tmp_path):
    rows = [(k, f"text number {k % 6} " + CLEAN) for k in range(30)] + [(3, "another text of the id"), (None, None), (30, "")]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(k, k % 2, k % 3 == 0) for k in range(20)], "doc_id long, quality int, toxic boolean")
    assert o2.score(docs, o2.train(docs, labels)).count() == len(rows)
    assert o5.judge(docs, labels)[0].count() == len(rows)
    assert o1.minimax_shards(docs, 3).count() == len(rows)
    o1.write_shards(docs, f"{tmp_path}/shards", 3)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == len(rows) and "shard_" in back.columns and {r.shard for r in back.select("shard").distinct().collect()} == {9}
    groups = back.filter("text is not null").groupBy("text").agg({"shard_": "min"}).count()
    assert groups == back.filter("text is not null").select("text", "shard_").distinct().count()
    scanned, changed = o8.dedup_substrings(docs)
    assert scanned.count() == len(rows) and changed.count() >= 0


def test_empty_tables_stay_empty(spark, tmp_path):
    docs = docs_of(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0


def test_without_labels_nothing_is_toxic(spark):
    docs = docs_of(spark, [(1, CLEAN), (2, ""), (3, None)])
    assert o7.drop_toxic(docs, spark.createDataFrame([], "doc_id long, toxic int")).count() == 3


def test_a_chunk_longer_than_a_block_is_segmented_alike(pieces, monkeypatch):
    rng = random.Random(3)
    chunks = ["".join(rng.choice("abc") for _ in range(n)) for n in (1, 63, 64, 65, 500, 3000)] + ["abca" * 400, "é漢" * 200, "bcab" + "z" * 300]
    whole = [pieces.segment(c) for c in chunks]
    for block in (16, 64, 257):
        monkeypatch.setattr(o4, "BLOCK", block)
        assert [pieces.segment(c) for c in chunks] == whole


def test_very_long_texts(spark, pieces):
    long_word, long_text = "abc" * 1_000_000, (CLEAN + " ") * 60_000
    docs = docs_of(spark, [(1, long_word), (2, long_text), (3, CLEAN), (4, long_text + ITEM)])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert {r.doc_id for r in o9.drop_contaminated(docs, items).select("doc_id").collect()} == {1, 2, 3}
    assert {r.doc_id: r.n_shingles for r in o3.near_duplicates(docs).collect()}[1] == 1
    assert o7.score(docs, o7.train(docs, labels)).count() == 4
    assert o10.redact(docs).select("doc_id").count() == 4
    got = o4.encode_documents(docs.filter("doc_id in (1, 3)"), pieces).collect()
    assert all(r.exact for r in got)
    assert pieces.decode(np.array(next(r.ids for r in got if r.doc_id == 1))) == long_word
