import random

import numpy as np
import pytest

import corpus_pipeline as p
from massloom.llm import op04_pieces as o4
from tests.llm.test_classifiers import base
from tests.llm.test_near_duplicates import brute, corpus, shingles

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def sf_dir(spark, tmp_path, monkeypatch):
    pieces = o4.Pieces([("<unk>", 0.0, o4.UNKNOWN)] + [(c, -3.0, o4.NORMAL) for c in "abcdefghijklmnopqrstuvwxyz0123456789" + o4.MARK] + [(f"<0x{b:02X}>", 0.0, o4.BYTE) for b in range(256)])
    monkeypatch.setattr(o4, "load_pieces", lambda spark: pieces)
    rng, rows = random.Random(11), corpus(2)
    labels, docs = [], []
    for d, t in rows:
        bad = rng.random() < 0.2
        t = t + " idiotx scumx" if bad else t
        if d % 9 == 0:
            t += ' token = "0123abcd0123abcd0123"'
        docs.append((d, t, "en", "s", len(t)))
        labels.append((d, 1, int(bad)))
    docs += [(5000, None, None, None, None), (5001, "", "en", "s", 0)]
    item = "one two three four five six seven eight nine"
    docs.append((5002, "before it " + item + " after it and more", "en", "s", 50))
    for name, data, schema in (("documents", docs, COLUMNS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, item.title())], "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path), pieces


def test_each_stage_against_plain_python(spark, sf_dir):
    path, pieces = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, path)
        if name != "pieces":
            assert out.columns == docs.columns
            out.write.parquet(f"{path}/out-{name}")
            out = spark.read.parquet(f"{path}/out-{name}")
        seen[name] = {r.doc_id: r for r in out.collect()}
        docs = out
    first = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    bad = {d for d, t in first.items() if t and "idiotx" in t}
    gone = set(first) - set(seen["toxicity"])
    assert len(gone & bad) >= 0.95 * len(bad) and len(gone - bad) <= 2
    left = [(d, r.text) for d, r in seen["toxicity"].items()]
    assert set(seen["near_duplicates"]) == {d for d, _, _, kept in brute(left) if kept}
    item = shingles("one two three four five six seven eight nine")
    assert set(seen["decontaminate"]) == {d for d, r in seen["near_duplicates"].items() if not len(item & shingles(r.text)) >= 0.75 * len(item)}
    assert set(seen["secrets"]) == set(seen["decontaminate"]) and 5000 in seen["secrets"]
    for d, r in seen["secrets"].items():
        old = seen["decontaminate"][d].text
        assert (r.text == old) == (not base(old or "")) and r.n_chars == (None if r.text is None else len(r.text))
    for d, r in seen["pieces"].items():
        text = seen["secrets"][d].text
        assert r.ids is None if text is None else pieces.decode(np.array(r.ids, dtype=np.int64)) == text


def test_run_returns_every_kept_document(spark, sf_dir):
    out = p.run(spark, sf_dir[0])
    assert out.columns == ["doc_id", "n_pieces", "ids", "exact"] and 0 < out.count() < spark.read.parquet(f"{sf_dir[0]}/documents.parquet").count()
