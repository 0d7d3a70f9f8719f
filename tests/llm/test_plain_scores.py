"""Scores of the classifiers' queries against plain Python over the same models: features counted by hand, one document after another."""

import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.llm import op02_quality as o2
from massloom.llm import op07_toxicity as o7
from massloom.llm.textkit import Powers

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def test_toxicity_scores_equal_plain_sums_of_weights(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = o7.train(docs, labels.filter(~o7.held_out(F.col("doc_id"))))
    weights, pows, known = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True)), Powers(), {}
    got = {r.doc_id: r for r in o7.op7_toxicity(spark, DATA).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and weights
    for r in rows:
        held = set()
        for word in set(re.findall(rb"[A-Za-z\x80-\xff]+", (r.text or "").encode())):
            w = bytes(c + 32 if 65 <= c <= 90 else c for c in word)
            if w not in known:
                known[w] = set(o7.features_of_word(w.decode(), pows).tolist())
            held |= known[w]
        raw = model.constant + sum(weights.get(h, 0.0) for h in held)
        score = 1 / (1 + math.exp(-max(-40, min(40, model.slope * raw + model.offset))))
        own = got[r.doc_id]
        assert abs(own.score - score) < 1e-9 and own.predicted == int(score >= 0.5)
        assert own.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def plain_text_view(text):
    classes = o2.char_classes()
    data = text.encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", data) if w]
    out = np.zeros(o2.TEXT_SIZE)
    if not words:
        return out
    for a, b in zip(data[:-1], data[1:], strict=True):
        out[classes[a] * o2.CLASSES + classes[b]] += 1
    out[: -o2.FIGURES] = np.sqrt(out[: -o2.FIGURES] / max(1, len(data) - 1))
    lines = [x for x in data.split(b"\n") if x]
    n, d = len(words), len(set(words))
    out[-o2.FIGURES :] = math.log1p(n) / 10, n < 20, n < 5, d / n, d / n / (1 + math.log1p(n)), sum(map(len, words)) / n / 10, len(set(lines)) / len(lines), len(lines) / n
    return out


def test_quality_scores_equal_plain_features_in_the_same_model(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = o2.train(docs, labels)
    got = {r.doc_id: r for r in o2.op2_quality(spark, DATA).collect()}
    rows = docs.select("doc_id", "text", o2.meta_slots().alias("slots")).collect()
    assert len(got) == len(rows) and model.text is not None
    name = next(c for c in got[rows[0].doc_id].asDict() if c in ("quality", "score"))
    for r in rows:
        meta = np.zeros((1, o2.META_SLOTS))
        meta[0, r.slots] = 1
        want = float(model.score(plain_text_view(r.text or "")[None, :], meta)[0])
        assert abs(got[r.doc_id][name] - want) < 1e-4
