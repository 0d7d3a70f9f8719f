"""Toxicity by a counterfactual-regularised classifier.

A document is the set of its words and word beginnings, hashed. A logistic
model over the features that tell the labels apart, and over those of the group
terms, is fitted on a bounded sample of labelled documents. In every labelled
text that names a group the term is swapped for the other terms of its kind.
Every labelled text also gets neutral mentions: a term of each kind is put into
it, and then swapped for the next. The squared change of the score under each of
these is penalised, so neither which group is named nor that one is named moves
the score, whatever groups the corpus itself happens to name. Word beginnings
that terms share with other words are held down with them. Scores are
calibrated on labelled documents outside the fit.

Every document is scored in one pass without a shuffle; the model's size is
bounded by ``MOST_FEATURES``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm.textkit import Powers, ascii_lower, byte_codes, list_column, mix, one_row_each, parts, runs, slices, smallest_hashed, span_hashes, texts_of
from massloom.plans.shipping import ship
from massloom.plans.store import materialize

#: Labelled documents that the model is fitted on, at most (those of the smallest hashed ids).
MAX_LABELLED = 10_000
#: Bytes of the word beginnings that are features, beside whole words.
BEGINNINGS = (3, 5, 7)
MOST_FEATURES, LEAST_DOCUMENTS = 1024, 4
#: Weights of the squared weights and of the squared score changes under swaps.
RIDGE, FAIR, STEPS = 0.2, 4.0, 300
#: Group terms by kind; terms of one kind are swapped for one another.
IDENTITIES = {
    "faith": "christian muslim jewish hindu buddhist atheist christians muslims jews chrétien musulman juif cristiano musulmán judío christlich muslimisch jüdisch".split(),
    "origin": "african american asian european mexican arab indian chinese immigrant immigrants refugee refugees africain asiatique africano asiático afrikanisch asiatisch".split(),
    "gender": "woman women man men girl boy female male femme femmes homme hommes mujer mujeres hombre hombres frau frauen mann männer".split(),
    "orientation": "gay lesbian bisexual straight transgender queer heterosexual homosexual".split(),
    "colour": "black white brown noir blanc negro blanco schwarz weiß".split(),
    "ability": "disabled deaf blind autistic".split(),
}


def is_letter() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[65:91] = table[97:123] = table[128:] = True
    return table


def hashed_features(texts: pa.Array, pows: Powers) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, its distinct features ascending, its features by kind and word, whole words first); words are runs of letters in lower case."""
    codes, letter, low = byte_codes(), is_letter(), ascii_lower()
    for first, last, data, offsets in slices(texts):
        data = low[data]
        start, end, at = runs(letter[data], offsets)
        words = span_hashes(data, start, end, codes, pows)
        kinds = [words]
        for n in BEGINNINGS:
            kinds.append(mix(span_hashes(data, start, np.minimum(end, start + n), codes, pows) + np.uint64(n)))
        table = np.stack(kinds)
        for row in range(last - first):
            own = table[:, at[row] : at[row + 1]]
            yield first + row, np.unique(own), own


def features_of_word(word: str, pows: Powers) -> np.ndarray:
    return next(hashed_features(pa.array([word]), pows))[1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    """Sorted feature hashes with their weights, a constant, and the calibration of the raw score."""

    features: np.ndarray
    weights: np.ndarray
    constant: float
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, held: np.ndarray) -> float:
        if not len(self.features) or not len(held):
            return self.constant
        at = np.minimum(np.searchsorted(self.features, held), len(self.features) - 1)
        return self.constant + float(self.weights[at[self.features[at] == held]].sum())

    def score(self, held: np.ndarray) -> float:
        return float(sigmoid(np.array(self.slope * self.raw(held) + self.offset)))


def span_hash(word: str, pows: Powers) -> int:
    return int(next(hashed_features(pa.array([word]), pows))[2][0, 0])


def term_hashes(pows: Powers) -> np.ndarray:
    return np.sort(np.array([span_hash(t, pows) for terms in IDENTITIES.values() for t in terms], dtype=np.uint64))


def term_features(pows: Powers) -> np.ndarray:
    """The features of all group terms, ascending."""
    return np.unique(np.concatenate([features_of_word(t, pows) for terms in IDENTITIES.values() for t in terms]))


def only_of_terms(own: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(the group terms of a text, for each the features that no other word of the text has)."""
    named = np.unique(present(terms, own[0]))
    lost = []
    for t in named:
        is_term = own[0] == t
        lost.append(np.setdiff1d(own[:, is_term], own[:, ~is_term]))
    return named, lost


def swap_pairs(rows: list[np.ndarray], named: list[np.ndarray], lost: list[list[np.ndarray]], pows: Powers) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features lost, features won) for every counterfactual of the labelled rows.

    ``rows`` are their features, ``named`` the group terms in them and ``lost``
    the features that go with each. A named term is swapped for every other of
    its kind. Each row also gets a term of each kind that it does not name, in
    turn over the rows, and that mention is swapped for the next term.
    """
    every = term_features(pows)
    absent = [~np.isin(every, held) for held in rows]
    out = []
    for terms in IDENTITIES.values():
        own = [np.isin(every, features_of_word(t, pows)) for t in terms]
        whole = np.array([span_hash(t, pows) for t in terms], dtype=np.uint64)
        for i, (new, seen, gone) in enumerate(zip(absent, named, lost, strict=True)):
            here = np.isin(whole, seen) if len(seen) else np.zeros(len(terms), dtype=bool)
            for k in np.flatnonzero(here):
                minus = gone[int(np.flatnonzero(seen == whole[k])[0])]
                out += [(minus, every[own[j] & new]) for j in range(len(terms)) if j != k]
            k, nxt = i % len(terms), (i + 1) % len(terms)
            if not here[k]:
                out += [(every[:0], every[own[k] & new]), (every[own[k] & new & ~own[nxt]], every[own[nxt] & new & ~own[k]])]
    return out


def present(names: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The values of ``held`` that are among the sorted ``names``."""
    if not len(names) or not len(held):
        return held[:0]
    return held[names[np.minimum(np.searchsorted(names, held), len(names) - 1)] == held]


def fit(names: np.ndarray, rows: list[np.ndarray], y: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray]], fair: float = FAIR) -> Model:
    """Ridge logistic regression over the sorted features ``names`` by accelerated gradient steps, with the counterfactual penalty."""
    if not len(rows) or y.min() == y.max() or not len(names):
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(rate / (1 - rate))))
    p, n = y.sum(), len(y) - y.sum()
    rows = [present(names, r) for r in rows]
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.searchsorted(names, np.concatenate(rows))
    m = len(names)
    lost, won = [], []  # rows of the swap matrix, by column
    for a, b in swaps:
        for part, out in ((a, lost), (b, won)):
            at = np.minimum(np.searchsorted(names, part), m - 1)
            out.append(at[names[at] == part])
    swap_row = np.concatenate([np.repeat(np.arange(len(lost)), [len(x) for x in lost]), np.repeat(np.arange(len(won)), [len(x) for x in won])]) if swaps else np.zeros(0, int)
    swap_col = np.concatenate(lost + won).astype(int) if swaps else np.zeros(0, int)
    swap_sign = np.concatenate([-np.ones(sum(map(len, lost))), np.ones(sum(map(len, won)))]) if swaps else np.zeros(0)
    weight = np.where(y == 1, 0.5 / p, 0.5 / n)
    w, b, vw, vb = np.zeros(m), 0.0, np.zeros(m), 0.0
    scale = 1 / np.sqrt(np.bincount(col, minlength=m) + 10.0)  # rare features move as far as common ones
    rate = 4.0
    if len(swap_col):  # and no feature further than the penalty's curvature allows
        wide = max(1, int(np.bincount(swap_row, minlength=len(lost)).max()))
        scale = 1 / (1 / scale + rate * fair * wide * np.bincount(swap_col, minlength=m) / len(lost))
    for _ in range(STEPS):
        lw, lb = w + 0.9 * vw, b + 0.9 * vb
        d = (sigmoid(np.bincount(doc, weights=lw[col], minlength=len(y)) + lb) - y) * weight
        g = np.bincount(col, weights=d[doc], minlength=m) + RIDGE / len(y) * lw * 10
        if len(swap_col):
            change = np.bincount(swap_row, weights=swap_sign * lw[swap_col], minlength=len(lost))
            g += fair / len(lost) * np.bincount(swap_col, weights=swap_sign * change[swap_row], minlength=m)
        vw, vb = 0.9 * vw - rate * scale * g, 0.9 * vb - 0.2 * rate * d.sum()
        w, b = w + vw, b + vb
    return Model(names, w, float(b))


def calibrate(model: Model, rows: list[np.ndarray], y: np.ndarray) -> None:
    """Platt scaling on rows outside the fit."""
    if not len(rows) or y.min() == y.max():
        return
    z = np.array([model.raw(r) for r in rows])
    goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(500):
        p = sigmoid(a * z + b)
        g, h = p - goal, np.maximum(p * (1 - p), 1e-4)
        ga, gb = (g * z).mean() + 1e-3 * (a - 1), g.mean()
        haa, hab, hbb = (h * z * z).mean() + 1e-3, (h * z).mean(), h.mean() + 1e-4
        det = haa * hbb - hab * hab
        a, b = a - 0.3 * (hbb * ga - hab * gb) / det, b - 0.3 * (haa * gb - hab * ga) / det
    model.slope, model.offset = float(max(a, 1e-3)), float(b)


def select_features(labelled: DataFrame, positives: int, negatives: int) -> np.ndarray:
    """The features that tell the labels of (toxic, text) apart best: sorted, at most MOST_FEATURES.

    Each batch counts its own documents first; the counts meet in a combinable sum.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = Powers()
        for b in parts(batches):
            for first in range(0, b.num_rows, 256):
                part = b.slice(first, 256)
                held = [h for _, h, _ in hashed_features(part.column(1), pows)]
                names, at, df = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
                label = np.repeat(part.column(0).to_numpy().astype(float), [len(h) for h in held])
                pos = np.bincount(at, weights=label, minlength=len(names)).astype(np.int64)
                yield pa.record_batch([pa.array(names.view(np.int64)), pa.array(df.astype(np.int64)), pa.array(pos)], ["v", "df", "pos"])

    counts = labelled.select("toxic", "text").mapInArrow(kernel, "v long, df long, pos long").groupBy("v").agg(F.sum("df").alias("df"), F.sum("pos").alias("pos"))
    odds = F.log((F.col("pos") + 0.5) / (positives + 1)) - F.log((F.col("df") - F.col("pos") + 0.5) / (negatives + 1))
    best = counts.filter(F.col("df") >= LEAST_DOCUMENTS).withColumn("worth", F.round(F.abs(odds) * F.sqrt("df"), 9)).filter("worth > 0").orderBy(F.desc("worth"), "v").limit(MOST_FEATURES)
    return np.sort(np.array([r.v for r in best.select("v").collect()], dtype=np.int64).view(np.uint64))


def encode(labelled: DataFrame, names: np.ndarray) -> pa.Table:
    """(part, toxic, held, terms, lost) for each labelled row: the selected features and group terms in it, and what goes with each term."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = Powers()
        terms = term_hashes(pows)
        for b in parts(batches):
            held, seen, gone = [], [], []
            for _, h, own in hashed_features(b.column(2), pows):
                held.append(present(names, h).view(np.int64))
                named, lost = only_of_terms(own, terms)
                seen.append(named.view(np.int64))
                gone.append([present(names, x).view(np.int64).tolist() for x in lost])
            yield pa.record_batch([b.column(0), b.column(1), list_column(held, np.int64, pa.int64()), list_column(seen, np.int64, pa.int64()), pa.array(gone, pa.list_(pa.list_(pa.int64())))], ["part", "toxic", "held", "terms", "lost"])

    out = labelled.select("part", "toxic", "text", "doc_id", F.xxhash64("text").alias("h")).orderBy("doc_id", "toxic", "h")  # the order of arrival does not matter
    return out.select("part", "toxic", "text").mapInArrow(kernel, "part int, toxic int, held array<long>, terms array<long>, lost array<array<long>>").toArrow()


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, fair: float | None = None) -> Model:
    """A calibrated model from at most ``most`` labelled ids; three quarters fit, the rest calibrates.

    An id of several rows is learned from one of them (the smallest hash of its text).
    Labels that are null, repeated, or of ids without a document are harmless;
    without labels of both kinds the score is the rate of label 1.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)").dropna()
    known = smallest_hashed(known, most, "doc_id", "toxic")
    known = known.dropDuplicates()
    own = one_row_each(texts_of(docs).join(known.select("doc_id").distinct(), "doc_id"), "doc_id", "text")
    labelled = own.join(known, "doc_id").select("doc_id", "toxic", "text", F.pmod(F.xxhash64("doc_id"), F.lit(4)).cast("int").alias("part"))
    labelled = materialize(labelled, "toxicity-labelled")
    inside = labelled.filter("part <> 0")
    n = {r.toxic: r["count"] for r in inside.groupBy("toxic").count().collect()}
    names = select_features(inside, n.get(1, 0), n.get(0, 0)) if len(n) == 2 else np.zeros(0, np.uint64)
    names = np.union1d(names, term_features(Powers())) if len(names) else names
    rows = encode(labelled, names)
    part, y = rows.column("part").to_numpy(), rows.column("toxic").to_numpy().astype(float)
    if not len(y):
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    held, terms = ([np.asarray(x, dtype=np.int64).view(np.uint64) for x in rows.column(c).to_numpy()] for c in ("held", "terms"))
    lost = [[np.asarray(x, dtype=np.int64).view(np.uint64) for x in row] for row in rows.column("lost").to_pylist()]
    own, rest = np.flatnonzero(part != 0), np.flatnonzero(part == 0)
    swaps = swap_pairs([held[i] for i in own], [terms[i] for i in own], [lost[i] for i in own], Powers())
    model = fit(names, [held[i] for i in own], y[own], swaps, FAIR if fair is None else fair) if len(own) else Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    calibrate(model, [held[i] for i in rest], y[rest])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for each row of ``docs``: the probability of label 1, and whether it is 0.5 or more.

    Null and empty texts get the score of a document without words. Repeated
    rows and null ids are scored each for itself; a score of exactly 0.5 counts
    as toxic; extra columns are not read, whatever their names. A text is
    scored whole: one longer than a slice is a slice of its own, at some 80
    bytes a byte of text. An empty table gives no rows.
    """
    sent = ship(docs.sparkSession, model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = Powers()
        for b in parts(batches):
            scores = np.array([sent.value.score(h) for _, h, _ in hashed_features(b.column(1), pows)], dtype=float)
            yield pa.record_batch([b.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts_of(docs).mapInArrow(kernel, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns.

    Each row is judged by its own text, whatever its id; nulls, empty and very
    long texts as in :func:`score`. Columns may have any names. An empty table
    gives no rows; without labels of both kinds nothing is learned and no row goes.
    """
    trained = train(docs, labels)
    model = ship(docs.sparkSession, trained)
    where, learned = docs.columns.index("text"), len(trained.features) > 0

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = Powers()
        for b in parts(batches):
            keep = [row for row, h, _ in hashed_features(b.column(where), pows) if not learned or model.value.score(h) < 0.5]
            yield b.take(pa.array(keep, pa.int64()))

    return docs.mapInArrow(kernel, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 5 == 0


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of rows that are not held out; odd rows as in :func:`score`."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
