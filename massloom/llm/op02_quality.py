"""Quality by co-training two views of a document.

The text view sees the characters: how often each pair of character classes
follows one another, and figures of words and lines. The metadata view sees
language, source and length class. Each view's classifier starts from the
labelled sample; in each round it scores every unlabelled document of the corpus
and labels those that it is surest about for the *other* view, and both are
fitted anew. In the end each
view is calibrated on labelled documents outside the fit, and the calibrated
log odds are added (less the prior, which both contain), so a document is
scored by both.

Every document is scored in one pass over its whole text, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm.textkit import Powers, byte_codes, is_gap, list_column, mix, one_row_each, parts, runs, slices, smallest_hashed, span_hashes
from massloom.plans.shipping import ship
from massloom.plans.store import materialize

#: Labelled documents that the classifiers are fitted on, at most (those of the smallest hashed ids).
MAX_LABELLED = 6_000
#: Rounds, documents of all that a view labels for the other in each, and how sure it must be of them.
ROUNDS, EXCHANGED, SURE = 3, 600, 0.95
RIDGE = 1e-3
META = ["lang", "source", "n_chars"]
META_SLOTS = 96


def char_classes() -> np.ndarray:
    """A class of 0..19 for each byte: letters by case, digits, non-ASCII, line ends, blanks, and the commoner marks."""
    table = np.full(256, 19, dtype=np.int64)
    table[97:123], table[65:91], table[48:58], table[128:], table[10], table[[32, 9, 11, 12, 13]] = 0, 1, 2, 3, 4, 5
    for k, c in enumerate(b".,!?|#*$%&<>-"):
        table[c] = 6 + k
    return table


CLASSES = 20
FIGURES = 8
TEXT_SIZE = CLASSES * CLASSES + FIGURES


def text_view(texts: pa.Array, pows: Powers) -> np.ndarray:
    """One row of features for each text; zeros for a text without words."""
    classes, gap, codes = char_classes(), is_gap(), byte_codes()
    out = np.zeros((len(texts), TEXT_SIZE))
    for first, last, data, offsets in slices(texts):
        kind = classes[data]
        start, end, at = runs(~gap[data], offsets)
        words = span_hashes(data, start, end, codes, pows)
        ls, le, lat = runs(data != 10, offsets)
        lines = span_hashes(data, ls, le, codes, pows)
        for r in range(last - first):
            a, b = int(offsets[r]), int(offsets[r + 1])
            w, lo = words[at[r] : at[r + 1]], lines[lat[r] : lat[r + 1]]
            if not len(w):
                continue
            pairs = np.bincount(kind[a : b - 1] * CLASSES + kind[a + 1 : b], minlength=CLASSES * CLASSES)
            out[first + r, :-FIGURES] = np.sqrt(pairs / max(1, b - a - 1))
            n, d, size = len(w), len(np.unique(w)), end[at[r] : at[r + 1]] - start[at[r] : at[r + 1]]
            dl = len(np.unique(lo)) / len(lo)
            out[first + r, -FIGURES:] = np.log1p(n) / 10, n < 20, n < 5, d / n, (d / n) / (1 + np.log1p(n)), size.mean() / 10, dl, len(lo) / n
    return out


def meta_slots() -> Column:
    """The active features of the metadata view, as slots of a hashed one-hot vector."""
    size = F.floor(F.log2(F.greatest(F.coalesce("n_chars", F.lit(0)), F.lit(1)))).cast("string")
    parts = [("lang", F.col("lang")), ("source", F.col("source")), ("size", size), ("lang_size", F.concat_ws(":", "lang", size))]
    return F.array(*[F.pmod(F.xxhash64(F.lit(name), F.coalesce(c, F.lit("none"))), F.lit(META_SLOTS)).cast("int") for name, c in parts])


def meta_view(slots: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(slots), META_SLOTS))
    for r, s in enumerate(slots):
        out[r, s] = 1
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class View:
    """A logistic classifier of standardised features, with its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> View:
        """Ridge logistic regression by Newton steps."""
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        w, ridge = np.zeros(z.shape[1]), RIDGE * len(x) * np.r_[np.ones(z.shape[1] - 1), 1e-6]
        for _ in range(12):
            p = sigmoid(z @ w)
            h = (z * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z + np.diag(ridge + 1e-9)
            step = np.linalg.solve(h, z.T @ (weight * (p - y)) + ridge * w)
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on rows outside the fit."""
        if not len(y) or y.min() == y.max():
            return
        z = self.logit(x)
        goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(300):
            p = sigmoid(a * z + b)
            g, h = p - goal, np.maximum(p * (1 - p), 1e-4)
            ga, gb = (g * z).mean() + 1e-3 * (a - 1), g.mean()
            haa, hab, hbb = (h * z * z).mean() + 1e-3, (h * z).mean(), h.mean() + 1e-4
            det = haa * hbb - hab * hab
            a, b = a - 0.3 * (hbb * ga - hab * gb) / det, b - 0.3 * (haa * gb - hab * ga) / det
        self.slope, self.offset = max(float(a), 0.0), float(b)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.logit(x) + self.offset


@dataclass
class CoTrained:
    text: View | None
    meta: View | None
    prior: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """The probability of label 1 from both calibrated views."""
        if self.text is None:
            return np.full(len(text), float(sigmoid(np.array(self.prior))))
        return sigmoid(self.text.odds(text) + self.meta.odds(meta) - self.prior)


class CoTraining:
    """Both views' training sets, from labelled rows (``held`` marks those that calibrate) and what the views label for each other."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, held: np.ndarray) -> None:
        self.labelled, self.y, self.held = (text, meta), y, held
        self.prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
        own = ~held
        self.able = bool(own.any()) and y[own].min() != y[own].max()
        self.rate = float(y[own].mean()) if own.any() else 0.5
        self.sets = [[x[own], y[own], np.ones(int(own.sum()))] for x in self.labelled]

    def views(self) -> list[View]:
        """Both views fitted on their present sets and calibrated."""
        out = [View.fit(*s) for s in self.sets]
        for view, x in zip(out, self.labelled, strict=True):
            view.calibrate(x[self.held], self.y[self.held])
        return out

    def add(self, view: int, x: np.ndarray, label: float) -> None:
        """Pseudo-labelled rows for one view, at half the weight of labelled ones."""
        old = self.sets[view]
        self.sets[view] = [np.vstack([old[0], x]), np.r_[old[1], np.full(len(x), label)], np.r_[old[2], np.full(len(x), 0.5)]]

    def model(self) -> CoTrained:
        return CoTrained(*self.views(), self.prior) if self.able else CoTrained(None, None, self.prior)


def with_meta(docs: DataFrame) -> DataFrame:
    """doc_id, text and the metadata columns; those that are missing are null."""
    kinds = {"lang": "string", "source": "string", "n_chars": "long"}
    cols = [F.col(c).cast(kinds[c]).alias(c) if c in docs.columns else F.lit(None).cast(kinds[c]).alias(c) for c in META]
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *cols)
    return out.select("doc_id", "text", meta_slots().alias("slots"))


def view_features(rows: DataFrame) -> pa.Table:
    """(doc_id, y, x, slots) of (doc_id, y, text, slots), in an order of its own content."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = Powers()
        for b in parts(batches):
            x = text_view(b.column(2), pows)
            yield pa.record_batch([b.column(0), b.column(1), list_column(list(x.astype(np.float32)), np.float32, pa.float32()), b.column(3)], ["doc_id", "y", "x", "slots"])

    return rows.mapInArrow(kernel, "doc_id long, y int, x array<float>, slots array<int>").toArrow()


def in_order(seen: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, text view, metadata view), whatever order the rows arrived in."""
    x = seen.column("x").combine_chunks().flatten().to_numpy().astype(float).reshape(-1, TEXT_SIZE)
    meta = meta_view(seen.column("slots").to_pylist())
    ids, y = seen.column("doc_id").to_numpy(), seen.column("y").to_numpy().astype(float)
    order = np.lexsort((*x[:, -3:].T, y, ids))
    return ids[order], y[order], x[order], meta[order]


def surest(pool: DataFrame, views: list[View], taken: DataFrame, counts: dict[int, int]) -> DataFrame:
    """(doc_id, view, y): what each view is surest about among all rows of ``pool``, for the other view.

    Every row is scored; of each view and label the ``counts[label]`` surest
    documents that the other view was not yet given are taken (ties by hashed
    id). What is written and sorted is an id and two numbers a row.
    """
    sent = ship(pool.sparkSession, views)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = Powers()
        for b in parts(batches):
            p = sigmoid(sent.value[0].odds(text_view(b.column(1), pows)))
            q = sigmoid(sent.value[1].odds(meta_view(b.column(2).to_pylist())))
            yield pa.record_batch([b.column(0), pa.array(p), pa.array(q)], ["doc_id", "p0", "p1"])

    scored = materialize(pool.select("doc_id", "text", "slots").mapInArrow(kernel, "doc_id long, p0 double, p1 double"), "quality-scored")
    out = None
    for view in (0, 1):
        had = taken.filter(F.col("view") == 1 - view).select("doc_id")
        for label, most in counts.items():
            sure = F.col(f"p{view}") if label else 1 - F.col(f"p{view}")
            best = scored.withColumn("sure", sure).filter(F.col("sure") >= SURE).join(F.broadcast(had), "doc_id", "left_anti")
            best = best.orderBy(F.desc(F.round("sure", 9)), F.xxhash64("doc_id"), "doc_id").limit(most)
            best = best.select("doc_id", F.lit(1 - view).alias("view"), F.lit(label).alias("y"))
            out = best if out is None else out.unionByName(best)
    return materialize(out, "quality-surest")


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, exchanged: int = EXCHANGED, rounds: int = ROUNDS) -> CoTrained:
    """Co-trained views from at most ``most`` labelled ids and all unlabelled documents.

    Each round reads the corpus once; a view labels at most ``exchanged``
    documents for the other, shared out as the labels are. An id of several
    rows is learned from one of them. Null and repeated labels, and those of
    ids without a document, are harmless; without labels of both kinds the
    score is the prior.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("y in (0, 1)").dropna()
    known = smallest_hashed(known, most, "doc_id", "y").dropDuplicates()
    rows = with_meta(docs)
    ids = known.select("doc_id").distinct()
    seen = view_features(one_row_each(rows.join(ids, "doc_id"), "doc_id", "text", "slots").join(known, "doc_id").select("doc_id", "y", "text", "slots"))
    if not seen.num_rows:
        return CoTrained(None, None, 0.0)
    names, y, x, meta = in_order(seen)
    training = CoTraining(x, meta, y, mix(names.astype(np.int64).view(np.uint64)) % np.uint64(4) == 0)
    if not training.able:
        return training.model()
    pool = rows.dropna(subset=["doc_id"]).join(F.broadcast(ids), "doc_id", "left_anti")  # at most ``most`` ids
    counts = {label: max(1, int(exchanged * share)) for label, share in ((1, training.rate), (0, 1 - training.rate))}
    taken = docs.sparkSession.createDataFrame([], "doc_id long, view int, y int")
    for _ in range(rounds):
        new = surest(pool, training.views(), taken, counts)
        taken = taken.unionByName(new)
        # at most 2 * exchanged ids; one that both views chose, or chose for both labels, is read once
        texts = one_row_each(pool.join(F.broadcast(new.select("doc_id").distinct()), "doc_id"), "doc_id", "text", "slots")
        found = view_features(texts.select("doc_id", F.lit(0).alias("y"), "text", "slots"))
        if found.num_rows:
            names, _, *features = in_order(found)
            for r in new.groupBy("view", "y").agg(F.collect_set("doc_id").alias("ids")).orderBy("view", "y").collect():
                training.add(r.view, features[r.view][np.isin(names, r.ids)], float(r.y))
    return training.model()


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """(doc_id, score, kept) for each row: the probability of good quality, kept from 0.5 on.

    Null and empty texts have a text view of zeros; null or missing metadata is
    a class of its own. Repeated rows and null ids are scored each for itself;
    a score of exactly 0.5 is kept; columns other than text and metadata are
    not read. A text is read whole: one longer than a slice is a slice of its
    own. An empty table gives no rows.
    """
    sent = ship(docs.sparkSession, model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = Powers()
        for b in batches:
            for first in range(0, b.num_rows, 1024):
                part = b.slice(first, 1024)
                s = sent.value.score(text_view(part.column(1), pows).astype(np.float32), meta_view(part.column(2).to_pylist()))
                yield pa.record_batch([part.column(0), pa.array(s.astype(float)), pa.array(s >= 0.5)], ["doc_id", "score", "kept"])

    return with_meta(docs).mapInArrow(kernel, "doc_id long, score double, kept boolean")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document and whether it is kept; odd rows as in :func:`score`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
