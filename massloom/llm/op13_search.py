"""Ranked lexical search as maximum inner product search over buckets of similar length.

A document is a vector of impacts over the terms of the queries, a query is a
vector of term weights, and the score is their product.

1. Each document is scanned once and leaves its term count and the occurrences
   of the queries' terms. Counts over all documents give weights and impacts.
2. The vectors are range-partitioned by their length (Euclidean norm), longest
   first, with the id as second key so that copies of one text spread.
3. Each range is cut into buckets of vectors of similar length. A bucket is
   skipped by a query whose length times the bucket's largest is below the
   query's tenth best score so far (Cauchy-Schwarz). Inside a bucket each
   query coordinate is bounded by the bucket's largest impact there; the
   coordinates in order of that bound are searched until those left, by their
   bounds or by Cauchy-Schwarz, cannot reach the tenth best alone. Vectors whose
   part so far plus that rest is enough are scored exactly in 64-bit integers.
4. Ranges return at most ten vectors a query; the best ten of these are the answer.

Where a tenth best comes from is free as long as ten documents have it: the
first ones are taken from one document in ``SEED_SHARE``, so that short vectors
meet a bound from the start. Bounds are compared with a margin above the
rounding of doubles, and equal scores are never pruned.

Queries travel in blocks of at most ``BLOCK_BYTES`` of terms; a larger set
takes more passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from massloom.llm.textkit import NO_ID, Powers, ascii_lower, byte_codes, list_column, parts, runs, slices, span_hashes, texts_of
from massloom.operators.ordered import top_k
from massloom.plans.store import discard, materialize

BEST = 10
BUCKET = 4096
SEED_SHARE = 32
BLOCK_BYTES = 16 << 20
MARGIN = 1 + 1e-9
HITS = "query long, item_id long, doc_id long, score long"


def in_term() -> np.ndarray:
    """Which bytes belong to terms: 0-9, A-Z, a-z and all of characters beyond ASCII."""
    table = np.zeros(256, dtype=bool)
    for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        table[a:b] = True
    return table


def term_hashes(texts: pa.Array, pows: Powers) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes of all terms, first term of each row and one more) for slices of rows."""
    codes, inside, low = byte_codes(), in_term(), ascii_lower()
    for first, last, data, offsets in slices(texts):
        start, end, at = runs(inside[data], offsets)
        yield first, last, span_hashes(low[data], start, end, codes, pows), at


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the hashes of each item's terms, repeats included; equal rows once, items without terms not."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = Powers()
        for b in parts(batches):
            lists = [np.sort(h[at[r] : at[r + 1]].view(np.int64)) for first, last, h, at in term_hashes(b.column(1), pows) for r in range(last - first)]
            yield pa.record_batch([b.column(0), list_column(lists, np.int64, pa.int64())], ["item_id", "terms"])

    return texts_of(items, doc_id="item_id").distinct().mapInArrow(kernel, "item_id long, terms array<long>").filter("size(terms) > 0").distinct()


def term_counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs): number of terms, and for the terms of the vocabulary that a document holds their place there and occurrences."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows, known = Powers(), sent.value
        for b in parts(batches):
            ns, terms, tfs = [], [], []
            for first, last, h, at in term_hashes(b.column(1), pows):
                place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[place] == h
                row = np.repeat(np.arange(last - first), np.diff(at))
                both, tf = np.unique(row[hit] * len(known) + place[hit], return_counts=True)
                cut = np.searchsorted(both, np.arange(last - first + 1) * len(known))
                ns += np.diff(at).tolist()
                terms += np.split(both % len(known), cut[1:-1])
                tfs += np.split(tf, cut[1:-1])
            yield pa.record_batch([b.column(0), pa.array(ns, pa.int64()), list_column(terms, np.int32, pa.int32()), list_column(tfs, np.int32, pa.int32())], ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(kernel, "doc_id long, n long, terms array<int>, tfs array<int>")


def with_impacts(counted: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(doc_id, norm, terms, impacts) of the documents that hold a query term."""
    m = f"(25 + (75 * n * {n_docs}L) div {max(n_terms, 1)}L)"
    impacts = F.expr(f"transform(tfs, f -> (1000000000L * f) div (1000L * f + 8L * {m}))")
    held = counted.filter("size(terms) > 0").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "terms", impacts.alias("impacts"))
    return held.select("doc_id", F.expr("sqrt(aggregate(impacts, 0D, (a, x) -> a + double(x) * double(x)))").alias("norm"), "terms", "impacts")


class Bucket:
    """Vectors of similar length with the lists of each coordinate and its largest impact."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        column = lambda j: pa.chunked_array([b.column(j) for b in batches]).combine_chunks()
        self.ids = column(0).to_numpy()
        self.norm = float(column(1).to_numpy().max())
        terms = column(2)
        self.terms = terms.flatten().to_numpy().astype(np.int64)
        self.impacts = column(3).flatten().to_numpy()
        self.starts = np.r_[0, np.cumsum(terms.value_lengths().to_numpy())].astype(np.int64)
        rows = np.repeat(np.arange(len(self.ids)), np.diff(self.starts))
        order = np.argsort(self.terms, kind="stable")
        self.list_terms, self.list_at = np.unique(self.terms[order], return_index=True)
        self.list_at = np.r_[self.list_at, len(order)]
        self.list_rows, self.list_impacts = rows[order], self.impacts[order]
        self.most = np.maximum.reduceat(self.list_impacts, self.list_at[:-1]) if len(order) else self.list_impacts

    def candidates(self, terms: np.ndarray, weights: np.ndarray, least: int) -> np.ndarray:
        """Rows that may score ``least`` or more, by coordinate bounds."""
        at = np.minimum(np.searchsorted(self.list_terms, terms), max(len(self.list_terms) - 1, 0))
        held = self.list_terms[at] == terms
        at, weights = at[held], weights[held]
        bound = weights * self.most[at]
        order = np.argsort(-bound, kind="stable")
        at, weights, bound = at[order], weights[order], bound[order]
        tail = lambda x: np.r_[np.cumsum(x[::-1])[::-1], 0]
        rest = np.minimum(tail(bound), np.sqrt(tail(weights.astype(np.float64) ** 2)) * self.norm) * MARGIN
        focus = int(np.argmax(rest < least))  # coordinates from here on cannot reach it alone; the last bound is 0
        if not focus:
            return np.zeros(0, dtype=np.int64)
        parts = [slice(self.list_at[k], self.list_at[k + 1]) for k in at[:focus]]
        rows = np.concatenate([self.list_rows[p] for p in parts])
        part = np.bincount(rows, np.concatenate([self.list_impacts[p] * w for p, w in zip(parts, weights, strict=False)]), len(self.ids))
        seen = np.zeros(len(self.ids), dtype=bool)
        seen[rows] = True
        return np.flatnonzero(seen & ((part + rest[focus]) * MARGIN >= least))

    def scores(self, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores of some rows; ``weight`` has a place for every term."""
        size = self.starts[rows + 1] - self.starts[rows]
        first = np.r_[0, np.cumsum(size)[:-1]]
        at = np.repeat(self.starts[rows] - first, size) + np.arange(size.sum())
        return np.add.reduceat(weight[self.terms[at]] * self.impacts[at], first)


def search_range(batches: Iterator[pa.RecordBatch], queries: dict, best: int, bucket: int) -> Iterator[pa.RecordBatch]:
    """The best rows of one range of vectors for each query, among those that reach its least score."""
    terms, weights, cut, norms = (queries[k] for k in ("terms", "weights", "cut", "norms"))
    least = queries["least"].copy()
    top = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in norms]
    weight = np.zeros(queries["n_terms"], dtype=np.int64)

    def work(b: Bucket) -> None:
        for q in np.flatnonzero(norms * b.norm * MARGIN >= least):
            own, w = terms[cut[q] : cut[q + 1]], weights[cut[q] : cut[q + 1]]
            rows = b.candidates(own, w, int(least[q]))
            if len(rows):
                weight[own] = w
                score = b.scores(rows, weight)
                weight[own] = 0
                enough = score >= least[q]
                score, ids = np.r_[top[q][0], score[enough]], np.r_[top[q][1], b.ids[rows[enough]]]
                order = np.lexsort((ids, -score))[:best]
                top[q] = score[order], ids[order]
                if len(order) == best:
                    least[q] = max(least[q], score[order[-1]])

    held, n = [], 0
    for b in parts(batches, bucket):
        if n and n + b.num_rows > bucket:
            work(Bucket(held))
            held, n = [], 0
        held.append(b)
        n += b.num_rows
    if n:
        work(Bucket(held))
    for q, (score, ids) in enumerate(top):
        if len(score):
            yield pa.record_batch([pa.array(np.full(len(score), q)), pa.array([queries["ids"][q]] * len(score), pa.int64()), pa.array(ids), pa.array(score)], ["query", "item_id", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, *, best: int = BEST, bucket: int = BUCKET, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query, item_id, rank, doc_id, score): the ``best`` documents of score above 0 for each item; equal scores by id.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z
    lower-cased. Null or termless documents count nowhere and are never found;
    null or termless items find nothing. Every row is a document of its own,
    repeated rows too; a null id orders first. Equal rows of items count once;
    items of one id and different terms are ranked each for itself, told apart
    by ``query``. Very long texts are read whole, one at a time. Extra columns
    are not read. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    docs = texts_of(docs)
    asked = materialize(item_terms(items), "search-items")
    total = asked.agg(F.sum(F.size("terms") * 8)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    found, base = None, 0
    for block in range(blocks):
        rows = sorted(asked.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block).collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r.terms))
        part = search_block(docs, [r.item_id for r in rows], [np.array(r.terms, dtype=np.int64).view(np.uint64) for r in rows], best, bucket)
        part = part.withColumn("query", F.col("query") + F.lit(base))
        base += len(rows)
        found = part if found is None else found.unionByName(part)
    discard(asked)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc("doc_id")))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= best)
    return ranked.select("query", "item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def search_block(docs: DataFrame, ids: list, asked: list[np.ndarray], best: int, bucket: int) -> DataFrame:
    """What every range returns for one block of items."""
    spark = docs.sparkSession
    if not ids:
        return spark.createDataFrame([], HITS)
    vocabulary = np.unique(np.concatenate(asked))
    counted = materialize(term_counts(docs, vocabulary), "search-counts")
    n_docs, n_terms = (int(x or 0) for x in counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first())
    df = np.zeros(len(vocabulary), dtype=np.int64)
    held = counted.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()  # as many rows as the block has terms
    df[held.column(0).to_numpy()] = held.column(1).to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], dtype=np.int64)
    terms, weights = [], []
    for own in asked:
        t, c = np.unique(np.searchsorted(vocabulary, own), return_counts=True)
        terms.append(t)
        weights.append(c * weight[t])
    norms = np.array([math.sqrt(float((w.astype(np.float64) ** 2).sum())) for w in weights])
    queries = {"ids": ids, "terms": np.concatenate(terms), "weights": np.concatenate(weights), "cut": np.r_[0, np.cumsum([len(t) for t in terms])], "norms": norms, "least": np.ones(len(ids), dtype=np.int64), "n_terms": len(vocabulary)}
    vectors = with_impacts(counted, n_docs, n_terms)

    def run(some: DataFrame) -> DataFrame:
        sent = spark.sparkContext.broadcast(dict(queries))

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from search_range(batches, sent.value, best, bucket)

        return some.mapInArrow(kernel, HITS)

    seeds = run(vectors.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SEED_SHARE)) == 0))
    for r in top_k(seeds, ["query"], [F.desc("score"), F.asc("doc_id")], best).groupBy("query").agg(F.min("score").alias("s"), F.count("*").alias("c")).filter(F.col("c") == best).collect():  # a row a query
        queries["least"][r["query"]] = r.s
    order = [F.desc("norm"), F.asc("doc_id")]
    found = materialize(run(vectors.repartitionByRange(*order).sortWithinPartitions(*order)), "search-found")
    discard(counted)
    return found


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's ten best documents; odd rows as in :func:`search`."""
    found = search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) FILTER (len(w) > 0) AS nd, CAST(sum(len(w)) AS BIGINT) AS nt FROM d),
q AS MATERIALIZED (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY item_id, t),
v AS (SELECT DISTINCT t FROM q),
p AS MATERIALIZED (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) u JOIN v USING (t) GROUP BY doc_id, n, t),
f AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY t, nd),
i AS (SELECT doc_id, t, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt)) AS i FROM p, s),
x AS (SELECT item_id, doc_id, CAST(sum(c * w * i) AS BIGINT) AS score FROM q JOIN f USING (t) JOIN i USING (t) GROUP BY item_id, doc_id HAVING sum(c * w * i) > 0)
SELECT item_id, CAST(r AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM x) y WHERE r <= 10"""
