"""Exact substring dedup by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one document. Its minimiser is the
smallest hash among the ``SEED``-word runs inside it (the leftmost on ties), so
it depends on the window's words alone. Consecutive windows that share one
minimiser occurrence form a super-k-mer.

1. The documents are scanned and each super-k-mer leaves only its minimiser and
   place. A window that occurs twice has a minimiser that does, so super-k-mers
   whose minimiser is alone are done.
2. The others travel as one packed string each to the bucket of their
   minimiser. Sorted by minimiser and streamed, each bucket finds for every
   window the earliest start, comparing words themselves, and emits the word
   ranges of later starts. Minimisers shared by very many super-k-mers are not
   gathered: equal packed strings are grouped, by digest, with a combinable
   minimum, so all but the earliest of them are later as a whole, and only the
   earliest ones' windows are grouped in turn.
3. The ranges return to their documents, where the words go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm.textkit import NO_ID, Powers, byte_codes, is_gap, join_counted, list_column, parts, runs, slices, span_hashes, texts_of, window_hashes
from massloom.plans.store import discard, materialize

WINDOW = 20
SEED = 5
#: A bucket of so many packed strings fits in a task (about 100 MB with its
#: windows); a minimiser with more of them is grouped by string and by window.
HOT = 50_000
KEY = ["doc_id", "h"]


def first_smallest(h: np.ndarray, width: int) -> np.ndarray:
    """The index of the smallest of each ``width`` consecutive values, the leftmost on ties."""
    n = len(h) - width + 1
    best, at = h[:n].copy(), np.zeros(n, dtype=np.int64)
    for j in range(1, width):
        less = h[j : j + n] < best
        np.copyto(best, h[j : j + n], where=less)
        at[less] = j
    return at + np.arange(n)


def super_kmers(texts: pa.Array, window: int, seed: int, pows: Powers) -> Iterator[tuple]:
    """(row, bytes of the slice, word starts, word ends, first windows, window counts, minimisers) for each row; word numbers count from the row's first."""
    codes, gap = byte_codes(), is_gap()
    for first, last, data, offsets in slices(texts):
        start, end, at = runs(~gap[data], offsets)
        seeds = window_hashes(span_hashes(data, start, end, codes, pows), seed)
        small = first_smallest(seeds, window - seed + 1) if len(seeds) > window - seed else np.zeros(0, dtype=np.int64)
        for row in range(last - first):
            a, b = int(at[row]), int(at[row + 1])
            n = b - a - window + 1
            if n > 0:
                own = small[a : a + n]
                cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                yield first + row, data, start[a:b], end[a:b], cut, np.diff(np.r_[cut, n]), seeds[own[cut]]
            else:
                yield first + row, data, start[a:b], end[a:b], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)


def scan(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(doc_id, h, n_words, sha, cut, m): word count, digest of all words, first windows and minimisers of the super-k-mers."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = Powers()
        for b in parts(batches):
            words, sha, cuts, minis = [], [], [], []
            for text, (_, _, start, _, cut, _, m) in zip(b.column(2).to_pylist(), super_kmers(b.column(2), window, seed, pows), strict=True):
                words.append(len(start))
                sha.append(hashlib.sha256(b" ".join((text or "").encode().split())).hexdigest())
                cuts.append(cut)
                minis.append(m.view(np.int64))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(words, pa.int64()), pa.array(sha, pa.string()), list_column(cuts, np.int32, pa.int32()), list_column(minis, np.int64, pa.int64())], ["doc_id", "h", "n_words", "sha", "cut", "m"])

    return docs.mapInArrow(kernel, "doc_id long, h long, n_words long, sha string, cut array<int>, m array<long>")


def pack(docs: DataFrame, live: DataFrame, window: int, seed: int) -> DataFrame:
    """(m, hot, doc_id, h, start, n, packed): the words of each live super-k-mer, joined by single spaces, and their number."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = Powers()
        for b in parts(batches):
            places, hots = b.column(3).to_pylist(), b.column(4).to_pylist()
            rows, ms, hot, starts, ns, packed = [], [], [], [], [], []
            for row, data, ws, we, cut, n, m in super_kmers(b.column(2), window, seed, pows):
                for at, is_hot in zip(places[row], hots[row], strict=True):
                    k = int(np.searchsorted(cut, at))
                    lo, hi = at, at + int(n[k]) + window - 1
                    rows.append(row)
                    ms.append(int(m[k].view(np.int64)))
                    hot.append(is_hot)
                    starts.append(lo)
                    ns.append(hi - lo)
                    packed.append(b" ".join(data[ws[lo] : we[hi - 1]].tobytes().split()))
            take = pa.array(rows, pa.int64())
            yield pa.record_batch([pa.array(ms, pa.int64()), pa.array(hot, pa.bool_()), b.column(0).take(take), b.column(1).take(take), pa.array(starts, pa.int32()), pa.array(ns, pa.int32()), pa.array(packed, pa.binary())], ["m", "hot", "doc_id", "h", "start", "n", "packed"])

    return docs.join(live, KEY).select(*KEY, "text", "at", "hot").mapInArrow(kernel, "m long, hot boolean, doc_id long, h long, start int, n int, packed binary")


def windows_of(packed: bytes, window: int) -> list[bytes]:
    words = packed.split(b" ")
    if len(words) == window:
        return [packed]
    at = [0]
    for w in words:
        at.append(at[-1] + len(w) + 1)
    return [packed[at[i] : at[i + window] - 1] for i in range(len(words) - window + 1)]


def later_ranges(group: list[tuple], window: int) -> Iterator[tuple[int, int, int, int]]:
    """(doc_id, h, from word, to word) for the windows of a bucket that also start earlier.

    The windows are sorted by their words, then by place: of each run of equal
    ones the first is the earliest, all others are later.
    """
    windows = sorted((w, d, h, s + i) for d, h, s, p in group for i, w in enumerate(windows_of(p, window)))
    found, words, first = set(), None, None
    for w, *place in windows:
        if w != words:
            words, first = w, place
        elif place != first:  # a repeated row is the same place
            found.add(tuple(place))
    later, k = sorted(found), 0
    while k < len(later):
        d, h, lo = later[k]
        hi = lo
        while k < len(later) and later[k] == (d, h, hi):
            k, hi = k + 1, hi + 1
        yield d, h, lo, hi - 1 + window


def repeated_ranges(packed: DataFrame, window: int) -> DataFrame:
    """(doc_id, h, lo, hi): ranges of words under windows that start earlier elsewhere."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, mini = [], None
        names = ["doc_id", "h", "lo", "hi"]

        def batch(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) or [[]] * 4
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names)

        for b in parts(batches):
            found: list[tuple] = []
            for m, *place in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if m != mini:
                    if len(group) > 1:
                        found += later_ranges(group, window)
                    group, mini = [], m
                group.append(tuple(place))
            yield batch(found)
        yield batch(list(later_ranges(group, window)) if len(group) > 1 else [])

    cold = packed.filter("not hot").select("m", *KEY, "start", "packed").repartition("m").sortWithinPartitions("m")
    out = cold.mapInArrow(kernel, "doc_id long, h long, lo int, hi int")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            rows, starts, ws = [], [], []
            for row, (s, p) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                own = windows_of(p, window)
                ws += own
                rows += [row] * len(own)
                starts += range(s, s + len(own))
            take = pa.array(rows, pa.int64())
            yield pa.record_batch([b.column(0).take(take), b.column(1).take(take), pa.array(starts, pa.int32()), pa.array(ws, pa.binary())], ["doc_id", "h", "start", "w"])

    place = F.struct(*KEY, "start")
    # equal strings and windows meet by digest, those of very many places by broadcast
    often = packed.filter("hot").select(*KEY, "start", "n", "packed", F.md5("packed").alias("p"))
    total, windows = often.agg(F.count("*"), F.sum(F.col("n") - (window - 1))).first()
    heads = materialize(often.groupBy("p").agg(F.min(F.struct(place.alias("at"), "packed")).alias("s"), F.count("*").alias("c")).select("p", F.col("s.at").alias("first"), "s.packed", "c"), "substr-heads")
    whole = join_counted(often.drop("packed"), heads.drop("packed"), ["p"], total or 0).filter(place != F.col("first")).select(*KEY, F.col("start").alias("lo"), (F.col("start") + F.col("n")).alias("hi"))
    hot = heads.select("first.*", "packed").mapInArrow(split, "doc_id long, h long, start int, w binary")
    hot = hot.select(*KEY, "start", F.md5("w").alias("w"))
    earliest = hot.groupBy("w").agg(F.min(place).alias("first"), F.count("*").alias("c")).filter("c > 1")
    later = join_counted(hot, earliest, ["w"], windows or 0).filter(place != F.col("first")).select(*KEY, F.col("start").alias("lo"), (F.col("start") + window).alias("hi"))
    return out.unionByName(whole).unionByName(later)


def remove_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, h, n_removed, kept_text): the texts that lose words, with the rest joined by single spaces."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            gone, kept = [], []
            for text, lo, hi in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                words = text.encode().split()
                depth = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(depth, lo, 1)
                np.add.at(depth, hi, -1)
                keep = np.cumsum(depth[:-1]) == 0
                gone.append(len(words) - int(keep.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(keep)]).decode())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "h", "n_removed", "kept_text"])

    lists = ranges.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("r")).select(*KEY, "r.lo", "r.hi")
    return docs.join(lists, KEY).select(*KEY, "text", "lo", "hi").mapInArrow(kernel, "doc_id long, h long, n_removed long, kept_text string")


def dedup_substrings(docs: DataFrame, *, window: int = WINDOW, seed: int = SEED, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Remove every word under a window whose words also start earlier.

    Earlier means a smaller doc_id, or the same document and an earlier start;
    windows are judged on the input. Returns (scanned, changed): for each row
    doc_id, h, n_words and the digest of all its words, and for each row that
    loses words doc_id, h, n_removed and kept_text; h is a hash of the text where
    ids repeat with different texts, else 0.

    Null texts count as empty. A null doc_id orders before all others. Rows of
    equal doc_id and text are one document and get one result; rows of equal
    doc_id and different texts are documents ordered by h. Texts of fewer words
    than a window lose nothing. An empty table gives empty results.
    """
    docs = texts_of(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    if docs.groupBy("doc_id").agg((F.min("h") == F.max("h")).alias("one")).filter("not one").isEmpty():
        docs = docs.withColumn("h", F.lit(0).cast("long"))  # the id tells documents apart: carry no more
    scanned = materialize(scan(docs, window, seed), "substr-scan")
    seen = scanned.select(*KEY, F.explode(F.arrays_zip("m", F.col("cut").alias("at"))).alias("s")).select("s.m", "s.at", *KEY)
    total = scanned.agg(F.sum(F.size("m"))).first()[0] or 0
    shared = materialize(seen.groupBy("m").agg(F.count("*").alias("c")).filter("c > 1").withColumn("hot", F.col("c") > hot), "substr-shared")
    live = join_counted(seen, shared, ["m"], total).groupBy(*KEY).agg(F.collect_set(F.struct("at", "hot")).alias("l")).select(*KEY, "l.at", "l.hot")
    live = materialize(live, "substr-live")
    packed = materialize(pack(docs, live, window, seed), "substr-packed")
    ranges = materialize(repeated_ranges(packed, window), "substr-ranges")
    discard(shared, live, packed)
    return scanned, remove_ranges(docs, ranges)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, removed words, and the digest of the kept words; odd rows as in :func:`dedup_substrings`."""
    scanned, changed = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    changed = changed.select(*KEY, "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("new")).dropDuplicates(KEY)
    out = scanned.select(*KEY, "n_words", "sha").join(changed, KEY, "left")
    return out.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("new", "sha").alias("kept_sha256"))


ORACLE_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
g AS MATERIALIZED (SELECT s.doc_id, i, md5(array_to_string(w[i:i+19], ' ')) AS k FROM s JOIN d USING (doc_id)),
f AS (SELECT k, min((doc_id, i)) AS first FROM g GROUP BY k HAVING count(*) > 1),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM g JOIN f USING (k) WHERE (doc_id, i) <> first),
l AS (SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [w[x] for x in range(1, len(w) + 1) if NOT list_contains(gone, x)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN l ON d.doc_id = l.doc_id"""
