"""Line dedup by range-partitioned line hashes with a secondary sort.

1. The documents are scanned once; each line whose key has ``LEAST`` code
   points or more leaves a 128-bit hash of the key with its place.
2. The hashes are range-partitioned by hash, document and position and sorted
   in that order, so a key's places stand in a row, the smallest document
   first. The place is part of the range bounds: a line that a third of all
   documents hold is cut over as many ranges as it fills.
3. Each range is streamed: the document of a key's first place keeps its lines,
   all later documents lose theirs. A range cannot tell where its first key
   began, so its lines stay open and are settled by the heads of the runs at
   the ranges' ends, two rows a range.
4. What comes back is a compressed bitmap of the lines to keep for each
   document, no text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm.textkit import NO_ID, list_column, parts, texts_of
from massloom.plans.store import discard, materialize

LEAST = 10
BLANK = b" \t\n\v\f\r"
KEY = ["doc_id", "h"]
DROP, OPEN, HEAD = 0, 1, 2


def apart(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text) with null ids as the smallest long and null texts as empty; h is a hash of the text where ids repeat with different texts, else 0."""
    docs = texts_of(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    if docs.groupBy("doc_id").agg((F.min("h") == F.max("h")).alias("one")).filter("not one").isEmpty():
        docs = docs.withColumn("h", F.lit(0).cast("long"))
    return docs


def key_hash(line: bytes, least: int = LEAST) -> bytes | None:
    """The hash of a line's key: stripped, A-Z lower-cased; None for a key of fewer than ``least`` code points."""
    key = line.strip(BLANK).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode()) < least:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def scan_lines(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, h, n_lines, sha, k1, k2, at): line count, digest of the text, and hash halves and line numbers of the lines that have a key."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            lines, keys, ats = [], [], []
            for text in b.column(3).to_pylist():
                split = text.encode().split(b"\n")
                hashed = [(i, k) for i, line in enumerate(split) if (k := key_hash(line, least))]
                lines.append(len(split))
                keys.append(np.frombuffer(b"".join(k for _, k in hashed), dtype=np.int64).reshape(-1, 2))
                ats.append(np.array([i for i, _ in hashed], dtype=np.int32))
            halves = [list_column([k[:, j] for k in keys], np.int64, pa.int64()) for j in (0, 1)]
            yield pa.record_batch([*(b.column(j) for j in range(3)), pa.array(lines, pa.int64()), *halves, list_column(ats, np.int32, pa.int32())], ["doc_id", "h", "sha", "n_lines", "k1", "k2", "at"])

    docs = docs.select(*KEY, F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "text")
    return docs.mapInArrow(kernel, "doc_id long, h long, sha string, n_lines long, k1 array<long>, k2 array<long>, at array<int>")


def stream_runs(places: DataFrame) -> DataFrame:
    """(kind, k1, k2, doc_id, h, at) of the places, ranged and sorted: lines to drop, lines of a range's first key, and heads of first and last keys."""
    columns = ["k1", "k2", *KEY, "at"]
    names = ["kind", *columns]

    def rows(kind: int, values: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(values.shape[1], kind, dtype=np.int32)), *(pa.array(v) for v in values)], names)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, opened = None, True  # the place that began the run, and whether that run is the range's first
        for b in batches:
            if not b.num_rows:
                continue
            v = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
            new = np.ones(v.shape[1], dtype=bool)
            new[1:] = (v[:2, 1:] != v[:2, :-1]).any(axis=0)
            if head is None:
                head = v[:, 0].copy()
                yield rows(HEAD, v[:, :1])
            new[0] = bool((v[:2, 0] != head[:2]).any())
            run = np.cumsum(new)  # 0: the run that came in with the batch
            heads = np.concatenate([head[:, None], v[:, new]], axis=1)[:, run]
            first = (run == 0) & opened
            later = ((v[2:4] != heads[2:4]).any(axis=0)) & ~first
            if first.any():
                yield rows(OPEN, v[:, first])
            if later.any():
                yield rows(DROP, v[:, later])
            head, opened = heads[:, -1].copy(), opened and not run[-1]
        if head is not None:
            yield rows(HEAD, head[:, None])

    ranged = places.select(*columns).repartitionByRange(*columns).sortWithinPartitions(*columns)
    return ranged.mapInArrow(kernel, "kind int, k1 long, k2 long, doc_id long, h long, at long")


def pack_bits(keep: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def unpack_bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), dtype=np.uint8), count=n).astype(bool)


def line_bitmaps(docs: DataFrame, *, least: int = LEAST) -> DataFrame:
    """(doc_id, h, sha, n_lines, n_dropped, keep): for each document row the compressed bitmap of the lines to keep.

    A line's key is the line without spaces at both ends, A-Z lower-cased. Keys
    of at least ``least`` code points in two or more documents lose all their
    lines except those of the first document that holds them, repeats in it
    included. sha is the digest of the whole text, h as in :func:`apart`.

    Null and empty texts are one empty line. A null id (here the smallest long)
    orders first; rows of one id and text are one document, rows of one id and
    different texts are documents ordered by a hash of the text. Very long
    texts are read whole, one at a time. Extra columns are not read. An empty
    table gives an empty result.
    """
    scanned = materialize(scan_lines(apart(docs), least), "lines-scan")
    places = scanned.select(*KEY, F.explode(F.arrays_zip("k1", "k2", "at")).alias("p")).select("p.k1", "p.k2", *KEY, "p.at")
    marked = materialize(stream_runs(places), "lines-runs")
    first = F.struct(*KEY)
    heads = marked.filter(F.col("kind") == HEAD).groupBy("k1", "k2").agg(F.min(first).alias("first"))  # at most two rows a range
    settled = marked.filter(F.col("kind") == OPEN).join(F.broadcast(heads), ["k1", "k2"]).filter(first != F.col("first"))
    gone = marked.filter(F.col("kind") == DROP).select(*KEY, "at").unionByName(settled.select(*KEY, "at"))
    lists = gone.groupBy(*KEY).agg(F.collect_set(F.col("at").cast("int")).alias("gone"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            dropped, bits = [], []
            for n, lost in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                keep = np.ones(n, dtype=bool)
                keep[np.array(lost or [], dtype=np.int64)] = False
                dropped.append(n - int(keep.sum()))
                bits.append(pack_bits(keep))
            yield pa.record_batch([*b.columns[:4], pa.array(dropped, pa.int64()), pa.array(bits, pa.binary())], ["doc_id", "h", "sha", "n_lines", "n_dropped", "keep"])

    joined = scanned.select(*KEY, "sha", "n_lines").join(lists, KEY, "left")
    out = materialize(joined.mapInArrow(kernel, "doc_id long, h long, sha string, n_lines long, n_dropped long, keep binary"), "lines-bitmaps")
    discard(scanned, marked)
    return out


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, h, kept_text): what is left of the documents that lose lines, one row for each id and text."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            texts = []
            for text, n, bits in zip(*(b.column(j).to_pylist() for j in (2, 3, 4)), strict=True):
                lines = text.split("\n")
                texts.append("\n".join([lines[i] for i in np.flatnonzero(unpack_bits(bits, n))]))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string())], ["doc_id", "h", "kept_text"])

    changed = bitmaps.filter("n_dropped > 0").select(*KEY, "n_lines", "keep").dropDuplicates(KEY)
    joined = apart(docs).join(changed, KEY).select(*KEY, "text", "n_lines", "keep")
    return joined.mapInArrow(kernel, "doc_id long, h long, kept_text string")


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, dropped lines, and the digest of the lines kept; odd rows as in :func:`line_bitmaps`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bitmaps = line_bitmaps(docs)
    changed = apply_bitmaps(docs, bitmaps).select(*KEY, F.sha2(F.col("kept_text").cast("binary"), 256).alias("new")).dropDuplicates(KEY)
    out = bitmaps.select(*KEY, "n_lines", "n_dropped", "sha").join(changed, KEY, "left")
    return out.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_lines", "n_dropped", F.coalesce("new", "sha").alias("kept_sha256"))


ORACLE_SQL = r"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM d),
k AS MATERIALIZED (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.doc_id, i, line, f.first IS NOT NULL AND f.first <> k.doc_id AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""
