"""Near-duplicate groups by bottom-k sketches from one hash function.

Every document is a set of distinct shingles. One 64-bit hash orders all
shingles; a document keeps the k smallest of its own, where k = n -
ceil(threshold * n) + 1 grows with its size n. Two sets with a Jaccard
similarity of at least ``threshold`` share ceil(threshold * n) values or more,
so they cannot miss each other in their k smallest: the inverted lists of
retained values produce every link, with no probability of loss.

What keeps this bounded on real corpora:

* Documents with equal sets form a class first (a combinable aggregate), and
  only one representative of each class is searched.
* Shingles that very many documents hold (licence lines, shared passages) are
  ordered after all others. Any common order keeps the guarantee, so which
  shingles are called frequent is only a matter of cost; they are estimated
  from a sample of documents into a table of bounded size.
* An inverted list does not produce all its pairs. First each member meets
  the list's smallest id. Lists whose members are then still in several
  components pair the members outside the largest component with the others,
  where enough of both sets lies behind the list's value in the common order:
  in the list of the first value that two similar sets share it always does.
  Pairs inside a component can add nothing to the result.
* A fixed-size union sketch (the 64 smallest values) estimates the similarity
  of a candidate pair; pairs more than eight standard deviations below the
  threshold are dropped, the rest are verified on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm.textkit import NO_ID, Powers, fresh_name, join_counted, list_column, mix, parts, shingle_sets, texts_of
from massloom.operators.graph import connected_components
from massloom.plans.store import discard, materialize

SHINGLE = 5
#: Similarity as a ratio of integers, so that the comparison is exact.
NUM, DEN = 75, 100
UNION_SKETCH = 64
#: One document in so many is read for the table of frequent shingles; a
#: shingle counts as frequent from this many sampled documents on, and the
#: table holds the most frequent of them only.
SAMPLE_ONE_IN, FREQUENT_FROM, FREQUENT_MOST = 16, 4, 100_000
#: Members of an inverted list that meet others in one part of it.
LIST_PART = 2000
#: Bits of the map that tells which documents' texts are verified.
BITMAP_BITS = 1 << 23
SKETCHES = "doc_id long, n long, fp1 long, fp2 long, kept array<long>, union_sketch array<long>"


def frequent_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """The most frequent shingles of a sample of documents, ascending; at most FREQUENT_MOST."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = Powers()
        for b in parts(batches):
            yield pa.record_batch([list_column([s.view(np.int64) for _, s in shingle_sets(b.column(0), size, pows=pows)], np.int64, pa.int64())], ["v"])

    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE_ONE_IN)) == 0).select("text").distinct()
    counts = sample.mapInArrow(kernel, "v array<long>").select(F.explode("v").alias("v")).groupBy("v").agg(F.count("*").alias("c"))
    rows = counts.filter(F.col("c") >= FREQUENT_FROM).orderBy(F.desc("c"), "v").limit(FREQUENT_MOST).select("v").toArrow()
    return np.sort(rows.column(0).to_numpy().astype(np.int64).view(np.uint64))


def sketches(docs: DataFrame, size: int, num: int, den: int, frequent: Broadcast) -> DataFrame:
    """A row for each document: set size, set fingerprint, retained values, union sketch."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows, hot = Powers(), frequent.value
        for b in parts(batches):
            n, fp, kept, union = [], [], [], []
            for _, s in shingle_sets(b.column(1), size, pows=pows):
                n.append(len(s))
                fp.append((np.add.reduce(mix(s), dtype=np.uint64), np.bitwise_xor.reduce(mix(s * np.uint64(0xD6E8FEB86659FD93)), initial=np.uint64(0))))
                k = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                if len(hot) and len(s):
                    is_hot = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
                    cool = s[~is_hot][:k]
                    kept.append(np.concatenate([cool, s[is_hot][: k - len(cool)]]) if len(cool) < k else cool)
                else:
                    kept.append(s[:k])
                union.append(s[:UNION_SKETCH])
            prints = np.array(fp, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            lists = [list_column([x.view(np.int64) for x in col], np.int64, pa.int64()) for col in (kept, union)]
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), *lists], ["doc_id", "n", "fp1", "fp2", "kept", "union_sketch"])

    return docs.select("doc_id", "text").mapInArrow(kernel, SKETCHES)


def named_bits(pairs: DataFrame) -> Broadcast:
    """A bitmap of fixed size over the hashed ids that pairs name.

    It tells a scan which documents may be needed, so that the others are not
    shuffled. Where it fills up it passes more documents, and the joins that
    follow drop them.
    """
    bit = F.pmod(F.xxhash64("id"), F.lit(BITMAP_BITS))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(bit.alias("bit")).selectExpr("int(bit div 64) AS w", "shiftleft(1L, int(bit % 64)) AS m")
    words = ids.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()  # at most BITMAP_BITS / 64 rows
    bits = np.zeros(BITMAP_BITS // 64, dtype=np.uint64)
    bits[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return pairs.sparkSession.sparkContext.broadcast(bits)


def hashed(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_BITS)).alias("bit"), "doc_id", *columns)


def named(batch: pa.RecordBatch, bits: np.ndarray) -> pa.Array:
    at = batch.column(0).to_numpy()
    return pa.array(np.flatnonzero(bits[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)))


def similar_enough(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Drop the pairs whose union sketch puts them far below the threshold.

    The UNION_SKETCH smallest values of the union of two sets are a uniform
    sample of it, and those in both sketches' overlap estimate the similarity.
    """
    if pairs.isEmpty():
        return pairs
    sent = named_bits(pairs)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            yield pa.RecordBatch.from_arrays(b.take(named(b, sent.value)).columns[1:], names=["doc_id", "n", "k"])

    sketch = materialize(hashed(sets, "n", "union_sketch").mapInArrow(kernel, "doc_id long, n long, k array<long>"), "neardup-unions")
    both = pairs.join(sketch.toDF("b", "nb", "kb"), "b").join(sketch.toDF("a", "na", "ka"), "a")
    k = F.least(F.lit(UNION_SKETCH), F.size(F.array_union("ka", "kb")))
    # the k smallest unsigned values of the union: flipping the top bit orders as unsigned
    flip = lambda c: F.transform(c, lambda v: v.bitwiseXOR(F.lit(NO_ID)))
    union = F.sort_array(flip(F.array_union("ka", "kb")))
    shared = F.size(F.array_intersect(F.slice(union, 1, k), flip(F.array_intersect("ka", "kb"))))
    t = num / den
    slack = 8 * (t * (1 - t)) ** 0.5
    enough = shared >= F.lit(t) * k - F.lit(slack) * F.sqrt(k)
    left = both.filter(F.col("na") * num <= F.col("nb") * den).filter(F.col("nb") * num <= F.col("na") * den).filter(enough)
    left = materialize(left.select("a", "b"), "neardup-checked")
    discard(sketch)
    return left


def sets_of(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, s): the full shingle sets of the documents that pairs name, and of few others."""
    sent = named_bits(pairs)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = Powers()
        for b in parts(batches):
            rows = named(b, sent.value)
            sets = [s.view(np.int64) for _, s in shingle_sets(b.column(2).take(rows), size, pows=pows)]
            yield pa.record_batch([b.column(1).take(rows), list_column(sets, np.int64, pa.int64())], ["doc_id", "s"])

    return materialize(hashed(docs, "text").mapInArrow(kernel, "doc_id long, s array<long>"), "neardup-sets")


def verify(pairs: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough.

    Both sets travel with the pair; their sizes differ by the threshold at
    most, so a document with very many partners costs each pair no more than
    the partner's own set does, and its pairs can be split over tasks.
    """
    if pairs.isEmpty():
        return pairs
    sets = sets_of(pairs, docs, size)
    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa") + F.size("sb") - shared
    links = materialize(both.filter(shared * den >= union * num).select("a", "b"), "neardup-links")
    discard(sets)
    return links


def near_duplicates(docs: DataFrame, *, size: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Two documents are linked when ``den * |A and B| >= num * |A or B|`` over
    their shingle sets; component_id is the smallest doc_id reachable.
    Documents without words have no shingles and are linked with nothing.
    Rows of the same doc_id and the same text each get the row's result; rows
    of the same doc_id and different texts are linked through that id. A null
    doc_id takes part as the smallest id and comes back as null. Words and sets
    are compared by hash: shingles by 64 bits, equal sets by size and 128 bits,
    links by all 64-bit shingles of both sets. Extra columns are not read. Very
    long texts are read whole, one at a time. An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    docs = texts_of(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, size))
    every = materialize(sketches(docs, size, num, den, frequent), "neardup-sketches")
    key = ["n", "fp1", "fp2"]
    wordy = every.filter("n > 0").select("doc_id", *key)
    rows_in = every.count()
    several = materialize(wordy.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).filter("c > 1"), "neardup-several")
    classed = materialize(join_counted(wordy, several, key, rows_in).select("doc_id", "rep"), "neardup-classes")
    same = classed.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    # ids that stand for nothing but copies; a repeated id with a text of its own stays searchable
    held = wordy.groupBy("doc_id").agg(F.count("*").alias("rows"))
    copies = classed.filter("doc_id <> rep").groupBy("doc_id").agg(F.count("*").alias("gone")).join(held, "doc_id").filter("gone = rows").select("doc_id")

    rows = every.select("doc_id", F.posexplode("kept").alias("pos", "v"))
    lists = rows.groupBy("v").agg(F.count("*").alias("len"), F.min("doc_id").alias("pivot")).filter("len > 1").drop("len")
    live = materialize(rows.join(lists, "v").select("v", "doc_id", "pos", "pivot"), "neardup-lists")
    stars = live.filter("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = materialize(stars.join(copies.withColumnRenamed("doc_id", "b"), "b", "left_anti"), "neardup-stars")
    checked = similar_enough(stars, every, num, den)
    links = verify(checked, docs, size, num, den)
    first = connected_components(links, "a", "b")

    # lists that still hold several components: members outside the largest meet all others
    searched = live.select("v", "doc_id", "pos").join(copies, "doc_id", "left_anti")
    placed = searched.join(first, searched.doc_id == first.id, "left").select("v", "doc_id", "pos", F.coalesce("component", "doc_id").alias("c"))
    split = placed.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("v")
    open_lists = materialize(placed.join(split, "v").join(every.select("doc_id", "n"), "doc_id").select("v", "doc_id", "pos", "n", "c"), "neardup-open")
    sizes = open_lists.groupBy("v", "c").agg(F.count("*").alias("m")).groupBy("v").agg(F.max(F.struct("m", "c"))["c"].alias("largest"), F.sum("m").alias("len"))
    # a long list is dealt over parts, and members meet those of like size only
    deal = F.ceil(F.col("len") / LIST_PART).cast("int")
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(den / num)) * (1 + 1e-9))).cast("int")
    open_lists = open_lists.join(sizes, "v").withColumn("step", step).withColumn("deal", deal).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("deal")).cast("int")).drop("len")
    few = open_lists.filter("c <> largest").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("deal") - 1))).withColumn("step", F.explode(F.array(F.col("step") - 1, "step", F.col("step") + 1)))
    few = few.select("v", "part", "step", F.col("doc_id").alias("x"), F.col("pos").alias("px"), F.col("n").alias("nx"), F.col("c").alias("cx"))
    fits = (F.col("c") != F.col("cx")) & (F.col("nx") * num <= F.col("n") * den) & (F.col("n") * num <= F.col("nx") * den)
    # in the list of the first value that two sets share, all they share is still ahead in both
    ahead = F.least(F.col("n") - F.col("pos"), F.col("nx") - F.col("px")) * (num + den) >= (F.col("n") + F.col("nx")) * num
    cross = few.join(open_lists, ["v", "part", "step"]).filter(fits & ahead).select(F.least("x", "doc_id").alias("a"), F.greatest("x", "doc_id").alias("b")).distinct()
    cross = materialize(cross.join(stars, ["a", "b"], "left_anti"), "neardup-cross")
    more = similar_enough(cross, every, num, den)
    found = verify(more, docs, size, num, den)

    groups = connected_components(links.unionByName(found).unionByName(same), "a", "b")
    discard(several, classed, live, stars, checked, links, open_lists, cross, more, found)
    out = every.select("doc_id", "n").join(groups, every.doc_id == groups.id, "left")
    real = lambda c: F.when(c != NO_ID, c)
    group = F.coalesce("component", "doc_id")
    return out.select(real(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(group).alias("component_id"), (F.col("doc_id") == group).alias("kept"))


def drop_by_row(docs: DataFrame, **how) -> DataFrame:
    """``drop_near_duplicates`` where rows share an id: each gets a key, held in a copy of the table."""
    row = fresh_name(docs.columns, "_row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "neardup-rows")
    doc_id = F.col("doc_id").cast("long")
    keyed = rows.select(F.col(row).alias("k"), F.struct(doc_id.isNotNull(), F.coalesce(doc_id, F.lit(NO_ID)), F.col(row).alias("k")).alias("rank"))
    groups = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), **how).select(F.col("doc_id").alias("k"), "component_id")
    first = groups.join(keyed, "k").groupBy("component_id").agg(F.min("rank")["k"].alias(row))
    return rows.join(materialize(first.select(row), "neardup-first"), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """One row of each group of ``docs``, that of the smallest doc_id, with its columns.

    Every row is a document of its own, whatever its id: of copies under one
    id one row stays, and a row does not go because another row of its id does.
    A null doc_id is the smallest; of rows of one id in a group the first read
    stays. Rows without words, null texts among them, all stay. Columns may
    have any names. Very long texts are read whole, one at a time. An empty
    table gives no rows.
    """
    if not docs.groupBy(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id")).count().filter("count > 1").isEmpty():
        return drop_by_row(docs, **how)
    gone = fresh_name(docs.columns, "_gone")
    ids = near_duplicates(docs, **how).filter("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(ids, F.col("doc_id").cast("long") == F.col(gone), "left_anti")


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups over all documents: five words, similarity 0.75; odd rows as in :func:`near_duplicates`."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)])
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
g AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS v FROM d),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS m FROM g a JOIN g b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * m >= 75 * (na + nb - m)),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(x, y) AS (SELECT a, b FROM both_ways UNION SELECT r.x, t.b FROM reach r JOIN both_ways t ON r.y = t.a),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low.y, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(low.y, d.doc_id)) AS kept
FROM d LEFT JOIN low ON d.doc_id = low.x"""
