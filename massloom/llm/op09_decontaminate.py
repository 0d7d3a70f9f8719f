"""Benchmark decontamination by size-partitioned MinHash containment search.

An item with n distinct shingles counts as found in a document that holds at
least ``ceil(threshold * n)`` of them. Items are partitioned by size (powers
of two). One hash function orders the shingles of an item; its retained values
are the n - ceil(threshold * n) + 1 smallest. A document that holds enough of
the item must hold one of these, whatever its own length: only so many values
can be missing. So the search loses nothing, and the short item costs the same
in a document of a million words. Candidates are verified by counting the
item's whole shingle set in the document's.

An item of fewer words than a shingle is one shingle of its whole sequence.
Where a block has items of so few words, the documents' runs of as many words
count as shingles too, so such an item is found inside longer documents.

Documents are read once and never shuffled. Items travel to the tasks in
blocks of at most ``block_bytes`` of shingles, one block at a time; a larger
benchmark takes more passes, whose results are written before the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm.textkit import Powers, list_column, parts, shingle_sets, texts_of
from massloom.plans.shipping import Shipped, ship
from massloom.plans.store import materialize

SHINGLE = 5
THRESHOLD = 0.75
#: Bytes of shingle hashes that one block of items may send to each task.
BLOCK_BYTES = 16 << 20
PAIRS = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"


class ItemIndex:
    """Shingle sets of a block of items with the inverted list of retained values, by size partition."""

    def __init__(self, ids: list, sets: list[np.ndarray], threshold: float, short: tuple[int, ...] = ()) -> None:
        self.ids, self.sets, self.short = ids, sets, short
        self.need = np.array([max(1, int(np.ceil(threshold * len(s) - 1e-9))) for s in sets], dtype=np.int64)
        self.partitions = []
        by_size: dict[int, list[int]] = {}
        for k, s in enumerate(sets):
            if len(s):
                by_size.setdefault(len(s).bit_length(), []).append(k)
        for members in by_size.values():
            values = np.concatenate([sets[k][: len(sets[k]) - self.need[k] + 1] for k in members])
            owners = np.repeat(members, [len(sets[k]) - self.need[k] + 1 for k in members])
            order = np.argsort(values, kind="stable")
            self.partitions.append((min(int(self.need[k]) for k in members), values[order], owners[order]))

    def search(self, held: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, shared shingles) for every item that the sorted shingle set ``held`` contains."""
        for least, values, owners in self.partitions:
            if len(held) < least:
                continue
            if len(held) < len(values):
                lo, hi = np.searchsorted(values, held, side="left"), np.searchsorted(values, held, side="right")
                hit = np.flatnonzero(hi > lo)
                found = np.unique(np.concatenate([owners[lo[i] : hi[i]] for i in hit])) if len(hit) else []
            else:
                at = np.minimum(np.searchsorted(held, values), len(held) - 1)
                found = np.unique(owners[held[at] == values])
            for k in found:
                own = self.sets[k]
                at = np.minimum(np.searchsorted(held, own), len(held) - 1)
                shared = int(np.count_nonzero(held[at] == own))
                if shared >= self.need[k]:
                    yield int(k), shared


def item_sets(items: DataFrame, size: int) -> DataFrame:
    """(item_id, shingles, words): the distinct shingle hashes of each item, ascending, and the number of words of an item of fewer than a shingle has, else 0."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = Powers()
        for b in parts(batches):
            sets = [s for _, s in shingle_sets(b.column(1), size, pows=pows)]
            words = [len((t or "").encode().split()) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), list_column([s.view(np.int64) for s in sets], np.int64, pa.int64()), pa.array([n if n < size else 0 for n in words], pa.int32())], ["item_id", "shingles", "words"])

    return texts_of(items, doc_id="item_id").mapInArrow(kernel, "item_id long, shingles array<long>, words int")


def item_blocks(items: DataFrame, size: int, threshold: float, block_bytes: int) -> tuple[int, Iterator[Shipped]]:
    """(number of blocks, the index of each block of items): made and sent to the executors one after another."""
    spark = items.sparkSession
    sets = materialize(item_sets(items, size).filter("size(shingles) > 0").distinct(), "decontaminate-items")
    total = sets.agg(F.sum(F.size("shingles") * 8)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))

    def make() -> Iterator[Shipped]:
        for block in range(blocks):
            rows = sets.filter(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(blocks)) == block).collect()
            index = ship(spark, ItemIndex([r.item_id for r in rows], [np.array(r.shingles, dtype=np.int64).view(np.uint64) for r in rows], threshold, tuple(sorted({r.words for r in rows} - {0}))))
            yield index
            if blocks > 1:  # what it served is written by now
                index.unpersist()

    return blocks, make()


def find_contained(docs: DataFrame, items: DataFrame, *, size: int = SHINGLE, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each (document row, item) where the document contains the item.

    ``docs`` has doc_id and text, ``items`` has item_id and text. Null or
    wordless texts contain nothing and are contained in nothing. Repeated
    document rows give repeated pairs; repeated item rows count once; items of
    equal id and different text are matched each for itself. Null ids are
    carried through; an item held at exactly the threshold counts; extra
    columns are not read. Very long texts are read whole, one at a time. Empty
    tables give an empty result.
    """
    docs = texts_of(docs)

    def search(index) -> DataFrame:
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pows, ix = Powers(), index.value
            for b in parts(batches):
                rows, found, shared = [], [], []
                for row, held in shingle_sets(b.column(1), size, pows=pows, also=ix.short):
                    for k, n in ix.search(held):
                        rows.append(row)
                        found.append(k)
                        shared.append(n)
                lengths = [len(ix.sets[k]) for k in found]
                yield pa.record_batch(
                    [
                        b.column(0).take(pa.array(rows, pa.int64())),
                        pa.array([ix.ids[k] for k in found], pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(shared, pa.int64()),
                        pa.array([n / m for n, m in zip(shared, lengths, strict=True)], pa.float64()),
                    ],
                    ["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"],
                )

        return docs.mapInArrow(kernel, PAIRS)

    blocks, made = item_blocks(items, size, threshold, block_bytes)
    out = None
    for index in made:
        part = search(index) if blocks == 1 else materialize(search(index), "decontaminate-found")
        out = part if out is None else out.unionByName(part)
    return out


def contaminated_ids(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """(doc_id, item_ids): documents that contain an item, with the items in order."""
    return find_contained(docs, items, **how).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))


def drop_contaminated(docs: DataFrame, items: DataFrame, *, size: int = SHINGLE, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that contain no item, with their columns.

    Each row is judged by its own text, whatever other rows share its id; null
    and wordless texts contain nothing and stay, repeated rows share a fate,
    and an item held at exactly the threshold counts. Columns may have any
    names. Very long texts are read whole, one at a time. An empty table, on
    either side, takes nothing away.
    """

    def clean(index: Shipped):
        @F.arrow_udf("boolean")
        def contains_none(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            pows = Powers()
            for texts in batches:
                out = np.ones(len(texts), dtype=bool)
                for row, held in shingle_sets(texts, size, pows=pows, also=index.value.short):
                    out[row] = next(index.value.search(held), None) is None
                yield pa.array(out)

        return contains_none(F.col("text").cast("string"))

    blocks, made = item_blocks(items, size, threshold, block_bytes)
    for index in made:
        left = docs.filter(clean(index))
        docs = left if blocks == 1 else materialize(left, "decontaminate-left")
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that contains a benchmark item, with the item and the shared shingles; odd rows as in :func:`find_contained`."""
    return find_contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_SETS = """{name} AS (
  SELECT {key}, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)])
                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM (SELECT {key}, {words} AS w FROM {table}) x)"""
ORACLE_SQL = f"""WITH {_SETS.format(name="d", key="doc_id", words=_WORDS, table="documents")},
{_SETS.format(name="b", key="item_id", words=_WORDS, table="benchmark")},
bi AS (SELECT item_id, len(s) AS n, unnest(s) AS g FROM b),
k AS (SELECT DISTINCT len(string_split(s[1], ' ')) AS k FROM b WHERE len(s) = 1 AND len(string_split(s[1], ' ')) < 5),
r AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT doc_id, {_WORDS} AS w FROM documents) y, k WHERE len(w) >= k),
di AS (SELECT doc_id, unnest(s) AS g FROM d UNION SELECT doc_id, array_to_string(w[i:i+k-1], ' ') FROM r)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_item_shingles, count(*) AS n_shared, count(*) / CAST(n AS DOUBLE) AS containment
FROM di JOIN bi USING (g) GROUP BY doc_id, item_id, n HAVING count(*) >= 0.75 * n"""
