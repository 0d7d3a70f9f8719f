"""Minimax contiguous sharding of groups of equal texts.

Groups are ordered by the hash of their text and cut into contiguous shards so
that the largest shard is as small as possible: the smallest feasible capacity
is found by binary search, each capacity is checked greedily (fill a shard
until the next group would not fit), and the cuts are made there.

The greedy check needs sizes in group order, and groups may be far too many
for one machine. So the driver holds them at several resolutions: first sums
over 2**14 ranges of the hash, then finer sums for those ranges alone in which
a cut can fall for any capacity still possible, until every range that matters
is a single group. The result equals the search over all groups, and what is
collected stays bounded whatever the corpus holds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from massloom.llm.textkit import fresh_name
from massloom.plans.store import materialize

TOP_BITS, MORE_BITS = 14, 10
HALF = 1 << 63


def unsigned_prefix(bits: int) -> Column:
    """The leading ``bits`` bits of the key in unsigned order."""
    return F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-HALF)), 64 - bits)


def cut_points(prefix: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Greedy ends of the shards as indices into ``prefix``, or None if the capacity is too small."""
    ends, at = [], 0
    for _ in range(shards):
        at = int(np.searchsorted(prefix, prefix[at] + capacity, side="right")) - 1
        ends.append(at)
    return ends if at == len(prefix) - 1 else None


def smallest_capacity(prefix: np.ndarray, low: int, shards: int) -> int:
    """The smallest capacity of at least ``low`` at which the greedy check succeeds."""
    high = int(prefix[-1])
    while low < high:
        middle = (low + high) // 2
        if cut_points(prefix, middle, shards):
            high = middle
        else:
            low = middle + 1
    return low


def histogram(sizes: DataFrame, bits: int, within: list[tuple[int, int]] | None = None) -> dict[int, tuple[int, bool]]:
    """Range start (unsigned) -> (bytes, whether it is one group), for ranges of ``bits`` leading bits."""
    if within is not None:
        at: dict[int, list[int]] = {}
        for start, old in within:
            at.setdefault(old, []).append(start >> (64 - old))
        keep = F.lit(False)
        for old, starts in at.items():
            keep = keep | unsigned_prefix(old).isin(starts)
        sizes = sizes.filter(keep)
    rows = sizes.groupBy(unsigned_prefix(bits).alias("p")).agg(F.sum("size").alias("b"), (F.min("key") == F.max("key")).alias("one")).collect()
    return {(r.p % (1 << bits)) << (64 - bits): (r.b, r.one) for r in rows}


def plan_cuts(sizes: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """(keys that get a shard of their own, unsigned first keys of the other shards but the first)."""
    largest = sizes.groupBy("key").agg(F.sum("size").alias("b")).orderBy(F.desc("b"), "key").limit(shards + 1).collect()
    total, alone = sizes.agg(F.sum("size")).first()[0] or 0, []
    while len(alone) < min(shards - 1, len(largest)) and largest[len(alone)].b * (shards - len(alone)) >= total:
        total -= largest[len(alone)].b
        alone.append(largest[len(alone)].key)
    shards -= len(alone)
    rest = sizes.filter(~F.col("key").isin(alone)) if alone else sizes
    low = max(-(-total // shards), largest[len(alone)].b) if len(largest) > len(alone) else 0
    if not low:
        return alone, []
    atoms = {start: (b, one, TOP_BITS) for start, (b, one) in histogram(rest, TOP_BITS).items()}
    while True:
        starts = sorted(atoms)
        prefix = np.concatenate([[0], np.cumsum([atoms[s][0] for s in starts])]).astype(np.int64)
        capacity = smallest_capacity(prefix, low, shards)
        ends = cut_points(prefix, capacity, shards)
        unsure = set()
        if capacity > low:
            earliest, latest = 0, 0  # a true cut lies at or after the one, at or before the other
            for _ in range(shards - 1):
                earliest = int(np.searchsorted(prefix, prefix[earliest] + low, side="right")) - 1
                latest = min(latest + capacity, total)
                for k in range(earliest, min(int(np.searchsorted(prefix, latest, side="left")), len(starts))):
                    if not atoms[starts[k]][1]:
                        unsure.add(starts[k])
        if not unsure:
            return alone, [starts[e] if e < len(starts) else None for e in ends[:-1]]
        by_bits: dict[int, list[tuple[int, int]]] = {}
        for s in unsure:
            by_bits.setdefault(atoms.pop(s)[2], []).append((s, 0))
        for bits, ranges in by_bits.items():
            finer = min(64, bits + MORE_BITS)
            atoms |= {s: (b, one, finer) for s, (b, one) in histogram(rest, finer, [(s, bits) for s, _ in ranges]).items()}


def text_size_and_key(docs: DataFrame) -> tuple[Column, Column]:
    """(UTF-8 bytes plus 1 as ``size``, hash of the text as ``key``); a null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.xxhash64(text).alias("key")


def shard_of(key: Column, alone: list[int], cuts: list[int]) -> Column:
    """The shard of a key: its own if it is alone, else by the cuts."""
    shard = F.lit(len(alone))
    for cut in cuts:
        if cut is not None:  # signed order of keys is the unsigned order of what was cut
            shard = shard + (key >= F.lit(cut - HALF)).cast("int")
    for k, own in enumerate(alone):
        shard = F.when(key == own, F.lit(k)).otherwise(shard)
    return shard.cast("int")


def minimax_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of ``docs``.

    ``size`` is the UTF-8 length of the text plus 1; equal texts share a shard
    (so do texts of equal 64-bit hash). The order that is cut has the groups of
    more than an equal share first, then all others by the hash of their text:
    each of the former is a shard, since any neighbour would only add to the
    largest, and the partition of the others is minimax again. ``slot`` counts
    the rows of a shard from 0 without gaps. A null text counts as empty, a
    null doc_id is kept, repeated rows get a slot each; groups of equal size
    are told apart by their hash. Extra columns are not read; only the length
    and hash of a long text are. An empty table gives no rows, and shards may
    be empty where groups are few.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size, key = text_size_and_key(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size, F.crc32(text.cast("binary")).alias("text_crc32"), key, F.monotonically_increasing_id().alias("seq"))
    rows = materialize(rows, "shard-sizes")  # from here on seq is fixed
    shard = shard_of(F.col("key"), *plan_cuts(rows.select("key", "size"), shards))
    placed = rows.withColumn("shard", shard).withColumn("part", F.shiftrightunsigned("seq", 33))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("c"))
    before = counts.select("shard", "part", (F.sum("c").over(W.partitionBy("shard").orderBy("part")) - F.col("c")).alias("base"))
    number = F.row_number().over(W.partitionBy("shard", "part").orderBy("seq")) - 1
    numbered = placed.withColumn("number", number).join(before, ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("number")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Write ``docs`` as Parquet under ``path/shard=k``, each shard cut by the same rule.

    Each row goes where its text goes, by the cuts alone: nothing is joined.
    All columns are kept; the partition is named ``shard``, with underscores
    behind where ``docs`` has such a column. Nulls, ties, repeated rows, long
    texts and empty tables as in :func:`minimax_shards`.
    """
    sizes = materialize(docs.select(*text_size_and_key(docs)), "shard-sizes")
    name = fresh_name(docs.columns, "shard")
    docs.withColumn(name, shard_of(text_size_and_key(docs)[1], *plan_cuts(sizes, shards))).write.mode("overwrite").partitionBy(name).parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes; odd rows as in :func:`minimax_shards`."""
    out = minimax_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
