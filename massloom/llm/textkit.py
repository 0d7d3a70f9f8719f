"""Whole-batch text kernels in numpy, used inside ``mapInArrow`` functions.

Texts arrive as Arrow string arrays and are handled as one byte buffer, cut
into slices of a few megabytes so that memory stays bounded whatever a batch
holds (one text longer than a slice is a slice of its own). Words are runs of
bytes other than space and 0x09-0x0D; those bytes never occur inside another
UTF-8 character, so this is the character rule ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once.
SLICE_BYTES = 1 << 20
#: The smallest long, standing in for a null id; it orders first.
NO_ID = -(2**63)
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_codes() -> np.ndarray:
    """A pseudo-random 64-bit code for each byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def is_gap() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return table


def ascii_lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done = 1
    while done < len(out):
        step = np.uint64(pow(int(base), done, 1 << 64))
        more = min(done, len(out) - done)
        out[done : done + more] = out[:more] * step
        done += more
    return out


class Powers:
    """Powers of the hash base and of its inverse, grown when a slice needs more."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = powers(n, int(BASE)), powers(n, pow(int(BASE), -1, 1 << 64))
        return self.up, self.down


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of at most ``limit`` bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, none across rows, and for each row the index of its first run (with one more entry at the end)."""
    n = len(inside)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[:1], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & (edge[:-1] | ~before))
    after = np.empty(n, dtype=bool)
    after[-1:], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
    return start, end, np.searchsorted(start, offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray, pows: Powers) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes."""
    up, down = pows.get(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(codes[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive word hashes (rows not regarded)."""
    if len(words) < size:
        return np.zeros(0, dtype=np.uint64)
    n = len(words) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out += mix(words[j : j + n] ^ np.uint64(0xA24BAED4963EE407 * (j + 1) % (1 << 64)))
    return mix(out)


def shingle_sets(texts: pa.Array, size: int, lower: bool = True, pows: Powers | None = None, also: tuple[int, ...] = ()) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its distinct shingle hashes in ascending order) for each row.

    A row of fewer than ``size`` words has its whole word sequence as one
    shingle; a row without words has none. Runs of so many words as ``also``
    names, all below ``size``, count as shingles too, hashed as a row of so many words is.
    """
    codes, gap, low, pows = byte_codes(), is_gap(), ascii_lower(), pows or Powers()
    for first, last, data, offsets in slices(texts):
        data = low[data] if lower else data
        start, end, at = runs(~gap[data], offsets)
        words = span_hashes(data, start, end, codes, pows)
        windows = window_hashes(words, size)
        for row in range(last - first):
            a, b = int(at[row]), int(at[row + 1])
            if also and b > a:
                own = [windows[a : b - size + 1]] if b - a >= size else [window_hashes(words[a:b], b - a) + np.uint64(b - a)]
                yield first + row, np.unique(np.concatenate([*own, *(window_hashes(words[a:b], n) + np.uint64(n) for n in also if n <= b - a)]))
            elif b - a >= size:
                yield first + row, np.unique(windows[a : b - size + 1])
            elif b > a:
                yield first + row, window_hashes(words[a:b], b - a) + np.uint64(b - a)
            else:
                yield first + row, windows[:0]


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so that what a kernel holds and returns at once stays small."""
    for b in batches:
        for first in range(0, b.num_rows, rows):
            yield b.slice(first, rows)


def list_column(parts: list[np.ndarray], dtype: type, arrow: pa.DataType) -> pa.Array:
    """A list column from one array for each row."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    values = np.concatenate(parts).astype(dtype, copy=False) if parts else np.zeros(0, dtype=dtype)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=arrow))


def texts_of(docs: DataFrame, *more: Column | str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The id, the text and what else is named; extra columns go, so their names can't clash."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *more)


def smallest_hashed(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most ``most`` rows, those of the smallest hashed keys.

    Rows that cannot be among them are left out before the sort, so that no
    task sends its own ``most`` rows to the driver.
    """
    h = F.xxhash64(keys[0])
    n = rows.count()
    if n > 2 * most:
        rows = rows.filter(h < NO_ID + int(1.5 * most / n * 2**64))
    return rows.orderBy(h, *keys).limit(most)


def one_row_each(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row for each value of ``key``: the one of the smallest hash of the columns, by a combinable minimum.

    An id that very many rows share costs what one row does in all that follows.
    """
    first = rows.groupBy(key).agg(F.min(F.struct(F.xxhash64(*columns).alias("_h"), *columns)).alias("_first"))
    return first.select(key, *[F.col("_first")[c].alias(c) for c in columns])


def fresh_name(columns: list[str], stem: str) -> str:
    """A column name that none of ``columns`` has, in any case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


#: Keys that a join may broadcast for being in more than one row in so many.
MOST_WIDE = 1 << 16


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], total: int, least: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``counted``, which has each key once with the number ``c`` of its rows.

    Keys of more than total / MOST_WIDE rows (fewer than MOST_WIDE of them,
    whatever the corpus) and of more than ``least`` go to all tasks, so that
    no task gets all rows of such a key; the others meet in a shuffle.
    """
    limit = max(least, total // MOST_WIDE)
    wide, narrow = counted.filter(F.col("c") > limit), counted.filter(F.col("c") <= limit)
    rest = rows.join(F.broadcast(wide.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(wide), keys).unionByName(rest.join(narrow, keys))
