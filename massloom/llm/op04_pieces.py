"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces and log scores are read from a SentencePiece model file, whose path is a
parameter; nothing is trained. A model file of merge type holds merge ranks in
place of log scores; ranks become log probabilities by Zipf's law (the piece of
rank r has probability 1 / (r * H), with H the harmonic sum over all ranks).
A text gets the whitespace marker for each space
and one in front, and is segmented into the pieces of the highest total score.
A character that no piece covers costs ten less than the lowest score and is
written as its UTF-8 bytes (byte fallback).

No piece holds a marker behind another character, so a best segmentation is the
chain of best segmentations of marker-led chunks; each chunk is segmented once
in a task and remembered, within a bound.

A marker character in the source text itself goes through byte fallback, so
that decoding gives every text back exactly.
"""

from __future__ import annotations

import heapq
import math
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm.textkit import texts_of
from massloom.plans.shipping import ship

MARK = "▁"
MODEL = os.environ.get("MASSLOOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
UNKNOWN_PENALTY = 10.0
#: Chunks that a task remembers; the memory is emptied when full.
REMEMBERED = 400_000
#: Characters beyond which a chunk is segmented each time.
LONG_CHUNK = 64
#: Bytes of a chunk that are segmented at once.
BLOCK = 1 << 18
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def read_pieces(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, log score, type) by id, from the bytes of a model file."""
    out, merges = [], False
    for number, value in fields(data):
        if number == 2:
            merges = any(n == 3 and v == 2 for n, v in fields(value))
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif n == 3:
                    kind = v
            out.append((piece, score, kind))
    if merges:
        total = math.log(sum(1 / (1 - s) for _, s, kind in out if kind == NORMAL))
        out = [(p, -math.log(1 - s) - total if kind == NORMAL else s, kind) for p, s, kind in out]
    return out


class DoubleArray:
    """A trie of byte strings in two arrays: the child of state s by byte b is base[s] + b + 1 if check there is s."""

    def __init__(self, words: list[bytes], values: list[int]) -> None:
        root: dict = {}
        for w, v in zip(words, values, strict=True):
            node = root
            for b in w:
                node = node.setdefault(b, {})
            node[-1] = v
        size = 1024
        self.base, self.check, self.value = array("i", [0]) * size, array("i", [-1]) * size, array("i", [-1]) * size
        self.check[0] = 0
        free, hint, todo = 1, 1, [(root, 0)]
        while todo:  # states of one child fill the gaps that the others leave
            node, state = todo.pop()
            self.value[state] = node.get(-1, -1)
            kids = sorted(b for b in node if b >= 0)
            if not kids:
                continue
            if len(kids) == 1:
                while free <= kids[0] or self.check[free] >= 0:
                    free += 1
                    self.grow(free + 300)
                base = free - kids[0] - 1
            else:
                base = hint
                while any(self.check[base + b + 1] >= 0 for b in kids):
                    base += 1
                    self.grow(base + 300)
                hint = base
            self.base[state] = base
            for b in kids:
                self.check[base + b + 1] = state
                todo.append((node[b], base + b + 1))
            self.grow(base + 600)

    def grow(self, size: int) -> None:
        more = size - len(self.check)
        if more > 0:
            more = max(more, len(self.check))
            self.base.extend([0] * more)
            self.check.extend([-1] * more)
            self.value.extend([-1] * more)

    def prefixes(self, data: bytes, at: int) -> Iterator[tuple[int, int]]:
        """(end, value) of every word that starts at ``at``."""
        base, check, value, state = self.base, self.check, self.value, 0
        for i in range(at, len(data)):
            nxt = base[state] + data[i] + 1
            if check[nxt] != state:
                return
            state = nxt
            if value[state] >= 0:
                yield i + 1, value[state]


@dataclass
class Pieces:
    """A piece vocabulary with its trie."""

    pieces: list[tuple[str, float, int]]
    trie: DoubleArray = field(init=False)

    def __post_init__(self) -> None:
        usable = [(p.encode(), i) for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER) and p]
        if any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER)):
            raise ValueError("a piece holds the whitespace marker behind another character")
        self.trie = DoubleArray([p for p, _ in usable], [i for _, i in usable])
        self.longest = max((len(p) for p, _ in usable), default=0) + 4
        self.scores = [s for _, s, _ in self.pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN), 0)
        self.low = min((s for _, s, kind in self.pieces if kind == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode() for p, _, kind in self.pieces]
        self.known: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def spell(self, data: bytes) -> list[int]:
        return [self.bytes[b] for b in data] if self.bytes else [self.unknown]

    def relax(self, data: bytes, best: list[float], back: list[tuple[int, int]], at: int, stop: int) -> int:
        """Extend the best paths from every place in [at, stop); returns the first place not worked on."""
        n, scores, low = len(data), self.scores, self.low
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        while at < stop:
            width = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            here, single, state, i = best[at], False, 0, at
            while i < n:
                nxt = base[state] + data[i] + 1
                if check[nxt] != state:
                    break
                state, i = nxt, i + 1
                piece = value[state]
                if piece >= 0:
                    single = single or i == at + width
                    score = here + scores[piece]
                    if score > best[i]:
                        best[i], back[i] = score, (at, piece)
            if not single and here + low > best[at + width]:
                best[at + width], back[at + width] = here + low, (at, -1)
            at += width
        return at

    def path_to(self, data: bytes, back: list[tuple[int, int]], end: int) -> list[int]:
        """The pieces of the best path to ``end``."""
        out: list[int] = []
        while end:
            at, piece = back[end]
            out += [piece] if piece >= 0 else reversed(self.spell(data[at:end]))
            end = at
        return out[::-1]

    def segment(self, chunk: str) -> list[int]:
        """The best pieces of a chunk by Viterbi; the earlier found wins on ties.

        A chunk of more than BLOCK bytes is worked on block by block: as soon as
        the best paths to all places that are still open meet in one place,
        what lies before it is settled, so a text without a blank needs no
        table of its own length.
        """
        data, at, out = chunk.encode(), 0, []
        best, back = [0.0], [(0, -1)]
        while True:
            n = len(data)
            stop = n if n <= BLOCK else min(n, at + BLOCK)
            more = min(n, stop + self.longest) + 1 - len(best)
            best += [-1e300] * more
            back += [(0, -1)] * more
            at = self.relax(data, best, back, at, stop)
            if at >= n:
                return out + self.path_to(data, back, n)
            settled = self.meeting(back, [k for k in range(at, len(best)) if best[k] > -1e300])
            out += self.path_to(data, back, settled)
            data, best, at = data[settled:], best[settled:], at - settled
            back = [(b - settled, p) for b, p in back[settled:]]

    @staticmethod
    def meeting(back: list[tuple[int, int]], ends: list[int]) -> int:
        """The last place that the best paths to all ``ends`` share."""
        open_ends, heads = set(ends), [-e for e in ends]
        heapq.heapify(heads)
        while len(open_ends) > 1:
            last = -heapq.heappop(heads)
            open_ends.discard(last)
            before = back[last][0]
            if before not in open_ends:
                open_ends.add(before)
                heapq.heappush(heads, -before)
        return open_ends.pop()

    def chunk_ids(self, chunk: str) -> bytes:
        ids = self.known.get(chunk)
        if ids is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            ids = array("i", self.segment(chunk)).tobytes()
            if len(chunk) <= LONG_CHUNK:
                self.known[chunk] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Piece ids of a text; none for an empty text."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        parts = []
        for k, own in enumerate(text.split(MARK)):
            if k:
                parts.append(array("i", self.spell(MARK.encode())).tobytes())
            if own or not k:
                own = (MARK if not k else "") + own.replace(" ", MARK)
                known = self.known.get
                if len(own) <= BLOCK:
                    parts += [known(c) or self.chunk_ids(c) for c in CHUNK.findall(own)]
                else:
                    whole = bytearray()
                    for m in CHUNK.finditer(own):
                        whole += known(m.group()) or self.chunk_ids(m.group())
                    parts.append(bytes(whole))
        return np.frombuffer(b"".join(parts), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids: bytes are joined, markers become spaces, the leading one goes."""
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(" ")


#: A run of markers with what follows up to the next marker or line end; line ends stand alone.
CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


def load_pieces(spark: SparkSession, path: str = MODEL) -> Pieces:
    """The vocabulary of a model file, read by Spark where the path has a scheme, else by the driver."""
    if "://" in path:
        return Pieces(read_pieces(bytes(spark.read.format("binaryFile").load(path).first().content)))
    with open(path, "rb") as f:
        return Pieces(read_pieces(f.read()))


def encode_documents(docs: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """(doc_id, ids, exact) for each row of ``docs``.

    ``ids`` are the piece ids of the whole text and ``exact`` says that
    decoding them gives the text back. A null text has null ids and is not
    exact; an empty text has no ids. Repeated rows and null ids are encoded
    each for itself; of segmentations of equal score the one found first wins.
    Extra columns are not read. A long text is encoded whole, a long run
    without a blank block by block. An empty table gives no rows.
    """
    sent = ship(docs.sparkSession, pieces or load_pieces(docs.sparkSession))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                ids, exact, offsets, nulls = [], [], [0], []
                for text in part.column(1).to_pylist():
                    own = model.encode(text or "")
                    ids.append(own)
                    offsets.append(offsets[-1] + len(own))
                    nulls.append(text is None)
                    exact.append(text is not None and model.decode(own) == text)
                offs = pa.array(offsets, pa.int32(), mask=np.array([*nulls, False]))
                lists = pa.ListArray.from_arrays(offs, pa.array(np.concatenate(ids)))
                yield pa.record_batch([part.column(0), lists, pa.array(exact)], ["doc_id", "ids", "exact"])

    return texts_of(docs).mapInArrow(kernel, "doc_id long, ids array<int>, exact boolean")


def decode_documents(tokens: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""
    sent = ship(tokens.sparkSession, pieces or load_pieces(tokens.sparkSession))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            texts = [None if ids is None else model.decode(np.asarray(ids, dtype=np.int64)) for ids in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(kernel, "doc_id long, text string")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text; odd rows as in :func:`encode_documents`."""
    out = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.size("ids").alias("n_pieces"), "ids", "exact")
