"""Conversation structure repair: a cost DP over edits, then the least audit by prefix doubling.

A conversation's rows are edited at least cost so that the role initials read
``(s?(ua)+)?``: Keep (0), Rerole to user or assistant (1), Delete (2; required
for blank and duplicate rows), Insert an empty turn (5); a truncated row that
is not deleted adds 5. The audit is the string of the edits' initials.

1. Rows are range-partitioned by conversation and turn. The rows of one
   conversation in one range are a segment; a conversation of very many rows
   has one in each range that it fills, so no task holds more than a range.
2. A segment is a matrix of least costs from each state of the grammar before
   it to each state after it. The matrices of conversations of several segments
   (at most two such segments a range) are multiplied on the driver; what they
   leave is the cost still to come after each segment.
3. With that, the cost DP runs backward in each segment. Arcs of the grid (row,
   state) that lie on a cheapest path are ranked by their letter, then by the
   audits of 2, 4, 8, ... letters that begin with them: the rank of an audit of
   twice the length is the pair of the arc's rank and the rank of the best arc
   where its half ends. The arcs that leave a node have different letters, so
   an arc's rank and the node where its half ends are unique. The audit is read
   off by following the doubled pointers of the least arcs.
4. Segments return audits for every state before them; the driver chains the
   few segments of long conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm.textkit import NO_ID, join_counted, parts
from massloom.plans.store import discard, materialize

#: States of the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after one more user or assistant turn, whichever may follow; its role.
STEP = np.array([USER, USER, ASSISTANT, USER])
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Bits of a row's code: its role initial (s, u, a, other), then its fault.
INITIAL, BLANK, DUPLICATE, TRUNCATED = 3, 4, 8, 16
DELETE, INSERT, CUT = 2, 5, 5
LETTERS = b"\0DIKR"
FAR = np.int64(1 << 40)
#: Where Keep leads for each initial and state; -1: not allowed.
KEEP = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1] * 4])
SPACE = " \t\n\x0b\x0c\r"


def damage(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copy): the rows after damage by crc32 of ``conv_id:turn`` modulo 20."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")), F.lit(20))
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    copies = F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.filter(hit != 0).select(conv(), F.col("turn").cast("long").alias("turn"), F.when(hit == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), copies.alias("copy"))


def conv():
    return F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv")


def place(rows: DataFrame) -> DataFrame:
    """The rows with the range they lie in (``block``), their place there (``n``), their code so far and a hash of role and text."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array(np.full(b.num_rows, block), pa.int32()), pa.array(np.arange(n, n + b.num_rows), pa.int64())], [*b.schema.names, "block", "n"])
            n += b.num_rows

    bare = F.rtrim("text", F.lit(SPACE))
    initial = F.left("role", F.lit(1))
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = code + F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    k1, k2 = F.xxhash64("role", "text"), F.xxhash64("text", F.lit(1), "role")
    coded = rows.select("conv", "turn", "role", "text", "copy", code.cast("int").alias("code"), k1.alias("k1"), k2.alias("k2"))
    order = ["conv", F.asc_nulls_first("turn"), "role", "k1", "k2", "copy"]
    return coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, "conv long, turn long, role string, text string, copy int, code int, k1 long, k2 long, block int, n long")


def later_copies(placed: DataFrame) -> DataFrame:
    """(conv, block, n) of the rows whose role and text stand earlier in the conversation."""
    keys, at = ["conv", "k1", "k2"], F.struct("block", "n")
    bare = placed.select(*keys, "block", "n")
    counted = bare.groupBy(*keys).agg(F.count("*").alias("c"), F.min(at).alias("first")).filter("c > 1")
    return join_counted(bare, counted, keys, placed.count()).filter(at != F.col("first")).select("conv", "block", "n")


def row_costs(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keep costs and targets by state, and Rerole costs, of rows given by their codes."""
    to = KEEP[code & INITIAL]
    must = (code & (BLANK | DUPLICATE)) > 0
    extra = np.where(code & TRUNCATED, CUT, 0)
    return np.where((to < 0) | must[:, None], FAR, extra[:, None]), np.maximum(to, 0), np.where(must, FAR, 1 + extra)


def with_inserts(cost: np.ndarray) -> np.ndarray:
    """Costs by state when empty turns may be put in first; two in a row lead back to the same roles, so one is enough between user and assistant."""
    out = cost.copy()
    out[:, USER] = np.minimum(cost[:, USER], INSERT + cost[:, ASSISTANT])
    out[:, ASSISTANT] = np.minimum(cost[:, ASSISTANT], INSERT + cost[:, USER])
    for s in (START, SYSTEM):
        out[:, s] = np.minimum(cost[:, s], INSERT + out[:, USER])
    return out


#: Cost still to come by state when no row is left.
END = with_inserts(np.array([[0, FAR, FAR, 0]], dtype=np.int64))[0]


def cost_table(codes: list[np.ndarray], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least cost to come at each (row, state) of many segments, and each segment's first row in the table.

    ``ends`` has the costs after each segment by state, with any further axis
    behind. All segments go backward together, a row of each at a time.
    """
    size = np.array([len(c) for c in codes])
    first = np.r_[0, np.cumsum(size + 1)[:-1]]
    table = np.empty((int((size + 1).sum()), *ends.shape[1:]), dtype=np.int64)
    table[first + size] = ends
    flat = np.zeros(len(table), dtype=np.int64)
    for c, f in zip(codes, first, strict=True):
        flat[f : f + len(c)] = c
    keep, to, rerole = row_costs(flat)
    order = np.argsort(-size, kind="stable")
    more = [np.newaxis] * (ends.ndim - 2)
    active = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), side="left")  # segments of more than i rows
    for i in range(size.max(initial=0) - 1, -1, -1):
        at = first[order[: active[i]]] + i
        nxt = table[at + 1]
        best = np.minimum(DELETE + nxt, rerole[at][(slice(None), np.newaxis, *more)] + nxt[:, STEP])
        kept = keep[at][(slice(None), slice(None), *more)] + np.take_along_axis(nxt, to[at][(slice(None), slice(None), *more)], axis=1)
        table[at] = with_inserts(np.minimum(best, kept))
    return np.minimum(table, FAR), first


def cheapest_arcs(flat: np.ndarray, table: np.ndarray, final: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tail, letter, head) of the arcs on cheapest paths; ``inner`` marks table rows that stand for a row, ``final`` those after a conversation's last row. Nodes without such an arc loop with letter 0."""
    keep, to, rerole = row_costs(flat)
    own = np.arange(len(table))[:, None]
    after = np.minimum(own + 1, len(table) - 1)
    state = np.arange(4)[None, :]
    row = inner[:, None]
    ways = [
        (np.where(row, DELETE + table[after, state], FAR), after * 4 + state),
        (np.where(row | final[:, None], INSERT + table[:, STEP], FAR), own * 4 + STEP),
        (np.where(row, keep + table[after, to], FAR), after * 4 + to),
        (np.where(row, rerole[:, None] + table[after, STEP[None, :]], FAR), after * 4 + STEP),
    ]
    tails, letters, heads = [], [], []
    node = own * 4 + state
    for k, (cost, head) in enumerate(ways):
        on = (cost == table) & (cost < FAR)
        tails.append(node[on])
        letters.append(np.full(int(on.sum()), k + 1))
        heads.append(np.broadcast_to(head, node.shape)[on])
    stop = np.ones(node.size, dtype=bool)
    stop[np.concatenate(tails)] = False
    rest = np.flatnonzero(stop)
    return np.concatenate([*tails, rest]), np.concatenate([*letters, np.zeros(len(rest), dtype=int)]), np.concatenate([*heads, rest])


def least_paths(tail: np.ndarray, letter: np.ndarray, head: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters, last node): the least string of letters from each start, one a row and filled with 0, by prefix doubling."""

    def best(rank: np.ndarray) -> np.ndarray:
        order = np.lexsort((rank, tail))
        return order[np.r_[True, tail[order][1:] != tail[order][:-1]]]  # every node has an arc

    rank, end, jumps = letter, head, []
    least = best(rank)
    while True:
        jumps.append(end[least])
        if (letter[least[jumps[-1][starts]]] == 0).all():
            break
        after = least[end]
        _, rank = np.unique(rank * (rank.max() + 1) + rank[after], return_inverse=True)
        end = end[after]
        least = best(rank)
    nodes = starts[:, None]
    for jump in reversed(jumps):
        nodes = np.stack([nodes, jump[nodes]], axis=2).reshape(len(starts), -1)
    return letter[least[nodes]], jumps[-1][starts]


def audits(codes: list[np.ndarray], ends: np.ndarray, last: np.ndarray) -> list[tuple[list[bytes], list[int], list[int]]]:
    """For each segment the least audits, the states after them and their costs, by the state before it."""
    out: list = [None] * len(codes)
    size = np.array([len(c) for c in codes])
    for width in set(map(int.bit_length, map(int, size))):  # alike in length, as the paths are read in one rectangle
        own = [k for k in range(len(codes)) if int(size[k]).bit_length() == width]
        table, first = cost_table([codes[k] for k in own], ends[own])
        flat, inner, final = np.zeros(len(table), dtype=np.int64), np.ones(len(table), dtype=bool), np.zeros(len(table), dtype=bool)
        for k, f in zip(own, first, strict=True):
            flat[f : f + size[k]] = codes[k]
            inner[f + size[k]] = False
            final[f + size[k]] = last[k]
        starts = (first[:, None] * 4 + np.arange(4)).ravel()
        letters, stop = least_paths(*cheapest_arcs(flat, table, final, inner), starts)
        text = np.frombuffer(LETTERS, dtype=np.uint8)[letters]
        spent = (table.ravel()[starts] - table.ravel()[stop]).reshape(-1, 4)
        for j, k in enumerate(own):
            out[k] = [bytes(text[4 * j + s]).rstrip(b"\0") for s in range(4)], (stop[4 * j : 4 * j + 4] % 4).tolist(), spent[j].tolist()
    return out


def segment_table(placed: DataFrame) -> DataFrame:
    """(conv, block, codes, matrix, blank, duplicate, truncated, illegal): each segment's row codes, costs between states, and counts."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            codes = []
            for ns, cs, again in zip(*(b.column(j).to_pylist() for j in (2, 3, 4)), strict=True):
                code = np.array(cs, dtype=np.uint8)[np.argsort(ns)]
                if again:
                    at = np.searchsorted(np.sort(ns), again)
                    at = at[(code[at] & BLANK) == 0]
                    code[at] = code[at] & INITIAL | DUPLICATE
                codes.append(code)
            table, first = cost_table(codes, np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, FAR), (len(codes), 4, 4)))
            pair = [c & INITIAL for c in codes]
            bad = [sum((i, j) not in ((0, 1), (1, 2), (2, 1)) for i, j in zip(p[:-1].tolist(), p[1:].tolist(), strict=True)) for p in pair]
            faults = [pa.array([int((c & bit > 0).sum()) for c in codes], pa.int64()) for bit in (BLANK, DUPLICATE, TRUNCATED)]
            matrix = pa.array([table[f].ravel().tolist() for f in first], pa.list_(pa.int64()))
            yield pa.record_batch([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), matrix, *faults, pa.array(bad, pa.int64())], ["conv", "block", "codes", "matrix", "blank", "duplicate", "truncated", "illegal"])

    rows = placed.groupBy("conv", "block").agg(F.collect_list(F.struct("n", "code")).alias("r")).select("conv", "block", "r.n", "r.code")
    again = later_copies(placed).groupBy("conv", "block").agg(F.collect_list("n").alias("again"))
    schema = "conv long, block int, codes binary, matrix array<long>, blank long, duplicate long, truncated long, illegal long"
    return rows.join(again, ["conv", "block"], "left").mapInArrow(kernel, schema)


def plan_repairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed, segments) for rows of conv, turn, role, text and copy.

    placed has the rows with their block and n. segments has a row for each
    conversation and block: entry (the state before it), audit, cost, counts.
    Rows of one turn are ordered by role and a hash of the text, equal rows stand together.
    """
    spark = rows.sparkSession
    placed = materialize(place(rows), "repair-rows")
    segments = materialize(segment_table(placed), "repair-segments")
    several = segments.groupBy("conv").agg(F.count("*").alias("c")).filter("c > 1").select("conv")
    # at most two segments of a range belong to a conversation of several: those at its ends
    long = segments.join(several, "conv").select("conv", "block", "matrix", F.expr("int(ascii(substring(codes, 1, 1)))").alias("head"), F.expr("int(ascii(substring(codes, length(codes), 1)))").alias("tail"))
    chains = [list(g) for _, g in groupby(sorted(long.collect(), key=lambda r: (r.conv, r.block)), key=lambda r: r.conv)]
    context = []
    for chain in chains:
        end = END
        for k in range(len(chain) - 1, -1, -1):
            r, joint = chain[k], 0
            if k:
                joint = int((chain[k - 1].tail & INITIAL, r.head & INITIAL) not in ((0, 1), (1, 2), (2, 1)))
            context.append((r.conv, r.block, end.tolist(), k == len(chain) - 1, joint))
            end = np.minimum((np.array(r.matrix, dtype=np.int64).reshape(4, 4) + end[None, :]).min(axis=1), FAR)
    told = F.broadcast(spark.createDataFrame(context, "conv long, block int, ends array<long>, last boolean, joint int"))
    solved = segments.join(told, ["conv", "block"], "left").select("conv", "block", "codes", F.coalesce("ends", F.array(*[F.lit(int(x)) for x in END])).alias("ends"), F.coalesce("last", F.lit(True)).alias("last"), "blank", "duplicate", "truncated", (F.col("illegal") + F.coalesce("joint", F.lit(0))).alias("illegal"), F.col("last").isNotNull().alias("chained"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            codes = [np.frombuffer(c, dtype=np.uint8).astype(np.int64) for c in b.column(2).to_pylist()]
            found = audits(codes, np.array(b.column(3).to_pylist(), dtype=np.int64).reshape(-1, 4), np.array(b.column(4).to_pylist(), dtype=bool))
            chained = b.column(9).to_pylist()
            pick = [a if c else [a[0], b"", b"", b""] for (a, _, _), c in zip(found, chained, strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), *b.columns[5:10], pa.array([[x.decode() for x in a] for a in pick], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.list_(pa.int32())), pa.array([f[2] for f in found], pa.list_(pa.int64()))], ["conv", "block", "blank", "duplicate", "truncated", "illegal", "chained", "audits", "exits", "costs"])

    schema = "conv long, block int, blank long, duplicate long, truncated long, illegal long, chained boolean, audits array<string>, exits array<int>, costs array<long>"
    paths = materialize(solved.mapInArrow(kernel, schema), "repair-paths")
    discard(segments)
    entered = []
    for _, chain in groupby(sorted(paths.filter("chained").select("conv", "block", "exits").collect(), key=lambda r: (r.conv, r.block)), key=lambda r: r.conv):
        state = START
        for r in chain:
            entered.append((r.conv, r.block, state))
            state = r.exits[state]
    told = F.broadcast(spark.createDataFrame(entered, "conv long, block int, entry int"))
    entry = F.coalesce("entry", F.lit(START))
    chosen = paths.join(told, ["conv", "block"], "left")
    return placed, chosen.select("conv", "block", entry.alias("entry"), F.get("audits", entry).alias("audit"), F.get("costs", entry).alias("cost"), "blank", "duplicate", "truncated", "illegal")


def edited(placed: DataFrame, segments: DataFrame, *by: str) -> DataFrame:
    """The stream of rows that a kernel gets: in each segment its entry state and audit, then its rows in order."""
    heads = segments.select("conv", "block", F.lit(-1).cast("long").alias("n"), F.col("entry").cast("string").alias("role"), F.col("audit").alias("text"))
    both = heads.unionByName(placed.select("conv", "block", "n", "role", "text"))
    return both.repartition(*by).sortWithinPartitions("conv", "block", "n")


def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, str, str]]:
    """(conv, block, role, text) of the repaired rows, one row held at a time."""
    conv = block = None
    audit, at, state = "", 0, START

    def inserted() -> Iterator[tuple[int, int, str, str]]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, int(STEP[state])
            yield conv, block, ROLE[state], ""

    for b in parts(batches):
        for c, k, n, role, text in zip(*(col.to_pylist() for col in b.columns), strict=True):
            if n < 0:
                yield from inserted()
                conv, block, audit, at, state = c, k, text, 0, int(role)
                continue
            yield from inserted()
            letter, at = audit[at], at + 1
            if letter == "R":
                state = int(STEP[state])
                yield conv, block, ROLE[state], text
            elif letter == "K":
                state = int(KEEP["sua".index(role[:1]), state])
                yield conv, block, role, text
    yield from inserted()


def repaired_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations, ``place`` giving the order of a conversation's rows.

    ``rows`` has conv_id, turn, role and text. A null role or text counts as
    one space, so as another role and as blank; null ids are one conversation;
    null turns come first, rows of one turn in order of role; repeated rows are
    duplicates. A segment of a conversation is the most that a task replays.
    Extra columns are not read. An empty table gives an empty result.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    placed, segments = plan_repairs(rows.select(conv(), F.col("turn").cast("long").alias("turn"), said("role"), said("text"), F.lit(0).alias("copy")))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, was = [], 0, None
        for c, block, role, text in replay(batches):
            n = n + 1 if was == (c, block) else 0
            was = (c, block)
            held.append((c, block, n, role, text))
            if len(held) == 512:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*held, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()), strict=True)], ["conv", "block", "n", "role", "text"])

    out = edited(placed, segments, "conv", "block").mapInArrow(kernel, "conv long, block int, n long, role string, text string")
    return out.select(F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id"), F.struct("block", "n").alias("place"), "role", "text")


def digests(placed: DataFrame, segments: DataFrame) -> DataFrame:
    """(conv, sha): SHA-256 of each repaired conversation, rows hashed as they stream by; one hash has one order, so one stream."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convs, found, sha = [], [], None
        for c, _, role, text in replay(batches):
            if not convs or convs[-1] != c:
                if sha:
                    found.append(sha.hexdigest())
                convs.append(c)
                sha = hashlib.sha256(f"{role}:{text}".encode())
            else:
                sha.update(f"\n{role}:{text}".encode())
            if len(convs) > 512:
                yield pa.record_batch([pa.array(convs[:-1], pa.int64()), pa.array(found, pa.string())], ["conv", "sha"])
                convs, found = convs[-1:], []
        if sha:
            yield pa.record_batch([pa.array(convs, pa.int64()), pa.array([*found, sha.hexdigest()], pa.string())], ["conv", "sha"])

    return edited(placed, segments, "conv").mapInArrow(kernel, "conv long, sha string")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation after damage: its faults, the cost and audit of its repair, and the digest of the repaired turns.

    Odd rows as in :func:`repaired_rows`; a conversation without rows after damage has zeros, no audit and the digest of nothing.
    """
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    placed, segments = plan_repairs(damage(rows))
    turns = placed.groupBy("conv").agg(F.max("turn").alias("hi"), F.min("turn").alias("lo"), F.countDistinct("turn").alias("d"))
    ordered = F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]))
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    whole = segments.groupBy("conv").agg(*[F.sum(c).alias(c) for c in counts], ordered.alias("audit"))
    out = rows.select(conv()).distinct()
    for part in (turns, whole, digests(placed, segments)):
        out = out.join(part, "conv", "left")
    zero = lambda c, name: F.coalesce(c, F.lit(0).cast("long")).alias(name)
    gaps = zero(F.col("hi") - F.col("lo") + 1 - F.col("d"), "gaps")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id"), gaps, *[zero(F.col(c), c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(nothing)).alias("repaired_sha256"))


def _put(role: str, rest: str) -> str:
    return f"{{'c': {rest}.c + 5, 'a': 'I' || {rest}.a, 't': chr(10) || '{role}:' || {rest}.t}}"


def _own(state: str, to: str, role: str) -> str:
    keep = "WHEN r1 = 's' THEN bs " * (state == "bz") + f"WHEN r1 = '{to[1]}' THEN {to}"
    ways = [f"{{'c': {state}.c + 2, 'a': 'D' || {state}.a, 't': {state}.t}}"]
    ways.append(f"CASE WHEN NOT must THEN {{'c': (CASE {keep} END).c + x, 'a': 'K' || (CASE {keep} END).a, 't': chr(10) || role || ':' || text || (CASE {keep} END).t}} END")
    ways.append(f"CASE WHEN NOT must THEN {{'c': {to}.c + 1 + x, 'a': 'R' || {to}.a, 't': chr(10) || '{role}:' || text || {to}.t}} END")
    return f"list_min(list_filter([{', '.join(ways)}], lambda w: w.c IS NOT NULL)) AS o{state[1]}"


ORACLE_SQL = f"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(k, ''), lambda q: ascii(q)::UBIGINT)), lambda p, b: list_reduce([xor(p, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda v, z: xor(v >> 1, 3988292384::UBIGINT * (v & 1::UBIGINT))))) % 20 AS hit FROM c),
g AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE hit <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tr FROM g),
e AS (SELECT *, left(role, 1) AS r1, tr = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(tr, 1) NOT IN ('.', '!', '?') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM n),
f AS MATERIALIZED (SELECT conv_id, turn, i, role, text, r1, pair, blank, again AND NOT blank AS dup, cut AND NOT again AND NOT blank AS trunc, blank OR again AS must, CASE WHEN cut AND NOT again AND NOT blank THEN 5 ELSE 0 END AS x FROM e),
s AS (SELECT conv_id, max(i) + 1 AS i, {{'c': 0, 'a': '', 't': ''}} AS bz, {{'c': 10, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS bs, {{'c': 5, 'a': 'I', 't': chr(10) || 'assistant:'}} AS bu, {{'c': 0, 'a': '', 't': ''}} AS ba FROM f GROUP BY conv_id
UNION ALL SELECT conv_id, i, list_min([oz, {_put("user", "bu")}]), list_min([os, {_put("user", "bu")}]), bu, ba
FROM (SELECT conv_id, i, oz, os, list_min([ou, {_put("assistant", "oa")}]) AS bu, list_min([oa, {_put("user", "ou")}]) AS ba
FROM (SELECT f.conv_id, f.i, {_own("bz", "bu", "user")}, {_own("bs", "bu", "user")}, {_own("bu", "ba", "assistant")}, {_own("ba", "bu", "user")} FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i - 1) y) y),
b AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(s.bz.c, 0) AS BIGINT) AS cost, coalesce(s.bz.a, '') AS audit, sha256(substr(coalesce(s.bz.t, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM o.conv_id AND s.i = 1"""
