import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from massloom.llm import op11_conversations as o

SPACE = " \t\n\v\f\r"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def least_repair(rows):
    """(cost, audit) over all edits, from the start, states told by the initials put out so far."""
    fault = faults(rows)
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def go(i, state, spare):
        ways = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if spare:
            c, a = go(i, nxt[state], spare - 1)
            ways.append((c + 5, "I" + a))
        if i < len(rows):
            c, a = go(i + 1, state, 2)
            ways.append((c + 2, "D" + a))
            if fault[i] not in ("blank", "duplicate"):
                extra = 5 * (fault[i] == "truncated")
                c, a = go(i + 1, nxt[state], 2)
                ways.append((c + 1 + extra, "R" + a))
                first = rows[i][1][:1]
                if first == nxt[state] or first == "s" and state == "":
                    c, a = go(i + 1, first, 2)
                    ways.append((c + extra, "K" + a))
        return min(ways, default=(10**9, "z"))

    for i in range(len(rows), -1, -1):  # from the end, so that no call goes deep
        for state in nxt:
            go(i, state, 2)
    return go(0, "", 2)


def replay(rows, audit):
    out, i = [], 0
    for e in audit:
        role = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if e == "I":
            out.append((role, ""))
            continue
        _, was, text = rows[i]
        i += 1
        if e != "D":
            out.append((was if e == "K" else role, text))
    assert GRAMMAR.match("".join(r[:1] for r, _ in out))
    return out


def damaged(table):
    out = {}
    for conv, turn, role, text in table:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if hit == 4 else role, text)] * {0: 0, 3: 2}.get(hit, 1))
    return out


def brute(table):
    out = []
    for conv, rows in damaged(table).items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        turns = [t for t, _, _ in rows if t is not None]
        f, first = faults(rows), [r[:1] for _, r, _ in rows]
        cost, audit = least_repair(rows)
        text = "\n".join(f"{r}:{t}" for r, t in replay(rows, audit))
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(first, first[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, table, tmp_path, parts=3):
    spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(parts).write.parquet(f"{tmp_path}/conversations.parquet")
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r[c] for c in columns) for r in o.op11_conversations(spark, str(tmp_path)).collect()), key=str)


def talk(rng, conv, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "sys", "us"]
    texts = ["Yes.", "Why?", "no end", " ", None, "\t", "Done! ", "a\n", ".", *[f"text {i}." for i in range(20)]]
    out, turn = [], rng.randrange(3)
    for i in range(n):
        role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[i % 2]
        out.append((conv, None if i == 0 and rng.random() < 0.3 else turn, role, rng.choice(texts)))
        turn += 1 + (rng.random() < 0.1)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_same_repairs_as_all_edits_tried(spark, tmp_path, seed):
    rng = random.Random(seed)
    table = [r for conv in range(120) for r in talk(rng, conv, rng.randrange(1, 14))] + talk(rng, None, 9)
    assert run(spark, table, tmp_path) == brute(table)


def test_a_conversation_over_many_ranges(spark, tmp_path):
    rng = random.Random(5)
    table = talk(rng, 7, 900) + talk(rng, 8, 5) + [r for conv in range(20, 40) for r in talk(rng, conv, 3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed, segments = o.plan_repairs(o.damage(spark.createDataFrame(table, "conv_id long, turn long, role string, text string")))
        assert segments.filter("conv = 7").count() >= 3  # the driver chains them
        assert run(spark, table, tmp_path) == brute(table)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_rows_and_odd_tables(spark, tmp_path):
    rows = [(1, 0, "user", "Hi.", 1), (1, 1, "user", "Hello.", 2), (1, 2, "assistant", "Yes.", 3), (2, 0, "system", "S.", 4), (3, None, None, None, 5), (None, 1, "user", "Q?", 6), (None, 1, "user", "Q?", 6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit int")
    got = {}
    for r in o.repaired_rows(df).orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    # the least of two deletions is the first; a system turn alone and a blank one go; a question alone goes sooner than it gets an answer
    assert got == {1: [("user", "Hello."), ("assistant", "Yes.")]}
    assert o.repaired_rows(df.limit(0)).collect() == []
    assert run(spark, [], tmp_path) == []


def test_very_long_conversation_and_text(spark, tmp_path):
    table = [(1, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(3000)] + [(2, 0, "user", "x" * 3_000_000 + "."), (2, 1, "assistant", "y.")]
    got = {r[0]: r for r in run(spark, table, tmp_path)}
    after = damaged(table)
    assert len(got[1][7].replace("I", "")) == len(after[1]) and got[2] == next(r for r in brute(table[3000:]) if r[0] == 2)
    assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in replay(sorted(after[1], key=lambda r: r[0]), got[1][7])).encode()).hexdigest() == got[1][8]
