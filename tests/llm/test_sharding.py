import random
import zlib
from collections import Counter, defaultdict

from massloom.llm.op01_sharding import minimax_shards
from massloom.llm.textkit import NO_ID

SCHEMA = "doc_id long, text string, size string, shard int"


def best(sizes, k):
    """Smallest capacity by trying every one."""
    lo = max(max(sizes), -(-sum(sizes) // k))
    while True:
        n, left = 1, lo
        for s in sizes:
            if s > left:
                n, left = n + 1, lo
            left -= s
        if n <= k:
            return lo
        lo += 1


def test_smallest_capacity_and_slots(spark):
    rng = random.Random(1)
    texts = ["x" * rng.randrange(1, 60) + str(i) for i in range(400)]
    rows = [(i, rng.choice(texts), "clash", 9) for i in range(1500)] + [(None, None, None, None), (7, "", None, None), (3, texts[3], None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = minimax_shards(df, 8).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    of, total, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in got:
        of[r.text_crc32].add(r.shard)
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    keys = {r.text: r.k for r in df.selectExpr("coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS k").distinct().collect()}
    sizes = Counter()
    for _, t, *_ in rows:
        sizes[t or ""] += len((t or "").encode()) + 1
    ordered = [sizes[t] for t in sorted(keys, key=keys.get)]
    assert max(total.values()) == best(ordered, 8)


def test_a_third_of_all_rows_in_one_group(spark):
    rows = [(i, "hot text", None, None) for i in range(600)] + [(i, f"text {i}", None, None) for i in range(600, 1800)]
    total = Counter()
    for r in minimax_shards(spark.createDataFrame(rows, SCHEMA), 8).collect():
        total[r.shard] += r.size
    hot = max(total.values())
    rest = [v for v in total.values() if v != hot]
    assert hot == 600 * 9 and len(total) == 8 and max(rest) - min(rest) <= 100


def test_empty_and_single(spark):
    assert minimax_shards(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.slot for r in minimax_shards(spark.createDataFrame([(NO_ID, "a", None, None)], SCHEMA)).collect()] == [0]
