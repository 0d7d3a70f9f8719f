import random

from pyspark.sql import functions as F

from massloom.operators.ordered import group_scans, next_where, ordered_blocks, previous_where, row_numbers, sessionize


def rows(n=200, seed=1):
    rng = random.Random(seed)
    out = [(i, rng.randrange(0, 60) / 10, rng.choice([1, 2, 2, 2])) for i in range(n)]
    return out, sorted(out, key=lambda r: (r[1], r[0]))


def test_whole_table_orders(spark):
    data, want = rows()
    df = spark.createDataFrame(data, "scan_id long, t double, ms_level int").repartition(3)
    order = ["t", "scan_id"]
    assert [r.scan_id for r in row_numbers(df, order, "n").orderBy("n").collect()] == [r[0] for r in want]
    opened, last, group, before = 0, None, {}, {}
    for i, _, level in want:
        if level == 1:
            opened, last = opened + 1, i
        group[i], before[i] = opened, last
    assert {r.scan_id: r.group_id for r in group_scans(df, order).collect()} == group
    assert {r.scan_id: r.p for r in previous_where(df, order, F.col("ms_level") == 1, "scan_id", "p").collect()} == before
    after, nxt = {}, None
    for i, _, level in reversed(want):
        after[i] = nxt
        nxt = i if level == 1 else nxt
    assert {r.scan_id: r.p for r in next_where(df, order, F.col("ms_level") == 1, "scan_id", "p").collect()} == after
    session, k, prev = {}, 0, None
    for i, t, _ in want:
        k += prev is not None and t - prev > 0.15
        session[i], prev = k, t
    assert {r.scan_id: r.session for r in sessionize(df, [], order, F.col("t") - F.col("_prev.t") > 0.15).collect()} == session


def test_blocks_are_several_and_empty_tables_pass(spark):
    data, _ = rows()
    df = spark.createDataFrame(data, "scan_id long, t double, ms_level int")
    assert ordered_blocks(df, ["t", "scan_id"]).select("_block").distinct().count() > 1
    assert row_numbers(df.limit(0), ["t"], "n").count() == 0


def test_resampling_follows_straight_lines(spark):
    from massloom.operators.ordered import resample

    rows = [("a", 0.5, 1.0), ("a", 2.5, 5.0), ("a", 2.5, 1.0), ("a", 3.0, 0.0), ("b", 4.0, 7.0), ("c", 4.2, 7.0)]
    got = {(r.k, r.grid): r.y for r in resample(spark.createDataFrame(rows, "k string, t double, y double"), ["k"], "t", "y", 1.0).collect()}
    assert got == {("a", 1): 2.25, ("a", 2): 4.75, ("a", 3): 0.0, ("b", 4): 7.0}
