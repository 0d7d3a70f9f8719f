import hashlib
import random

import numpy as np

from massloom.llm import op12_lines as o

WS = " \t\n\v\f\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows):
    first, held = {}, {}
    docs = [(d, (t or "").split("\n")) for d, t in rows]
    for d, lines in docs:
        for line in lines:
            k = lower(line.strip(WS))
            if len(k) >= 10:
                first[k] = min(first.get(k, d), d)
                held.setdefault(k, set()).add(d)
    out = []
    for d, lines in docs:
        kept = [x for x in lines if not (len(held.get(k := lower(x.strip(WS)), ())) > 1 and first[k] != d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def run(spark, rows, tmp_path, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in o.op12_lines(spark, str(tmp_path)).collect()]


def test_same_lines_dropped_as_brute_force(spark, tmp_path):
    rng = random.Random(4)
    pool = ["short", "a line of some words", " A Line of some WORDS\t", "ÄÖÜ äöü漢字 x", "漢字漢字漢字漢字漢", "漢字漢字漢字漢字漢字", " not stripped ", "", "   ", "one more\rline here\r", *[f"line number {i}" for i in range(40)]]
    rows = [(d, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 12)))) for d in range(80)]
    rows += [(100 + d, "the line that most documents hold\nown line %d of it" % d) for d in range(300)] + [(500, None), (501, "")]
    assert sorted(run(spark, rows, tmp_path)) == brute(rows)


def test_a_line_that_fills_many_ranges_keeps_its_first_document(spark):
    n = 4000
    docs = spark.createDataFrame([(d, "common line of text\ncommon line of text") for d in range(n)], "doc_id long, text string").repartition(8)
    got = o.line_bitmaps(docs).agg({"n_dropped": "sum"}).first()[0]
    assert got == 2 * (n - 1)
    places = spark.range(n).selectExpr("5L as k1", "7L as k2", "id as doc_id", "0L as h", "0 as at")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        kinds = {r.kind: r["count"] for r in o.stream_runs(places).groupBy("kind").count().collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert kinds[o.OPEN] == n and kinds[o.HEAD] == 8 and o.DROP not in kinds  # four ranges, each filled by the one key


def test_odd_rows(spark, tmp_path):
    line = "ten letters and more"
    rows = [(None, line, 1), (1, line + "\nx", 2), (1, line + "\nx", 3), (2, line, 4), (2, line + "!", 5), (3, line + "!", 6), (4, None, 7), (5, "", 8)]
    got = sorted(((r[0] is not None, r[0] or 0), r[1], r[2]) for r in run(spark, rows, tmp_path, "doc_id long, text string, h int"))
    # the null id comes first and keeps the line; of id 2 the row with "!" keeps it before id 3
    assert got == [((False, 0), 1, 0), ((True, 1), 2, 1), ((True, 1), 2, 1), ((True, 2), 1, 0), ((True, 2), 1, 1), ((True, 3), 1, 1), ((True, 4), 1, 0), ((True, 5), 1, 0)]


def test_empty_table_and_very_long_texts(spark, tmp_path):
    assert run(spark, [], tmp_path) == []
    long = "x" * 2_000_000 + "\n" + "\n".join(f"line {i} of a long text" for i in range(100_000))
    got = o.line_bitmaps(spark.createDataFrame([(1, long), (2, long + "\nlast line of it")], "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in got}
    assert by[1].n_dropped == 0 and by[2].n_dropped == 100_001 and by[2].n_lines == 100_002
    assert np.flatnonzero(o.unpack_bits(by[2].keep, 100_002)).tolist() == [100_001] and len(by[2].keep) < 100
