import json

from massloom.streaming.scans import interleaved_groups, tumbling_chromatogram


def run(stream, name, spark, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_tumbling_equals_batch(spark, tmp_path):
    rows = [{"channel": "a", "ts": f"2024-01-01T{h:02d}:10:00", "intensity": 1.0 * h} for h in range(12)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    s = spark.readStream.schema("channel string, ts timestamp, intensity double").json(str(tmp_path / "in"))
    got = run(tumbling_chromatogram(s), "tumbling", spark, "complete")
    assert sorted((r.n, r.intensity) for r in got) == [(6, 15.0), (6, 51.0)]


def test_interleaved_groups_hold_five(spark, tmp_path):
    rows, n = [], 0
    for _ in range(8):
        n += 1
        first = n
        rows.append({"run": 1, "scan_id": n, "ms_level": 1})
        for k in range(2):
            n += 1
            rows.append({"run": 1, "scan_id": n, "ms_level": 2, "precursor_id": first if k else None})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    s = spark.readStream.schema("run long, scan_id long, ms_level int, precursor_id long").json(str(tmp_path / "in"))
    got = {r.precursor_id: sorted(r.products) for r in run(interleaved_groups(s), "interleaved", spark)}
    assert got == {1: [2, 3], 4: [5, 6], 7: [8, 9]}
