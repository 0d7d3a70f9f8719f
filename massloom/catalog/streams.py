"""Streaming operators run to the end of what is there, against SQL over the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.catalog import query
from massloom.plans.store import shared_dir
from massloom.plans.views import VIEWS, view
from massloom.streaming import scans as S


def stream(spark, d, name) -> DataFrame:
    """A view's table read as a stream of files."""
    table, columns = VIEWS[name]
    schema = spark.read.parquet(f"{d}/{table}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(d)
    return rows.selectExpr(*[c.strip() for c in split_columns(columns)])


def split_columns(columns: str) -> list[str]:
    """The select list cut at its commas outside brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[at:i])
            at = i + 1
    return [*out, columns[at:]]


def finished(rows: DataFrame) -> DataFrame:
    """What a stream has written once all that is there has been read."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


@query("""WITH w AS (SELECT channel, time_bucket(INTERVAL '6 hours', ts) AS w, intensity, max(ts) OVER () AS newest FROM v_signal) SELECT channel, CAST(epoch_us(w) // 1000000 AS BIGINT) AS window_start, count(*) AS n, round(sum(intensity), 4) AS intensity FROM w GROUP BY channel, w HAVING w + INTERVAL '6 hours' <= max(newest) - INTERVAL '1 hour'""")
def stream_chromatogram(spark, d):
    """Tumbling windows of a stream with a watermark: those that are closed."""
    out = finished(S.tumbling_chromatogram(stream(spark, d, "v_signal").select("channel", "ts", "intensity")))
    return out.select("channel", F.unix_seconds("window_start").alias("window_start"), "n", F.round("intensity", 4).alias("intensity"))


@query("""WITH g AS (SELECT run, channel, ts, intensity, CASE WHEN ts - lag(ts) OVER (PARTITION BY run, channel ORDER BY ts, event_id) >= INTERVAL '24 hours' THEN 1 ELSE 0 END AS new, max(ts) OVER () AS newest FROM v_signal),
s AS (SELECT *, sum(new) OVER (PARTITION BY run, channel ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT run, channel, count(*) AS n, round(sum(intensity), 4) AS total FROM s GROUP BY run, channel, k HAVING max(ts) + INTERVAL '24 hours' <= max(newest) - INTERVAL '1 hour'""")
def stream_sessions(spark, d):
    """Sessions of a stream with a watermark: those that are closed."""
    out = finished(S.sessions(stream(spark, d, "v_signal").select("run", "channel", "ts", "intensity")))
    return out.select("run", "channel", "n", F.round("total", 4).alias("total"))


@query("""WITH s AS (SELECT scan_id % 4 AS run, scan_id, ms_level, max(CASE WHEN ms_level = 1 THEN scan_id END) OVER (PARTITION BY scan_id % 4 ORDER BY scan_id ROWS UNBOUNDED PRECEDING) AS owner FROM v_scan),
o AS (SELECT run, owner, count(*) FILTER (ms_level = 2) AS n, dense_rank() OVER (PARTITION BY run ORDER BY owner DESC) AS age FROM s WHERE owner IS NOT NULL GROUP BY run, owner) SELECT run, owner AS precursor_id, n FROM o WHERE age > 5""")
def stream_interleaved_groups(spark, d):
    """Products grouped under their precursors as scans arrive, five precursors held for each run: the groups that have left."""
    s = stream(spark, d, "v_scan").select((F.col("scan_id") % 4).alias("run"), "scan_id", "ms_level", F.lit(None).cast("long").alias("precursor_id"))
    out = finished(S.interleaved_groups(s))
    return out.filter("precursor_id is not null").select("run", "precursor_id", F.size("products").cast("long").alias("n"))


@query("""SELECT ms_level, charge, count(*) AS n, min(scan_id) AS first, max(scan_id) AS last, round(min(precursor_mz), 5) AS low, round(max(precursor_mz), 5) AS high FROM v_scan GROUP BY ms_level, charge""")
def stream_index_refresh(spark, d):
    """An index of scans kept up to date as files arrive one by one: each batch is merged into what the batches before left."""
    parts = f"{shared_dir(spark)}/scans-{uuid.uuid4().hex}"
    view(spark, d, "v_scan").select("scan_id", "ms_level", "charge", "precursor_mz").repartition(4, "scan_id").write.parquet(parts)
    return S.refreshed_index(spark, parts)
