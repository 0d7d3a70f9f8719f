"""Streaming twins of the ordered operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from massloom.plans.store import shared_dir


def tumbling_chromatogram(events: DataFrame, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Signal by channel and window; rows later than ``late`` behind the newest are dropped."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy("channel", w.alias("w")).agg(F.count("*").alias("n"), F.sum("intensity").alias("intensity")).select("channel", F.col("w.start").alias("window_start"), "n", "intensity")


def sessions(events: DataFrame, gap: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Features as sessions: runs of a channel's points with no gap above ``gap``."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("run", "channel", s.alias("s")).agg(F.count("*").alias("n"), F.sum("intensity").alias("total")).select("run", "channel", F.col("s.start").alias("start"), "n", "total")


#: What an index holds of each key; every part merges with itself.
INDEX = {"n": F.sum, "first": F.min, "last": F.max, "low": F.min, "high": F.max}


def refreshed_index(spark: SparkSession, folder: str, files_a_batch: int = 1) -> DataFrame:
    """(ms_level, charge, n, first, last, low, high) of the scan files in ``folder``, refreshed by each batch of new files.

    A batch writes the index as a new generation: the one before merged with
    the batch's own counts, which are as small as the index. A batch that is run again after a failure
    writes the same generation, so no file counts twice.
    """
    out = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    schema = spark.read.parquet(folder).schema

    made = []

    def refresh(batch: DataFrame, number: int) -> None:
        own = batch.groupBy("ms_level", "charge").agg(F.count("*").alias("n"), F.min("scan_id").alias("first"), F.max("scan_id").alias("last"), F.min("precursor_mz").alias("low"), F.max("precursor_mz").alias("high"))
        if number:
            own = own.unionByName(batch.sparkSession.read.schema(own.schema).parquet(f"{out}/generation-{number - 1}"))
        own.groupBy("ms_level", "charge").agg(*[f(c).alias(c) for c, f in INDEX.items()]).write.mode("overwrite").parquet(f"{out}/generation-{number}")
        made.append(number)

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    q = rows.writeStream.foreachBatch(refresh).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/generation-{max(made)}").withColumn("low", F.round("low", 5)).withColumn("high", F.round("high", 5))


def interleaved_groups(scans: DataFrame, buffering: int = 5) -> DataFrame:
    """Group products under their precursor as scans arrive, holding ``buffering`` precursors for each run.

    ``scans`` is a stream of (run, scan_id, ms_level, precursor_id). A group
    (run, precursor_id, products) leaves when its precursor is older than the
    buffer; a product without a precursor id joins the newest; products whose
    precursor has left come out as a group of their own.
    """
    schema = "run long, precursor_id long, products array<long>"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        order, members = state.get if state.exists else ([], [])
        held = dict(zip(order, [list(m) for m in members], strict=True))
        out: list[tuple[int, list[int]]] = []
        rows = pd.concat(list(frames)).sort_values("scan_id")
        for r in rows.itertuples():
            if r.ms_level == 1:
                held.setdefault(int(r.scan_id), [])
                while len(held) > buffering:
                    first = next(iter(held))
                    out.append((first, held.pop(first)))
            else:
                owner = int(r.precursor_id) if pd.notna(r.precursor_id) else (list(held)[-1] if held else None)
                if owner in held:
                    held[owner].append(int(r.scan_id))
                else:
                    out.append((owner, [int(r.scan_id)]))
        state.update((list(held), list(held.values())))
        yield pd.DataFrame({"run": [key[0]] * len(out), "precursor_id": [k for k, _ in out], "products": [v for _, v in out]})

    return scans.groupBy("run").applyInPandasWithState(step, schema, "precursors array<long>, products array<array<long>>", "append", GroupStateTimeout.NoTimeout)
