"""Order-dependent operators: ranks, gaps, sessions, groups of scans, sliding windows.

Where rows are ordered inside keys, plain windows do. Where a whole table is in
one order, a window would bring all rows to one task. Those operators cut the
table into ranges of the order first (:func:`ordered_blocks`), work inside each
block, and carry totals or last values from block to block through a table of
one row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from massloom.plans.store import materialize


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_rank") <= k).drop("_rank")


def ordered_blocks(rows: DataFrame, order: list, blocks: int | None = None) -> DataFrame:
    """The rows with ``_block``, the number of their range in the order, and ``_n``, their place in the block.

    The table is written once, so that the ranges stay what they are however
    often it is read.
    """
    n = blocks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(rows.repartitionByRange(n, *order).withColumn("_block", F.spark_partition_id()), "blocks")
    return cut.withColumn("_n", F.row_number().over(W.partitionBy("_block").orderBy(*order)))


def inside(order: list | None = None) -> W:
    return W.partitionBy("_block").orderBy(*(order or ["_n"])).rowsBetween(W.unboundedPreceding, 0)


def add_before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Running total over blocks and inside them, this row included."""
    sums = rows.groupBy("_block").agg(F.sum(value).alias("_s"))
    before = sums.select("_block", (F.sum("_s").over(W.orderBy("_block")) - F.col("_s")).alias("_before"))
    own = rows.withColumn("_own", F.sum(value).over(inside())).join(F.broadcast(before), "_block")
    return own.withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before")


def running_total(rows: DataFrame, order: list, value: Column, name: str) -> DataFrame:
    """The total of ``value`` up to each row of the whole table."""
    return add_before(ordered_blocks(rows, order), value, name).drop("_block", "_n")


def row_numbers(rows: DataFrame, order: list, name: str) -> DataFrame:
    """The place of each row in the whole table, from 1."""
    return add_before(ordered_blocks(rows, order), F.lit(1), name).drop("_block", "_n")


def previous_where(rows: DataFrame, order: list, when: Column, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """The value of the last row, this one included, for which ``when`` holds: an as-of lookup."""
    held = F.when(when, F.col(value))
    if by:
        return rows.withColumn(name, F.last(held, ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    b = ordered_blocks(rows, order)
    last = b.groupBy("_block").agg(F.max_by(held, F.when(held.isNotNull(), F.col("_n"))).alias("_l"))
    carry = last.select("_block", F.last("_l", ignorenulls=True).over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)).alias("_c"))
    own = b.withColumn("_own", F.last(held, ignorenulls=True).over(inside())).join(F.broadcast(carry), "_block")
    return own.withColumn(name, F.coalesce("_own", "_c")).drop("_own", "_c", "_block", "_n")


def next_where(rows: DataFrame, order: list, when: Column, value: str, name: str) -> DataFrame:
    """The value of the first later row of the whole table for which ``when`` holds."""
    held = F.when(when, F.col(value))
    b = ordered_blocks(rows, order)
    first = b.groupBy("_block").agg(F.min_by(held, F.when(held.isNotNull(), F.col("_n"))).alias("_f"))
    # what follows is what came before in the order turned round: a frame that ends at each row is kept as it grows, one that begins there is read anew for every row
    back = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    carry = first.select("_block", F.last("_f", ignorenulls=True).over(back(W.orderBy(F.desc("_block")))).alias("_c"))
    ahead = back(W.partitionBy("_block").orderBy(F.desc("_n")))
    own = b.withColumn("_own", F.last(held, ignorenulls=True).over(ahead)).join(F.broadcast(carry), "_block")
    return own.withColumn(name, F.coalesce("_own", "_c")).drop("_own", "_c", "_block", "_n")


def sessionize(rows: DataFrame, by: list[str], order: list, breaks: Column, name: str = "session") -> DataFrame:
    """Number the runs of rows from 0: a new one starts where ``breaks`` is true. In it ``_prev`` is the row before."""
    row = F.struct(*rows.columns)
    new = F.coalesce(breaks, F.lit(False)).cast("int")
    if by:
        w = W.partitionBy(*by).orderBy(*order)
        marked = rows.withColumn("_prev", F.lag(row).over(w)).withColumn("_new", new)
        return marked.withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_prev", "_new")
    b = ordered_blocks(rows, order)
    last = b.groupBy("_block").agg(F.max_by(row, "_n").alias("_l"))
    carry = last.select("_block", F.lag("_l").over(W.orderBy("_block")).alias("_c"))
    own = b.withColumn("_lag", F.lag(row).over(W.partitionBy("_block").orderBy("_n"))).join(F.broadcast(carry), "_block")
    marked = own.withColumn("_prev", F.coalesce("_lag", "_c")).withColumn("_new", new).drop("_lag", "_c", "_prev")
    return add_before(marked, F.col("_new"), name).drop("_new", "_block", "_n")


def group_scans(scans: DataFrame, order: list, by: list[str] | None = None) -> DataFrame:
    """Number the groups that each MS1 opens for the product scans that follow; products before the first get 0."""
    opens = (F.col("ms_level") == 1).cast("int")
    if by:
        return scans.withColumn("group_id", F.sum(opens).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    return running_total(scans, order, opens, "group_id")


def sliding_windows(rows: DataFrame, ordinal: str, width: int, slide: int) -> DataFrame:
    """A row for each count window that holds it: windows of ``width`` rows start every ``slide`` rows."""
    last = F.floor(F.col(ordinal) / slide)
    first = F.greatest(F.lit(0), F.floor((F.col(ordinal) - width) / slide) + 1)
    return rows.withColumn("window_id", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def resample(points: DataFrame, by: list[str], time: str, value: str, step: float) -> DataFrame:
    """(by, grid, value) on a grid of ``step``: between neighbouring points of a group by a straight line, none outside its span.

    Points of one time are added first. A group of one point has a grid point
    only if it lies on the grid.
    """
    unique = points.groupBy(*by, F.col(time).alias("_t")).agg(F.sum(value).alias("_y"))
    w = W.partitionBy(*by).orderBy("_t")
    part = unique.withColumn("_t2", F.lead("_t").over(w)).withColumn("_y2", F.lead("_y").over(w))
    first = F.ceil(F.col("_t") / step)
    last = F.when(F.col("_t2").isNull(), F.floor(F.col("_t") / step)).otherwise(F.ceil(F.col("_t2") / step) - 1)
    held = part.withColumn("_a", first).withColumn("_b", last).filter("_a <= _b").withColumn("grid", F.explode(F.sequence("_a", "_b")))
    slope = (F.col("_y2") - F.col("_y")) / (F.col("_t2") - F.col("_t"))
    return held.select(*by, "grid", F.when(F.col("_t2").isNull(), F.col("_y")).otherwise(F.col("_y") + slope * (F.col("grid") * step - F.col("_t"))).alias(value))


def coalesce_spans(rows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Merge overlapping intervals of each group: gaps and islands."""
    w = W.partitionBy(*by).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    marked = rows.withColumn("_new", F.coalesce(F.col(start) > F.max(end).over(w), F.lit(True)).cast("int"))
    island = F.sum("_new").over(W.partitionBy(*by).orderBy(start, end).rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("_island", island).groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
