"""Where a user's own functions go: scorers, scan filters, retention rules, selectors and tasks over scan ranges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def score_fits(pairs: DataFrame, fit: list[str], scorer: Callable[[Column, Column], Column], name: str = "score") -> DataFrame:
    """One score for each fit from a user's aggregate over the observed (``obs``) and expected (``theo``) peaks."""
    return pairs.groupBy(*fit).agg(scorer(F.col("obs"), F.col("theo")).alias(name))


def filter_scans(scans: DataFrame, keep: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """The scans for which a user's predicate over batches of them holds."""

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[keep(frame).to_numpy(dtype=bool)]

    return scans.mapInPandas(kernel, scans.schema)


def retain_peaks(peaks: DataFrame, solved: DataFrame, key: list[str], rule: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Peaks that no solution explains and that a user's rule keeps."""
    return rule(peaks.join(solved, key, "left_anti"))


def select_fits(fits: DataFrame, by: list[str], order: list, keep: Column, most: int) -> DataFrame:
    """The first ``most`` fits of each group in a user's order, of those that pass."""
    return fits.filter(keep).withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= most).drop("_r")


def over_ranges(scans: DataFrame, at: str, ranges: int, task: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's task over batches of scans, dealt in ranges of ``at``."""

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield task(frame)

    return scans.repartitionByRange(ranges, at).mapInPandas(kernel, schema)
