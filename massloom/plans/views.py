"""The driver's tables read as mass-spectrometry tables.

Each view is one SELECT that Spark and DuckDB both run, so that a query and
its SQL start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_peak": (
        "lineitem",
        "l_suppkey AS scan_id, 100 + l_extendedprice / CAST(50 AS DOUBLE) AS mz, l_quantity * 100 AS intensity, l_linenumber AS charge, 1 + l_tax * 100 AS snr, l_orderkey AS ord, l_partkey AS part",
    ),
    "v_peak_scan": (
        "supplier",
        "s_suppkey AS scan_id, s_suppkey * CAST(0.5 AS DOUBLE) AS scan_time, CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 2 END AS ms_level, 500 + (s_acctbal + 1000) / CAST(20 AS DOUBLE) AS precursor_mz, CAST(1 + s_suppkey % 4 AS INT) AS charge",
    ),
    "v_scan": (
        "orders",
        "o_orderkey AS scan_id, o_orderkey * CAST(0.01 AS DOUBLE) AS scan_time, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS ms_level, o_totalprice / CAST(250 AS DOUBLE) AS precursor_mz, o_totalprice AS tic, CAST(1 + o_custkey % 4 AS INT) AS charge, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE -1 END AS polarity, o_orderpriority AS instrument",
    ),
    "v_signal": ("events", "event_id, event_type AS channel, user_id AS run, CAST(ts AS TIMESTAMP) AS ts, value + 100 AS mz, value AS intensity"),
    "v_ion": ("lineitem", "l_suppkey AS frame_id, l_discount * 10 AS drift, 100 + l_extendedprice / CAST(50 AS DOUBLE) AS mz, l_quantity * 100 AS intensity"),
    "v_ion_point": (
        "lineitem",
        "l_orderkey * 8 + l_linenumber AS id, l_suppkey AS frame_id, l_discount * 10 AS drift, CAST(1 + l_linenumber % 3 AS INT) AS charge, 100 + l_extendedprice / CAST(50 AS DOUBLE) AS mz, l_quantity * 100 AS intensity",
    ),
    "v_target": ("part", "p_partkey AS target_id, p_brand AS name, p_retailprice AS target_mass, p_size AS size"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return spark.sql(f"SELECT {columns} FROM {{t}}", t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def with_views(sql: str) -> str:
    """The SQL with the views that it names defined in front."""
    used = [f"{n} AS (SELECT {c} FROM {t})" for n, (t, c) in VIEWS.items() if re.search(rf"\b{n}\b", sql)]
    recursive = sql.lstrip().upper().startswith("WITH RECURSIVE")
    body = sql.lstrip()
    if body.upper().startswith("WITH"):
        head, rest = ("WITH RECURSIVE ", body[len("WITH RECURSIVE") :]) if recursive else ("WITH ", body[len("WITH") :])
        return head + ", ".join([*used, rest.strip()])
    return ("WITH " + ", ".join(used) + " " if used else "") + body
