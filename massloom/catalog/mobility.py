"""Ion mobility frames: stacks of (m/z, drift time, intensity) points by frame."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from massloom.catalog import query
from massloom.operators.joins import nearest_join
from massloom.operators.ordered import sessionize
from massloom.plans.views import view


@query("SELECT frame_id, drift, count(*) AS n, round(sum(intensity), 2) AS intensity, round(min(mz), 6) AS low, round(max(mz), 6) AS high FROM v_ion GROUP BY frame_id, drift")
def unstack_frames(spark, d):
    """A frame taken apart into one spectrum for each drift time."""
    return view(spark, d, "v_ion").groupBy("frame_id", "drift").agg(F.count("*").alias("n"), F.round(F.sum("intensity"), 2).alias("intensity"), F.round(F.min("mz"), 6).alias("low"), F.round(F.max("mz"), 6).alias("high"))


@query("SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY mz, drift, intensity) - 1 AS place, round(mz, 6) AS mz, drift, intensity FROM v_ion")
def stack_frames(spark, d):
    """All points of a frame in one list by m/z, with drift times beside them."""
    w = W.partitionBy("frame_id").orderBy("mz", "drift", "intensity")
    return view(spark, d, "v_ion").select("frame_id", (F.row_number().over(w) - 1).cast("long").alias("place"), F.round("mz", 6).alias("mz"), "drift", "intensity")


@query("SELECT frame_id, CAST(floor(mz) AS BIGINT) AS mz_bin, drift, sum(intensity) AS intensity FROM v_ion GROUP BY ALL")
def mobility_grid(spark, d):
    """An m/z by drift time grid as sparse rows."""
    return view(spark, d, "v_ion").groupBy("frame_id", F.floor("mz").alias("mz_bin"), "drift").agg(F.sum("intensity").alias("intensity"))


@query("SELECT frame_id, drift, round(mz, 6) AS mz, intensity FROM v_ion WHERE mz BETWEEN 400 AND 420")
def mobility_between_mz(spark, d):
    """The points of an m/z range in every frame."""
    return view(spark, d, "v_ion").filter(F.col("mz").between(400, 420)).select("frame_id", "drift", F.round("mz", 6).alias("mz"), "intensity")


@query("SELECT frame_id, round(arg_min(mz, (abs(mz - 600), mz)), 6) AS mz, arg_min(drift, (abs(mz - 600), mz, drift)) AS drift FROM v_ion GROUP BY frame_id")
def mobility_find_mz(spark, d):
    """The point nearest to an m/z in every frame."""
    off = F.abs(F.col("mz") - 600)
    return view(spark, d, "v_ion").groupBy("frame_id").agg(F.round(F.min_by("mz", F.struct(off, "mz")), 6).alias("mz"), F.min_by("drift", F.struct(off, F.col("mz"), F.col("drift"))).alias("drift"))


@query("SELECT frame_id, CAST(floor(mz * 100 + 1e-6) AS BIGINT) AS mz_bin, round(sum(intensity), 2) AS intensity, count(DISTINCT drift) AS n_drift FROM v_ion GROUP BY frame_id, floor(mz * 100 + 1e-6)")
def flatten_to_scan(spark, d):
    """A frame summed over drift time: one spectrum."""
    return view(spark, d, "v_ion").groupBy("frame_id", F.floor(F.col("mz") * 100 + 1e-6).alias("mz_bin")).agg(F.round(F.sum("intensity"), 2).alias("intensity"), F.countDistinct("drift").alias("n_drift"))


@query("SELECT frame_id, drift AS nearest_drift, count(*) AS n FROM v_ion i WHERE abs(drift - 0.43) = (SELECT min(abs(drift - 0.43)) FROM v_ion j WHERE j.frame_id = i.frame_id) GROUP BY frame_id, drift")
def scan_by_drift_time(spark, d):
    """The spectrum of each frame whose drift time is nearest to a given one."""
    v = view(spark, d, "v_ion")
    q = v.select("frame_id").distinct().withColumn("want", F.lit(0.43))
    near = nearest_join(q, v.select("frame_id", "drift").distinct(), "want", "drift", ["frame_id"], [])
    n = v.groupBy("frame_id", F.col("drift").alias("nearest_drift")).agg(F.count("*").alias("n"))
    return near.select("frame_id", "nearest_drift").join(n, ["frame_id", "nearest_drift"])


CHAINS = """g AS (SELECT *, CASE WHEN (mz - lag(mz) OVER w) / mz <= 1e-4 THEN 0 ELSE 1 END AS new FROM v_ion WINDOW w AS (PARTITION BY frame_id ORDER BY mz, drift, intensity)),
s AS (SELECT *, sum(new) OVER (PARTITION BY frame_id ORDER BY mz, drift, intensity ROWS UNBOUNDED PRECEDING) AS chain FROM g)"""


def chains(spark, d):
    return sessionize(view(spark, d, "v_ion"), ["frame_id"], ["mz", "drift", "intensity"], ~F.coalesce((F.col("mz") - F.col("_prev.mz")) / F.col("mz") <= 1e-4, F.lit(False)), "chain")


@query(f"WITH {CHAINS} SELECT frame_id, round(sum(mz * intensity) / sum(intensity) + 1e-9, 5) AS mz, count(*) AS n, min(drift) AS first_drift, max(drift) AS last_drift, round(sum(intensity), 2) AS intensity FROM s GROUP BY frame_id, chain HAVING count(*) >= 2")
def extract_mobility_features(spark, d):
    """Features of a frame: points of near m/z over drift time, of two points or more."""
    g = chains(spark, d).groupBy("frame_id", "chain").agg(F.round(F.sum(F.col("mz") * F.col("intensity")) / F.sum("intensity") + 1e-9, 5).alias("mz"), F.count("*").alias("n"), F.min("drift").alias("first_drift"), F.max("drift").alias("last_drift"), F.round(F.sum("intensity"), 2).alias("intensity"))
    return g.filter("n >= 2").drop("chain")


@query(f"WITH {CHAINS}, f AS (SELECT frame_id, chain, sum(drift * intensity) / sum(intensity) AS centre, max(intensity) AS apex, count(*) AS n FROM s GROUP BY frame_id, chain HAVING count(*) >= 2) SELECT frame_id, count(*) AS n_features, round(avg(centre), 5) AS mean_drift, round(sum(apex), 2) AS apex_total FROM f GROUP BY frame_id")
def frame_summary(spark, d):
    """The features of each frame: number, mean drift time, summed apexes."""
    f = chains(spark, d).groupBy("frame_id", "chain").agg((F.sum(F.col("drift") * F.col("intensity")) / F.sum("intensity")).alias("centre"), F.max("intensity").alias("apex"), F.count("*").alias("n")).filter("n >= 2")
    return f.groupBy("frame_id").agg(F.count("*").alias("n_features"), F.round(F.avg("centre"), 5).alias("mean_drift"), F.round(F.sum("apex"), 2).alias("apex_total"))
