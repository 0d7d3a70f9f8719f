"""Sources and sinks: what is written in each format and read again equals the tables it came from."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from massloom.catalog import query
from massloom.catalog.similarity import GROUPS, mass_groups
from massloom.functions.mass import PROTON, neutral_mass
from massloom.plans.store import shared_dir
from massloom.plans.views import view
from massloom.sources.files import read_scans, scan_from_csv, write_scans
from massloom.sources.processed import pack_deconvoluted, unpack_deconvoluted
from massloom.sources.mgf import read_processed_mgf, write_mgf
from massloom.sources.xml import locate_precursors, write_mzxml


def folder(spark, name):
    """A new folder under the shared one."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"


def scan_table(spark, d):
    """All spectra in the scan table's form."""
    p = view(spark, d, "v_peak").groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("mz", "intensity"))).alias("p"))
    s = view(spark, d, "v_peak_scan").join(p, "scan_id")
    two, z = F.col("ms_level") == 2, F.col("charge")
    kinds = F.array(F.when(F.col("scan_id") % 2 == 0, "collision-induced dissociation").otherwise("electron transfer dissociation"))
    return s.select(
        F.concat(F.lit("scan="), F.col("scan_id")).alias("id"), F.col("scan_id").alias("index"), "ms_level", "scan_time", F.lit(1).alias("polarity"), F.lit(False).alias("is_profile"),
        F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"),
        F.when(two, F.struct(F.col("precursor_mz").alias("mz"), F.lit(7.0).alias("intensity"), z.alias("charge"), F.lit(None).cast("string").alias("precursor_scan_id"))).alias("precursor"),
        F.when(two, F.struct(F.lit(1.5).alias("lower"), F.col("precursor_mz").alias("target"), F.lit(2.5).alias("upper"))).alias("isolation_window"),
        F.when(two, F.struct(kinds.alias("methods"), (F.lit(20.0) + z).alias("energy"))).alias("activation"),
        F.struct(F.col("scan_time").alias("injection_time"), F.array(F.struct(F.lit(100.0).alias("lower"), F.lit(2200.0).alias("upper"))).alias("windows")).alias("acquisition"),
    )


def told(scans, *more):
    """Id, precursor and the peaks' number, range and sums of each scan."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return scans.select(F.regexp_replace("id", "scan=", "").cast("long").alias("scan_id"), F.col("ms_level").cast("long").alias("ms_level"), F.round("scan_time", 4).alias("scan_time"), F.round("precursor.mz", 5).alias("precursor_mz"), F.col("precursor.charge").cast("long").alias("charge"), F.size("mz").cast("long").alias("n_peaks"), F.round(F.array_max("mz"), 5).alias("top_mz"), F.round(total("intensity"), 2).alias("tic"), *more)


CHARGED = "SELECT p.scan_id, p.charge, count(*) AS n, round(max(p.mz * p.charge - p.charge * {m}), 5) AS heaviest, round(sum(intensity), 2) AS intensity FROM v_peak p JOIN v_peak_scan s ON s.scan_id = p.scan_id WHERE ms_level = 2 GROUP BY p.scan_id, p.charge".replace("{m}", str(PROTON))


@query(CHARGED)
def processed_mgf_roundtrip(spark, d):
    """Deconvoluted product spectra written as MGF with a charge at each peak, and their masses read again."""
    path = folder(spark, "processed.mgf")
    p = view(spark, d, "v_peak").groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("mz", "intensity", "charge"))).alias("p"))
    s = scan_table(spark, d).drop("mz", "intensity").join(p, F.col("index") == F.col("scan_id"))
    write_mgf(s.select("*", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"), F.col("p.charge").cast("array<int>").alias("charges")).drop("p", "scan_id"), path)
    back = read_processed_mgf(spark, path).select(F.regexp_replace("id", "scan=", "").cast("long").alias("scan_id"), F.explode("peaks").alias("p")).select("scan_id", "p.*")
    return back.groupBy("scan_id", "charge").agg(F.count("*").alias("n"), F.round(F.max("neutral_mass"), 5).alias("heaviest"), F.round(F.sum("intensity"), 2).alias("intensity"))


PEAKS = "pk AS (SELECT scan_id, count(*) AS n_peaks, max(mz) AS top, sum(intensity) AS tic FROM v_peak GROUP BY scan_id)"
TOLD = "s.scan_id, CAST(ms_level AS BIGINT) AS ms_level, round(scan_time, 4) AS scan_time, CASE WHEN ms_level = 2 THEN round(precursor_mz, 5) END AS precursor_mz, CASE WHEN ms_level = 2 THEN CAST(charge AS BIGINT) END AS charge, n_peaks, round(top, 5) AS top_mz, round(tic, 2) AS tic"


@query(f"""WITH {PEAKS} SELECT {TOLD}, CASE WHEN ms_level = 2 THEN CASE WHEN s.scan_id % 2 = 0 THEN 'collision-induced dissociation' ELSE 'electron transfer dissociation' END END AS method, CASE WHEN ms_level = 2 THEN CAST(20 + charge AS DOUBLE) END AS energy,
CASE WHEN ms_level = 2 THEN round(precursor_mz - 1.5, 5) END AS window_low, round(scan_time, 4) AS injection_time, CAST(2200 AS DOUBLE) AS scan_window_high FROM v_peak_scan s JOIN pk ON pk.scan_id = s.scan_id""")
def mzml_roundtrip(spark, d):
    """Spectra written as mzML and read again, with activation, isolation window and acquisition."""
    path = folder(spark, "run.mzML")
    write_scans(scan_table(spark, d), path)
    w = F.col("isolation_window")
    more = [F.get("activation.methods", F.lit(0)).alias("method"), F.col("activation.energy").alias("energy"), F.round(w["target"] - w["lower"], 5).alias("window_low"), F.round("acquisition.injection_time", 4).alias("injection_time"), F.get("acquisition.windows", F.lit(0))["upper"].alias("scan_window_high")]
    return told(read_scans(spark, path), *more)


@query(f"WITH {PEAKS} SELECT {TOLD} FROM v_peak_scan s JOIN pk ON pk.scan_id = s.scan_id")
def mzxml_roundtrip(spark, d):
    """Spectra written as mzXML and read again, the format told from the files."""
    path = folder(spark, "run.mzXML")
    write_mzxml(scan_table(spark, d), path)
    return told(read_scans(spark, path).withColumn("id", (F.col("id").cast("long") - 1).cast("string")))


@query("""WITH o AS (SELECT *, max(CASE WHEN ms_level = 1 THEN scan_id END) OVER (ORDER BY scan_id ROWS UNBOUNDED PRECEDING) AS survey FROM v_peak_scan) SELECT scan_id, CASE WHEN survey IS NULL THEN NULL ELSE 'scan=' || survey END AS precursor_scan_id FROM o WHERE ms_level = 2 AND scan_id IN (SELECT scan_id FROM v_peak)""")
def mzml_precursor_walk_back(spark, d):
    """Products that name no precursor scan get the last MS1 before them."""
    path = folder(spark, "run.mzML")
    write_scans(scan_table(spark, d), path)
    s = locate_precursors(read_scans(spark, path)).filter("ms_level = 2")
    return s.select(F.regexp_replace("id", "scan=", "").cast("long").alias("scan_id"), "precursor.precursor_scan_id")


@query(f"WITH {PEAKS} SELECT {TOLD} FROM v_peak_scan s JOIN pk ON pk.scan_id = s.scan_id WHERE ms_level = 2")
def mgf_roundtrip(spark, d):
    """Product spectra written as MGF and read again."""
    path = folder(spark, "run.mgf")
    write_scans(scan_table(spark, d), path)
    return told(read_scans(spark, path))


@query(f"WITH {PEAKS} SELECT {TOLD} FROM v_peak_scan s JOIN pk ON pk.scan_id = s.scan_id")
def json_roundtrip(spark, d):
    """Spectra written as one JSON object each and read again."""
    path = folder(spark, "run.json")
    scans = scan_table(spark, d)
    write_scans(scans, path)
    return told(spark.read.schema(scans.schema).json(path))


@query(f"WITH {PEAKS} SELECT {TOLD} FROM v_peak_scan s JOIN pk ON pk.scan_id = s.scan_id")
def parquet_roundtrip(spark, d):
    """Spectra written as Parquet and read again."""
    path = folder(spark, "run.parquet")
    write_scans(scan_table(spark, d), path)
    return told(read_scans(spark, path))


@query(f"SELECT count(DISTINCT s.scan_id) AS n_scans, count(*) AS n_peaks, round(sum(DISTINCT precursor_mz * s.charge - (s.charge - 1) * {PROTON}), 3) AS protonated FROM v_peak_scan s JOIN v_peak p ON p.scan_id = s.scan_id WHERE ms_level = 2")
def ms2_text(spark, d):
    """Product spectra written as MS2 text, told by its scan, charge and peak lines."""
    path = folder(spark, "run.ms2")
    write_scans(scan_table(spark, d), path)
    lines = spark.read.text(path)
    kind = F.substring("value", 1, 2)
    mass = F.when(kind == "Z\t", F.split("value", "\t")[2].try_cast("double"))
    return lines.agg(F.count(F.when(kind == "S\t", 1)).alias("n_scans"), F.count(F.when(F.col("value").rlike(r"^[0-9]"), 1)).alias("n_peaks"), F.round(F.sum_distinct(mass), 3).alias("protonated"))


#: Deconvoluted peaks of a scan: one for each charge, with the peaks of that charge as envelope.
DECONVOLUTED = "dp AS (SELECT scan_id, charge, min(mz) AS mz, sum(intensity) AS intensity, count(*) AS n, sum(mz) AS s FROM v_peak GROUP BY scan_id, charge)"


@query(f"WITH {DECONVOLUTED} SELECT scan_id, CAST(charge AS BIGINT) AS charge, round(mz * charge - charge * {PROTON}, 5) AS neutral_mass, round(intensity, 2) AS intensity, n AS envelope_size, round(s, 4) AS envelope_mz FROM dp")
def processed_roundtrip(spark, d):
    """Deconvoluted peaks with charges and envelopes written as arrays of an mzML spectrum and read back."""
    path = folder(spark, "processed.mzML")
    key = F.concat(F.lit("scan="), F.col("scan_id")).alias("id")
    p = view(spark, d, "v_peak").groupBy(key, "charge").agg(F.min("mz").alias("mz"), F.sum("intensity").alias("intensity"), F.sort_array(F.collect_list(F.struct("mz", "intensity"))).alias("envelope"))
    write_scans(pack_deconvoluted(scan_table(spark, d), p), path)
    back = unpack_deconvoluted(read_scans(spark, path))
    size = F.aggregate("envelope", F.lit(0.0), lambda s, x: s + x["mz"])
    return back.select(F.regexp_replace("id", "scan=", "").cast("long").alias("scan_id"), F.col("charge").cast("long").alias("charge"), F.round("neutral_mass", 5).alias("neutral_mass"), F.round("intensity", 2).alias("intensity"), F.size("envelope").cast("long").alias("envelope_size"), F.round(size, 4).alias("envelope_mz"))


@query(f"{GROUPS} SELECT cluster_id, count(*) AS size, min(scan_id) AS first, round(max(precursor_mz), 5) AS neutral_mass FROM s GROUP BY cluster_id")
def cluster_json_roundtrip(spark, d):
    """Clusters written as one JSON object a line and read again."""
    path = folder(spark, "clusters.json")
    c = mass_groups(spark, d).groupBy("cluster_id").agg(F.max("precursor_mz").alias("neutral_mass"), F.count("*").alias("size"), F.sort_array(F.collect_list(F.struct("scan_id", "precursor_mz"))).alias("scans"))
    c.write.json(path)
    back = spark.read.schema(c.schema).json(path)
    return back.select("cluster_id", "size", F.get("scans", F.lit(0))["scan_id"].alias("first"), F.round("neutral_mass", 5).alias("neutral_mass"))


@query("""WITH g AS (SELECT *, max(CASE WHEN ms_level = 1 THEN scan_id END) OVER (ORDER BY scan_time, scan_id ROWS UNBOUNDED PRECEDING) AS survey FROM v_scan)
SELECT survey AS scan_id, count(*) FILTER (ms_level = 2) AS n_products, min(scan_id) FILTER (ms_level = 2) AS first FROM g WHERE survey IS NOT NULL GROUP BY survey""")
def index_roundtrip(spark, d):
    """The index of survey scans with their products, dumped as JSON and loaded."""
    from massloom.operators.ordered import previous_where

    path = folder(spark, "run-idx.json")
    g = previous_where(view(spark, d, "v_scan").select("scan_id", "scan_time", "ms_level"), ["scan_time", "scan_id"], F.col("ms_level") == 1, "scan_id", "survey").dropna(subset=["survey"])
    index = g.groupBy("survey").agg(F.min(F.when(F.col("ms_level") == 1, F.col("scan_time"))).alias("scan_time"), F.sort_array(F.collect_list(F.when(F.col("ms_level") == 2, F.col("scan_id")))).alias("product_scan_ids"))
    index.write.json(path)
    back = spark.read.schema(index.schema).json(path)
    return back.select(F.col("survey").alias("scan_id"), F.size("product_scan_ids").cast("long").alias("n_products"), F.get("product_scan_ids", F.lit(0)).alias("first"))


@query("SELECT scan_id, ms_level, round(scan_time, 4) AS scan_time, charge FROM v_scan")
def delimited_roundtrip(spark, d):
    """A table of scan headers written with a header line and read again."""
    path = folder(spark, "scans.csv")
    v = view(spark, d, "v_scan").select("scan_id", "ms_level", "scan_time", "charge")
    v.write.option("header", True).csv(path)
    back = spark.read.option("header", True).schema(v.schema).csv(path)
    return back.select("scan_id", "ms_level", F.round("scan_time", 4).alias("scan_time"), "charge")


@query("SELECT count(*) AS n_peaks, round(sum(intensity), 2) AS tic, round(max(mz), 5) AS top_mz FROM v_peak WHERE scan_id IN (SELECT min(scan_id) FROM v_peak)")
def scan_from_delimited(spark, d):
    """One spectrum written as two columns and read as a scan."""
    path = folder(spark, "scan.csv")
    p = view(spark, d, "v_peak")
    first = p.agg(F.min("scan_id").alias("scan_id"))
    p.join(F.broadcast(first), "scan_id").select("mz", "intensity").coalesce(1).write.csv(path)
    scan = scan_from_csv(spark, path).select(F.explode(F.arrays_zip("mz", "intensity")).alias("p")).select("p.*")
    return scan.agg(F.count("*").alias("n_peaks"), F.round(F.sum("intensity"), 2).alias("tic"), F.round(F.max("mz"), 5).alias("top_mz"))


@query("SELECT 'TIC' AS name, count(*) AS n_points, round(sum(tic), 2) AS total, round(max(scan_time), 4) AS last_time FROM v_scan WHERE ms_level = 1")
def chromatogram_roundtrip(spark, d):
    """The total ion chromatogram saved as arrays of time and signal, and loaded."""
    path = folder(spark, "chromatogram.json")
    v = view(spark, d, "v_scan").filter("ms_level = 1").select(F.floor("scan_time").alias("block"), "scan_time", "tic")
    c = v.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("scan_time", "tic"))).alias("p")).select(F.lit("TIC").alias("name"), "block", F.col("p.scan_time").alias("time"), F.col("p.tic").alias("intensity"))
    c.write.json(path)
    back = spark.read.schema(c.schema).json(path).select("name", F.explode(F.arrays_zip("time", "intensity")).alias("p"))
    return back.groupBy("name").agg(F.count("*").alias("n_points"), F.round(F.sum("p.intensity"), 2).alias("total"), F.round(F.max("p.time"), 4).alias("last_time"))


@query("WITH f AS (SELECT frame_id, floor(mz / 10) AS cell, mz, drift, intensity FROM v_ion) SELECT frame_id, CAST(cell AS BIGINT) AS feature_id, count(*) AS n, round(sum(intensity), 2) AS intensity, round(max(drift), 4) AS last_drift, round(min(mz), 5) AS low FROM f GROUP BY frame_id, cell")
def feature_arrays_roundtrip(spark, d):
    """Features of frames as parallel arrays of m/z, signal, drift time and feature id of one spectrum, written as mzML and taken apart again."""
    path = folder(spark, "frames.mzML")
    v = view(spark, d, "v_ion").select("frame_id", F.floor(F.col("mz") / 10).cast("double").alias("feature"), "mz", "drift", "intensity")
    rows = v.groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("mz", "intensity", "drift", "feature"))).alias("p"))
    none = F.lit(None)
    scans = rows.select(
        F.concat(F.lit("frame="), F.col("frame_id")).alias("id"), F.col("frame_id").alias("index"), F.lit(1).alias("ms_level"), F.lit(0.0).alias("scan_time"), F.lit(1).alias("polarity"), F.lit(False).alias("is_profile"), F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"),
        none.cast("struct<mz: double, intensity: double, charge: int, precursor_scan_id: string>").alias("precursor"), F.create_map(F.lit("mean drift time array"), F.col("p.drift"), F.lit("feature id array"), F.col("p.feature")).alias("extra"),
    )
    write_scans(scans, path)
    zipped = F.arrays_zip("mz", "intensity", F.col("extra")["mean drift time array"].alias("drift"), F.col("extra")["feature id array"].alias("feature"))
    back = read_scans(spark, path).select(F.regexp_replace("id", "frame=", "").cast("long").alias("frame_id"), F.explode(zipped).alias("p")).select("frame_id", "p.*")
    return back.groupBy("frame_id", F.col("feature").cast("long").alias("feature_id")).agg(F.count("*").alias("n"), F.round(F.sum("intensity"), 2).alias("intensity"), F.round(F.max("drift"), 4).alias("last_drift"), F.round(F.min("mz"), 5).alias("low"))


@query(f"WITH {DECONVOLUTED} SELECT scan_id, count(*) AS n_peaks, round(sum(mz * charge - charge * {PROTON}), 3) AS mass_sum FROM dp GROUP BY scan_id")
def deconvoluted_json_roundtrip(spark, d):
    """Deconvoluted peak lists as one JSON object a scan, and read again."""
    path = folder(spark, "deconvoluted.json")
    p = view(spark, d, "v_peak").groupBy("scan_id", "charge").agg(F.min("mz").alias("mz"), F.sum("intensity").alias("intensity"))
    rows = p.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("mz", "charge", "intensity"))).alias("peaks"))
    write_scans(rows, path)
    back = spark.read.schema(rows.schema).json(path).select("scan_id", F.explode("peaks").alias("p")).select("scan_id", "p.*")
    return back.groupBy("scan_id").agg(F.count("*").alias("n_peaks"), F.round(F.sum(neutral_mass(F.col("mz"), F.col("charge"))), 3).alias("mass_sum"))
