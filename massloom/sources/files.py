"""Choose readers and writers by name or content; JSON, MS2, CSV and Parquet forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.sources.mgf import read_mgf, write_mgf
from massloom.sources.xml import read_mzml, read_mzxml, write_mzml

CLOSED = {"raw": "vendor library", "d": "vendor library", "mzmlb": "HDF5 library", "wiff": "vendor library"}


def guess_format(spark: SparkSession, path: str) -> str:
    """mgf, mzml, mzxml or parquet from the name, else from the first thousand bytes."""
    name = path.lower().removesuffix(".gz").rstrip("/")
    for kind in ("mzxml", "mzml", "mgf", "parquet"):
        if name.endswith(f".{kind}"):
            return kind
    ending = name.rsplit(".", 1)[-1]
    if ending in CLOSED:
        raise NotImplementedError(f".{ending} files need a {CLOSED[ending]} that is not available; convert them to mzML first")
    head = spark.read.option("wholetext", "false").text(path).limit(50).agg(F.concat_ws("\n", F.collect_list(F.substring("value", 1, 1000)))).first()[0]
    for mark, kind in (("mzXML", "mzxml"), ("mzML", "mzml"), ("BEGIN IONS", "mgf")):
        if mark in head:
            return kind
    raise ValueError(f"no reader fits {path}")


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """Scans of a file or folder in any open format."""
    readers = {"mgf": read_mgf, "mzml": read_mzml, "mzxml": read_mzxml, "parquet": lambda s, p: s.read.parquet(p)}
    return readers[guess_format(spark, path)](spark, path)


def write_scans(scans: DataFrame, path: str) -> None:
    """Write scans in the format that the name asks for; Parquet if none."""
    name = path.lower().rstrip("/")
    if name.endswith(".mgf"):
        write_mgf(scans, path)
    elif name.endswith(".mzml"):
        write_mzml(scans, path)
    elif name.endswith(".json"):
        write_json(scans, path)
    elif name.endswith(".ms2"):
        write_ms2(scans, path)
    else:
        scans.write.mode("overwrite").parquet(path)


def scan_json(columns: list[str]) -> Column:
    """A scan as one JSON object."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_json(scans: DataFrame, path: str) -> None:
    scans.select(scan_json(scans.columns).alias("value")).write.mode("overwrite").text(path)


def write_ms2(scans: DataFrame, path: str) -> None:
    """Products as MS2 text: S, I and Z lines, then peaks."""
    z = F.coalesce(F.col("precursor.charge"), F.lit(1))
    mass = F.col("precursor.mz") * F.abs(z) - (F.abs(z) - 1) * 1.00727646677
    peaks = F.array_join(F.zip_with("mz", "intensity", lambda m, i: F.concat_ws(" ", m, i)), "\n")
    text = F.concat_ws("\n", F.concat_ws("\t", F.lit("S"), "id", "id", "precursor.mz"), F.concat_ws("\t", F.lit("I"), F.lit("RTime"), "scan_time"), F.concat_ws("\t", F.lit("Z"), z, mass), F.when(F.size("mz") > 0, peaks))
    scans.filter("ms_level > 1").select(text.alias("value")).write.mode("overwrite").text(path)


def scan_from_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = False, ms_level: int = 2) -> DataFrame:
    """A two-column peak list as one scan, sorted by m/z."""
    rows = spark.read.option("sep", delimiter).option("header", header).schema("mz double, intensity double").csv(path)
    peaks = F.sort_array(F.collect_list(F.struct("mz", "intensity")))
    return rows.dropna().groupBy(F.input_file_name().alias("id")).agg(peaks.alias("p")).select("id", F.lit(ms_level).alias("ms_level"), F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))
