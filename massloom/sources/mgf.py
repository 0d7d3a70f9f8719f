"""MGF text: reader and writer, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.functions.mass import neutral_mass

NUMBER = r"[-+0-9.eE]+"
KNOWN = ["TITLE", "PEPMASS", "CHARGE", "RTINSECONDS"]


def parse_charge(text: Column) -> Column:
    """``2+``, ``3-`` or a bare number to a signed charge; the first of a list; null if none."""
    size = F.regexp_extract(text, r"(\d+)([+-]?)", 1)
    sign = F.when(F.regexp_extract(text, r"(\d+)([+-]?)", 2) == "-", -1).otherwise(1)
    return F.when(size != "", size.try_cast("int") * sign)


def param(name: str) -> Column:
    found = F.regexp_extract("value", rf"(?m)^{name}=(.*?)\r?$", 1)
    return F.when(found != "", found)


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """One row for each BEGIN IONS block: products, centroided, the title as id.

    Retention times in seconds become minutes, -1 where absent; other
    parameters go into ``annotations``. Files split at block ends, so a large
    file is read by many tasks.
    """
    blocks = spark.read.option("lineSep", "END IONS").text(path).filter(F.col("value").contains("BEGIN IONS"))
    rows = F.expr(rf"regexp_extract_all(value, '(?m)^[ \\t]*({NUMBER})[ \\t]+({NUMBER})', 1)")
    heights = F.expr(rf"regexp_extract_all(value, '(?m)^[ \\t]*({NUMBER})[ \\t]+({NUMBER})', 2)")
    numbers = lambda c: F.transform(c, lambda x: x.try_cast("double"))
    pepmass = F.split(param("PEPMASS"), r"\s+")
    charge = parse_charge(param("CHARGE"))
    others = F.expr(r"map_from_entries(transform(filter(regexp_extract_all(value, '(?m)^([A-Za-z][^=\\r\\n]*=[^\\r\\n]*)', 1), x -> NOT substring_index(x, '=', 1) IN ('TITLE', 'PEPMASS', 'CHARGE', 'RTINSECONDS')), x -> struct(lower(substring_index(x, '=', 1)), substr(x, instr(x, '=') + 1))))")
    return blocks.select(
        param("TITLE").alias("id"),
        F.lit(2).alias("ms_level"),
        F.coalesce(param("RTINSECONDS").try_cast("double") / 60, F.lit(-1.0)).alias("scan_time"),
        F.when(charge < 0, -1).otherwise(1).alias("polarity"),
        F.lit(False).alias("is_profile"),
        numbers(rows).alias("mz"),
        numbers(heights).alias("intensity"),
        F.struct(F.get(pepmass, 0).try_cast("double").alias("mz"), F.get(pepmass, 1).try_cast("double").alias("intensity"), charge.alias("charge"), F.lit(None).cast("string").alias("precursor_scan_id")).alias("precursor"),
        others.alias("annotations"),
    )


def read_processed_mgf(spark: SparkSession, path: str) -> DataFrame:
    """The scans of :func:`read_mgf` with ``peaks``, deconvoluted: neutral mass, charge and intensity, by mass.

    Lines carry a charge after m/z and intensity, its sign before or after the
    number; a line without one is left out, as no mass follows from it.
    """
    charges = F.expr(rf"regexp_extract_all(value, '(?m)^[ \\t]*({NUMBER})[ \\t]+({NUMBER})(?:[ \\t]+([+-]?[0-9]+[+-]?))?', 3)")
    blocks = spark.read.option("lineSep", "END IONS").text(path).filter(F.col("value").contains("BEGIN IONS"))
    told = blocks.select(param("TITLE").alias("id"), charges.alias("z"))
    peak = lambda m, x: F.struct(m.alias("mz"), x["i"].alias("intensity"), parse_charge(x["z"]).alias("charge"))
    scans = read_mgf(spark, path).join(told, "id")
    rows = F.zip_with("mz", F.zip_with("intensity", "z", lambda i, z: F.struct(i.alias("i"), z.alias("z"))), peak)
    real = F.filter(rows, lambda p: p["charge"].isNotNull() & (p["charge"] != 0))
    mass = F.transform(real, lambda p: F.struct(neutral_mass(p["mz"], p["charge"]).alias("neutral_mass"), p["charge"].alias("charge"), p["intensity"].alias("intensity")))
    return scans.withColumn("peaks", F.sort_array(mass)).drop("z")


def write_mgf(scans: DataFrame, path: str) -> None:
    """Write product scans as MGF text, a part file for each partition; a column ``charges`` adds each peak's charge to its line."""
    line = F.zip_with("mz", "intensity", lambda m, i: F.concat_ws(" ", m, i))
    if "charges" in scans.columns:
        line = F.zip_with(line, "charges", lambda x, z: F.concat_ws(" ", x, F.concat(F.abs(z), F.when(z < 0, "-").otherwise("+"))))
    lines = F.array_join(line, "\n")
    z = F.col("precursor.charge")
    head = F.concat_ws(
        "\n",
        F.lit("BEGIN IONS"),
        F.concat(F.lit("TITLE="), "id"),
        F.concat(F.lit("RTINSECONDS="), F.col("scan_time") * 60),
        F.concat(F.lit("PEPMASS="), F.concat_ws(" ", F.col("precursor.mz"), F.col("precursor.intensity"))),
        F.concat(F.lit("CHARGE="), F.abs(z), F.when(z < 0, "-").otherwise("+")),
        F.when(F.size("mz") > 0, lines),
        F.lit("END IONS\n"),
    )
    scans.filter("ms_level > 1").select(head.alias("value")).write.mode("overwrite").text(path)
