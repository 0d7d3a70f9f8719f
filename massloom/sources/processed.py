"""Processed spectra: deconvoluted peaks and their envelopes as arrays of a scan, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.functions.mass import neutral_mass

CHARGES, ENVELOPES = "charge array", "isotopic envelopes array"


def envelopes_to_array(envelopes: Column) -> Column:
    """Envelopes (arrays of mz and intensity) as one flat array: pairs, with a pair of zeros behind each envelope."""
    flat = F.transform(envelopes, lambda e: F.concat(F.flatten(F.transform(e, lambda p: F.array(p["mz"], p["intensity"]))), F.array(F.lit(0.0), F.lit(0.0))))
    return F.flatten(flat)


def decode_envelopes(flat: Column) -> Column:
    """The envelopes of a flat array."""
    pairs = F.transform(F.sequence(F.lit(0), (F.size(flat) / 2 - 1).cast("int")), lambda i: F.struct(F.get(flat, (2 * i).cast("int")).alias("mz"), F.get(flat, (2 * i + 1).cast("int")).alias("intensity")))
    ends = F.filter(F.transform(pairs, lambda p, i: F.when((p["mz"] == 0) & (p["intensity"] == 0), i)), lambda i: i.isNotNull())
    cut = lambda end, k: F.slice(pairs, F.when(k == 0, 1).otherwise(F.get(ends, k - 1) + 2), end - F.when(k == 0, 0).otherwise(F.get(ends, k - 1) + 1))
    return F.when(F.size(flat) > 0, F.transform(ends, cut)).otherwise(F.array())


def pack_deconvoluted(scans: DataFrame, peaks: DataFrame) -> DataFrame:
    """``scans`` (id, ...) with their deconvoluted peaks (id, mz, charge, intensity, envelope) as arrays.

    m/z and intensity are the scan's own arrays then; charges and envelopes go
    into ``extra``, in the same order by m/z.
    """
    rows = peaks.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("mz", "charge", "intensity", "envelope"))).alias("p"))
    out = scans.drop("mz", "intensity", "extra").join(rows, "id")
    extra = F.create_map(F.lit(CHARGES), F.transform("p.charge", lambda z: z.cast("double")), F.lit(ENVELOPES), envelopes_to_array(F.col("p.envelope")))
    return out.withColumn("mz", F.col("p.mz")).withColumn("intensity", F.col("p.intensity")).withColumn("extra", extra).drop("p")


def unpack_deconvoluted(scans: DataFrame) -> DataFrame:
    """(id, neutral_mass, charge, intensity, mz, envelope): the deconvoluted peaks that a scan's arrays hold."""
    peaks = F.arrays_zip(F.col("mz"), F.col("intensity"), F.col("extra")[CHARGES].alias("charge"), decode_envelopes(F.col("extra")[ENVELOPES]).alias("envelope"))
    p = scans.select("id", F.explode(peaks).alias("p")).select("id", "p.mz", "p.intensity", F.col("p.charge").cast("int").alias("charge"), "p.envelope")
    return p.select("id", neutral_mass(F.col("mz"), F.col("charge")).alias("neutral_mass"), "charge", "intensity", "mz", "envelope")
