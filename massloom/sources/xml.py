"""mzML and mzXML: each spectrum element is a row of Spark's XML source; binary arrays are decoded in Arrow batches."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARAM = "array<struct<_accession: string, _name: string, _value: string, _unitName: string>>"
MZML = (
    f"_id string, _index long, cvParam {PARAM}, "
    f"scanList struct<scan: array<struct<cvParam: {PARAM}, scanWindowList: struct<scanWindow: array<struct<cvParam: {PARAM}>>>>>>, "
    f"precursorList struct<precursor: array<struct<_spectrumRef: string, isolationWindow: struct<cvParam: {PARAM}>, selectedIonList: struct<selectedIon: array<struct<cvParam: {PARAM}>>>, activation: struct<cvParam: {PARAM}>>>>, "
    f"binaryDataArrayList struct<binaryDataArray: array<struct<cvParam: {PARAM}, binary: string>>>"
)
SCAN_FIELDS = (
    "_num long, _msLevel int, _peaksCount long, _polarity string, _retentionTime string, _centroided int, "
    "precursorMz array<struct<_VALUE: double, _precursorIntensity: double, _precursorCharge: int, _precursorScanNum: string>>, "
    "peaks struct<_VALUE: string, _precision: int, _compressionType: string>"
)
#: Scans may hold the product scans that were taken from them.
MZXML = f"{SCAN_FIELDS}, scan array<struct<{SCAN_FIELDS}>>"

# fixed values: accessions of the vocabulary's terms that are read and written
ACCESSIONS = {
    "ms level": "MS:1000511", "scan start time": "MS:1000016", "ion injection time": "MS:1000927", "negative scan": "MS:1000129", "positive scan": "MS:1000130",
    "profile spectrum": "MS:1000128", "centroid spectrum": "MS:1000127", "m/z array": "MS:1000514", "intensity array": "MS:1000515", "charge array": "MS:1000516",
    "non-standard data array": "MS:1000786", "32-bit float": "MS:1000521", "64-bit float": "MS:1000523", "zlib compression": "MS:1000574", "no compression": "MS:1000576",
    "selected ion m/z": "MS:1000744", "peak intensity": "MS:1000042", "charge state": "MS:1000041", "isolation window target m/z": "MS:1000827",
    "isolation window lower offset": "MS:1000828", "isolation window upper offset": "MS:1000829", "scan window lower limit": "MS:1000501", "scan window upper limit": "MS:1000500",
    "collision energy": "MS:1000045", "collision-induced dissociation": "MS:1000133", "beam-type collision-induced dissociation": "MS:1000422",
    "electron transfer dissociation": "MS:1000598", "electron capture dissociation": "MS:1000250", "infrared multiphoton dissociation": "MS:1000262", "supplemental collision-induced dissociation": "MS:1002679",
}
DISSOCIATION = [n for n in ACCESSIONS if n.endswith("dissociation")]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def decode_array(texts: pd.Series, wide: pd.Series, packed: pd.Series) -> pd.Series:
    """Base64 text to numbers: 32 or 64 bits, little-endian, zlib-packed or not."""

    def one(text, is_wide, is_packed):
        if text is None or not str(text).strip():
            return np.zeros(0)
        data = base64.b64decode(text)
        return np.frombuffer(zlib.decompress(data) if is_packed else data, "<f8" if is_wide else "<f4").astype(float)

    return pd.Series([one(*x) for x in zip(texts, wide, packed, strict=True)])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def decode_arrays(extras: pd.Series) -> pd.Series:
    """Each row's further arrays, base64 as above."""

    def one(a):
        data = base64.b64decode(a["binary"] or "")
        return np.frombuffer(zlib.decompress(data) if a["packed"] and data else data, "<f8" if a["wide"] else "<f4").astype(float)

    return pd.Series([[one(a) for a in ([] if row is None else row)] for row in extras])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def decode_pairs(texts: pd.Series, precision: pd.Series, packed: pd.Series) -> pd.Series:
    """Interleaved big-endian (m/z, intensity) pairs, flat."""

    def one(text, bits, kind):
        if text is None or not str(text).strip():
            return np.zeros(0)
        data = base64.b64decode(text)
        return np.frombuffer(zlib.decompress(data) if kind == "zlib" else data, ">f8" if bits == 64 else ">f4").astype(float)

    return pd.Series([one(*x) for x in zip(texts, precision, packed, strict=True)])


def is_term(param: Column, name: str) -> Column:
    """Whether a parameter is the named term, told by its accession where the vocabulary has one, else by name."""
    by_name = param["_name"] == name
    return (param["_accession"] == ACCESSIONS[name]) | by_name if name in ACCESSIONS else by_name


def has(params: Column, name: str) -> Column:
    return F.coalesce(F.exists(params, lambda p: is_term(p, name)), F.lit(False))


def value(params: Column, name: str) -> Column:
    return F.get(F.filter(params, lambda p: is_term(p, name)), 0)["_value"]


def in_minutes(params: Column, name: str) -> Column:
    """A time parameter in minutes, whatever its unit."""
    p = F.get(F.filter(params, lambda p: is_term(p, name)), 0)
    t = p["_value"].try_cast("double")
    unit = p["_unitName"]
    return F.when(unit == "second", t / 60).when(unit == "millisecond", t / 60000).when(unit == "hour", t * 60).otherwise(t)


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """One row for each spectrum of mzML files (gzip too).

    Beside the scan table's columns: ``activation`` (methods, energy),
    ``acquisition`` (injection time, scan windows) and ``extra``, the further
    arrays by name. Terms are told by accession or name.
    """
    raw = spark.read.format("xml").option("rowTag", "spectrum").schema(MZML).load(path)
    array = lambda kind: F.get(F.filter(F.col("binaryDataArrayList.binaryDataArray"), lambda a: has(a["cvParam"], kind)), 0)
    numbers = lambda a: decode_array(a["binary"], has(a["cvParam"], "64-bit float"), has(a["cvParam"], "zlib compression"))
    own, scan, first = F.col("cvParam"), F.get(F.col("scanList.scan"), 0)["cvParam"], F.get(F.col("precursorList.precursor"), 0)
    ion, window = F.get(first["selectedIonList"]["selectedIon"], 0)["cvParam"], first["isolationWindow"]["cvParam"]
    real = lambda p, n: value(p, n).try_cast("double")
    act, windows = first["activation"]["cvParam"], F.get(F.col("scanList.scan"), 0)["scanWindowList"]["scanWindow"]
    more = F.filter(F.col("binaryDataArrayList.binaryDataArray"), lambda a: ~has(a["cvParam"], "m/z array") & ~has(a["cvParam"], "intensity array"))
    kind = lambda a: F.coalesce(value(a["cvParam"], "non-standard data array"), F.when(has(a["cvParam"], "charge array"), "charge array"), F.lit("other"))
    table = raw.select(
        F.col("_id").alias("id"),
        F.col("_index").alias("index"),
        value(own, "ms level").try_cast("int").alias("ms_level"),
        in_minutes(scan, "scan start time").alias("scan_time"),
        F.when(has(own, "negative scan"), -1).when(has(own, "positive scan"), 1).alias("polarity"),
        has(own, "profile spectrum").alias("is_profile"),
        array("m/z array").alias("_m"),
        array("intensity array").alias("_i"),
        F.when(first.isNotNull(), F.struct(real(ion, "selected ion m/z").alias("mz"), F.coalesce(real(ion, "peak intensity"), F.lit(0.0)).alias("intensity"), value(ion, "charge state").try_cast("int").alias("charge"), first["_spectrumRef"].alias("precursor_scan_id"))).alias("precursor"),
        F.when(window.isNotNull(), F.struct(F.coalesce(real(window, "isolation window lower offset"), F.lit(0.0)).alias("lower"), real(window, "isolation window target m/z").alias("target"), F.coalesce(real(window, "isolation window upper offset"), F.lit(0.0)).alias("upper"))).alias("isolation_window"),
        F.when(act.isNotNull(), F.struct(F.filter(F.array(*[F.when(has(act, n), n) for n in DISSOCIATION]), lambda x: x.isNotNull()).alias("methods"), real(act, "collision energy").alias("energy"))).alias("activation"),
        F.struct(real(scan, "ion injection time").alias("injection_time"), F.transform(windows, lambda w: F.struct(real(w["cvParam"], "scan window lower limit").alias("lower"), real(w["cvParam"], "scan window upper limit").alias("upper"))).alias("windows")).alias("acquisition"),
        F.transform(more, lambda a: F.struct(kind(a).alias("name"), a["binary"].alias("binary"), has(a["cvParam"], "64-bit float").alias("wide"), has(a["cvParam"], "zlib compression").alias("packed"))).alias("_extra"),
        F.map_from_entries(F.transform(F.filter(own, lambda p: p["_name"].isNotNull()), lambda p: F.struct(p["_name"], p["_value"]))).alias("annotations"),
    )
    order = ["id", "index", "ms_level", "scan_time", "polarity", "is_profile", "mz", "intensity", "precursor", "isolation_window", "annotations", "activation", "acquisition", "extra"]
    table = table.withColumn("mz", numbers(F.col("_m"))).withColumn("intensity", numbers(F.col("_i"))).withColumn("_lists", decode_arrays("_extra"))
    return table.withColumn("extra", F.map_from_arrays(F.coalesce("_extra.name", F.array().cast("array<string>")), F.coalesce("_lists", F.array().cast("array<array<double>>")))).select(order)


def read_mzxml(spark: SparkSession, path: str) -> DataFrame:
    """One row for each scan element of mzXML files; product scans may lie inside their survey scan's element.

    A nested scan without a precursor scan number gets that of the scan around it.
    """
    outer = spark.read.format("xml").option("rowTag", "scan").schema(MZXML).load(path)
    inner = outer.select(F.col("_num").cast("string").alias("_around"), F.explode("scan").alias("s")).select("s.*", "_around")
    raw = outer.drop("scan").withColumn("_around", F.lit(None).cast("string")).unionByName(inner)
    first = F.get("precursorMz", 0)
    time = F.regexp_extract("_retentionTime", r"PT([0-9.]+)S", 1).try_cast("double") / 60
    table = raw.select(
        F.col("_num").cast("string").alias("id"),
        (F.col("_num") - 1).alias("index"),
        F.col("_msLevel").alias("ms_level"),
        time.alias("scan_time"),
        F.when(F.col("_polarity") == "-", -1).otherwise(1).alias("polarity"),
        (F.coalesce("_centroided", F.lit(0)) == 0).alias("is_profile"),
        decode_pairs("peaks._VALUE", "peaks._precision", "peaks._compressionType").alias("flat"),
        F.when(first.isNotNull(), F.struct(first["_VALUE"].alias("mz"), first["_precursorIntensity"].alias("intensity"), first["_precursorCharge"].alias("charge"), F.coalesce(first["_precursorScanNum"], "_around").alias("precursor_scan_id"))).alias("precursor"),
    )
    every = lambda k: F.filter("flat", lambda x, i: i % 2 == k)
    return table.select("id", "index", "ms_level", "scan_time", "polarity", "is_profile", every(0).alias("mz"), every(1).alias("intensity"), "precursor")


def encode_array(values, wide: bool = True, packed: bool = True) -> str:
    data = np.asarray(values, dtype="<f8" if wide else "<f4").tobytes()
    return base64.b64encode(zlib.compress(data) if packed else data).decode()


def cv(name: str, value: object = "", unit: str = "") -> str:
    """One parameter of the vocabulary; a name without an accession is written by name alone."""
    accession = f' accession="{ACCESSIONS[name]}"' if name in ACCESSIONS else ""
    return f'<cvParam cvRef="MS"{accession} name={quoteattr(name)} value={quoteattr(str(value))}{f" unitName={quoteattr(unit)}" if unit else ""}/>'


def spectrum_element(scan: dict) -> str:
    """One mzML spectrum element."""
    named = {"m/z array": scan["mz"], "intensity array": scan["intensity"]} | dict(scan.get("extra") or {})
    arrays = ""
    for kind, values in named.items():
        text = encode_array(values)
        term = cv(kind) if kind in ACCESSIONS else cv("non-standard data array", kind)
        arrays += f'<binaryDataArray encodedLength="{len(text)}">{cv("64-bit float")}{cv("zlib compression")}{term}<binary>{text}</binary></binaryDataArray>'
    p, ion = scan.get("precursor"), ""
    if p:
        charge = cv("charge state", int(p["charge"])) if pd.notna(p["charge"]) else ""
        w, a = scan.get("isolation_window"), scan.get("activation")
        window = f'<isolationWindow>{cv("isolation window target m/z", w["target"])}{cv("isolation window lower offset", w["lower"])}{cv("isolation window upper offset", w["upper"])}</isolationWindow>' if w else ""
        broken = f'<activation>{"".join(cv(m) for m in a["methods"])}{cv("collision energy", a["energy"]) if pd.notna(a["energy"]) else ""}</activation>' if a else ""
        source = f" spectrumRef={quoteattr(p['precursor_scan_id'])}" if p.get("precursor_scan_id") else ""
        ion = f'<precursorList count="1"><precursor{source}>{window}<selectedIonList count="1"><selectedIon>{cv("selected ion m/z", p["mz"])}{cv("peak intensity", p["intensity"] or 0)}{charge}</selectedIon></selectedIonList>{broken}</precursor></precursorList>'
    own = cv("ms level", scan["ms_level"]) + cv("negative scan" if scan["polarity"] == -1 else "positive scan") + cv("profile spectrum" if scan["is_profile"] else "centroid spectrum")
    q = scan.get("acquisition") or {}
    spans = "".join(f'<scanWindow>{cv("scan window lower limit", x["lower"])}{cv("scan window upper limit", x["upper"])}</scanWindow>' for x in (q.get("windows") if q.get("windows") is not None else []))
    spans = f"<scanWindowList>{spans}</scanWindowList>" if spans else ""
    wait = cv("ion injection time", q["injection_time"], "millisecond") if q and pd.notna(q.get("injection_time")) else ""
    time = f'<scanList count="1"><scan>{cv("scan start time", scan["scan_time"], "minute")}{wait}{spans}</scan></scanList>'
    return f'<spectrum id={quoteattr(scan["id"])} index="{scan["index"]}" defaultArrayLength="{len(scan["mz"])}">{own}{time}{ion}<binaryDataArrayList count="{len(named)}">{arrays}</binaryDataArrayList></spectrum>'


def write_mzml(scans: DataFrame, path: str) -> None:
    """Write scans as mzML documents, one for each partition, in index order inside it."""
    columns = ["id", "index", "ms_level", "scan_time", "polarity", "is_profile", "mz", "intensity", "precursor"]
    columns += [c for c in ("isolation_window", "activation", "acquisition", "extra") if c in scans.columns]

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ['<?xml version="1.0" encoding="utf-8"?>\n<mzML xmlns="http://psi.hupo.org/ms/mzml" version="1.1.0"><run id="run"><spectrumList>']})
        for frame in frames:
            yield pd.DataFrame({"value": [spectrum_element(r) for r in frame.to_dict("records")]})
        yield pd.DataFrame({"value": ["</spectrumList></run></mzML>"]})

    scans.select(columns).sortWithinPartitions("index").mapInPandas(kernel, "value string").write.mode("overwrite").text(path)


def mzxml_element(scan: dict) -> str:
    """One mzXML scan element: pairs as packed 64-bit numbers in network order."""
    pairs = np.stack([np.asarray(scan["mz"], dtype=float), np.asarray(scan["intensity"], dtype=float)], axis=1).astype(">f8")
    p, ion = scan.get("precursor"), ""
    if p:
        charge = f' precursorCharge="{int(p["charge"])}"' if pd.notna(p["charge"]) else ""
        source = f" precursorScanNum={quoteattr(str(p['precursor_scan_id']))}" if p.get("precursor_scan_id") else ""
        ion = f'<precursorMz precursorIntensity="{p["intensity"] or 0}"{charge}{source}>{p["mz"]!r}</precursorMz>'
    head = f'num="{scan["index"] + 1}" msLevel="{scan["ms_level"]}" peaksCount="{len(pairs)}" polarity="{"-" if scan["polarity"] == -1 else "+"}" centroided="{int(not scan["is_profile"])}" retentionTime="PT{scan["scan_time"] * 60!r}S"'
    return f'<scan {head}>{ion}<peaks precision="64" byteOrder="network" contentType="m/z-int" compressionType="zlib">{base64.b64encode(zlib.compress(pairs.tobytes())).decode()}</peaks></scan>'


def write_mzxml(scans: DataFrame, path: str) -> None:
    """Write scans as mzXML documents, one for each partition, in index order inside it."""

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ['<?xml version="1.0" encoding="utf-8"?>\n<mzXML><msRun>']})
        for frame in frames:
            yield pd.DataFrame({"value": [mzxml_element(r) for r in frame.to_dict("records")]})
        yield pd.DataFrame({"value": ["</msRun></mzXML>"]})

    rows = scans.select("index", "ms_level", "scan_time", "polarity", "is_profile", "mz", "intensity", "precursor").sortWithinPartitions("index")
    rows.mapInPandas(kernel, "value string").write.mode("overwrite").text(path)


def locate_precursors(scans: DataFrame) -> DataFrame:
    """The scans with each product's missing precursor scan filled in: the last MS1 scan before it by index."""
    from massloom.operators.ordered import previous_where

    back = previous_where(scans, ["index"], F.col("ms_level") == 1, "id", "_survey")
    known = F.col("precursor").withField("precursor_scan_id", F.coalesce("precursor.precursor_scan_id", "_survey"))
    return back.withColumn("precursor", F.when(F.col("precursor").isNotNull(), known)).drop("_survey")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha1, declared, valid): each file's SHA-1 up to its own declaration, and the one it declares."""
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("t"), "content")
    mark = "<fileChecksum>"
    declared = F.regexp_extract("t", f"{mark}([0-9a-f]+)<", 1)
    head = F.substring_index("t", mark, 1)
    own = F.when(declared != "", F.sha1(F.concat(head, F.lit(mark)).cast("binary"))).otherwise(F.sha1("content"))
    return files.select("path", own.alias("sha1"), F.when(declared != "", declared).alias("declared"), (declared == own).alias("valid"))
