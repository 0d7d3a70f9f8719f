import pytest
from pyspark.sql import functions as F

from massloom.sources.files import guess_format, read_scans, scan_from_csv, write_scans
from massloom.sources.schemas import SCAN


def scans(spark):
    rows = [
        ("scan=1", 0, 1, 0.5, 1, True, [100.0, 200.5], [10.0, 20.0], None, None, None),
        ("scan=2", 1, 2, 0.75, -1, False, [150.25], [5.5], (321.5, 9.0, -2, None), None, None),
        ("scan=3", 2, 2, 1.0, 1, False, [], [], (400.25, 1.0, 3, None), None, None),
    ]
    return spark.createDataFrame(rows, SCAN)


def test_mzml_round_trip(spark, tmp_path):
    path = f"{tmp_path}/run.mzML"
    write_scans(scans(spark).coalesce(1), path)
    got = {r.id: r for r in read_scans(spark, path).collect()}
    assert got["scan=1"].mz == [100.0, 200.5] and got["scan=1"].is_profile and got["scan=1"].precursor is None
    assert got["scan=2"].precursor.charge == -2 and got["scan=2"].polarity == -1 and got["scan=2"].scan_time == 0.75
    assert got["scan=3"].mz == [] and got["scan=3"].ms_level == 2


def test_mgf_round_trip(spark, tmp_path):
    path = f"{tmp_path}/run.mgf"
    write_scans(scans(spark), path)
    got = {r.id: r for r in read_scans(spark, path).collect()}
    assert set(got) == {"scan=2", "scan=3"}
    assert got["scan=2"].mz == [150.25] and got["scan=2"].precursor.charge == -2 and abs(got["scan=2"].scan_time - 0.75) < 1e-9
    assert got["scan=2"].polarity == -1 and got["scan=3"].mz == []


def test_mgf_annotations(spark, tmp_path):
    p = tmp_path / "a.mgf"
    p.write_text("BEGIN IONS\nTITLE=a b\nPEPMASS=500.5 3e4\nCHARGE=2+ and 3+\nSEQ=PEP=TIDE\n100.5 1\n101.5\t2e1\nEND IONS\n\nBEGIN IONS\nTITLE=second\nPEPMASS=10\nEND IONS\n")
    a, b = sorted(read_scans(spark, str(p)).collect(), key=lambda r: r.id)
    assert a.precursor.mz == 500.5 and a.precursor.intensity == 3e4 and a.precursor.charge == 2 and a.annotations == {"seq": "PEP=TIDE"}
    assert a.mz == [100.5, 101.5] and a.intensity == [1.0, 20.0] and b.scan_time == -1 and b.precursor.charge is None


def test_mzxml(spark, tmp_path):
    import base64

    import numpy as np

    data = base64.b64encode(np.array([100.0, 1.0, 200.0, 2.0], ">f4").tobytes()).decode()
    p = tmp_path / "a.mzXML"
    p.write_text(f'<mzXML><msRun><scan num="7" msLevel="2" peaksCount="2" polarity="-" retentionTime="PT90.0S" centroided="1"><precursorMz precursorIntensity="5" precursorCharge="2">300.5</precursorMz><peaks precision="32" byteOrder="network">{data}</peaks></scan></msRun></mzXML>')
    (r,) = read_scans(spark, str(p)).collect()
    assert (r.id, r.mz, r.intensity, r.scan_time, r.polarity) == ("7", [100.0, 200.0], [1.0, 2.0], 1.5, -1) and r.precursor.mz == 300.5


def test_sniffing_and_closed_formats(spark, tmp_path):
    p = tmp_path / "unnamed"
    p.write_text("BEGIN IONS\nEND IONS\n")
    assert guess_format(spark, str(p)) == "mgf"
    with pytest.raises(NotImplementedError):
        guess_format(spark, "x.raw")


def test_csv_json_ms2(spark, tmp_path):
    p = tmp_path / "peaks.csv"
    p.write_text("200.0,2\n100.0,1\n")
    assert scan_from_csv(spark, str(p)).first().mz == [100.0, 200.0]
    write_scans(scans(spark), f"{tmp_path}/a.json")
    assert spark.read.json(f"{tmp_path}/a.json").filter(F.col("id") == "scan=2").first().mz == [150.25]
    write_scans(scans(spark).coalesce(1), f"{tmp_path}/a.ms2")
    assert "Z\t-2" in "".join(r.value + "\n" for r in spark.read.text(f"{tmp_path}/a.ms2").collect())
