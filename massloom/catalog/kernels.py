"""Operators that run per-group Arrow kernels; these have no SQL twin."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from massloom.catalog import query
from massloom.functions.mass import neutral_mass
from massloom.operators import compositions, isotopes, profiles, spectra
from massloom.plans.views import view


@query()
def deconvolute_graph(spark, d):
    """Monoisotopic masses with their charges, for every scan."""
    p = view(spark, d, "v_peak").select("scan_id", "mz", "intensity", "snr")
    return spectra.deconvolute(p, tolerance=1e-4)


@query()
def isotopic_cluster(spark, d):
    """Averagine patterns at each target's m/z and charge."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by number, so that few bytes do not come to one task
    t = view(spark, d, "v_target").select("target_id", "target_mass", F.explode(F.expr("sequence(1, 3)")).alias("charge")).repartition(n, "target_id", "charge")

    def kernel(batches):
        unit, pattern = isotopes.AVERAGINES["peptide"], lru_cache(1 << 14)(isotopes.truncated_pattern)
        for b in batches:
            x, y = [], []
            for mz, z in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                m, p = isotopes.isotopic_cluster(unit, mz, z, pattern=pattern)
                x.append(m.tolist())
                y.append(p.tolist())
            yield pa.record_batch([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.list_(pa.float64()))], ["target_id", "charge", "mz", "intensity"])

    return t.mapInArrow(kernel, "target_id long, charge int, mz array<double>, intensity array<double>")


PROFILE = """p AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(CAST(embedding AS DOUBLE[])) AS y, len(embedding) AS n FROM embeddings),
m AS (SELECT *, lag(y) OVER (PARTITION BY vec_id ORDER BY i) AS a, lead(y) OVER (PARTITION BY vec_id ORDER BY i) AS c FROM p),
k AS (SELECT *, CASE WHEN a - 2 * y + c = 0 THEN 0 ELSE 0.5 * (a - c) / (a - 2 * y + c) END AS shift FROM m WHERE y > a AND y >= c AND y >= 0),
h AS MATERIALIZED (SELECT vec_id, i, n, shift, y - 0.25 * (a - c) * shift AS height FROM k),
lo AS (SELECT h.vec_id, h.i, coalesce(max(p.i), 0) AS lo FROM h LEFT JOIN p ON p.vec_id = h.vec_id AND p.i <= h.i AND p.y <= height / 2 GROUP BY h.vec_id, h.i),
hi AS (SELECT h.vec_id, h.i, coalesce(min(p.i), max(h.n) - 1) AS hi FROM h LEFT JOIN p ON p.vec_id = h.vec_id AND p.i >= h.i AND p.y <= height / 2 GROUP BY h.vec_id, h.i)"""


def _cross(q, r):
    return f"CASE WHEN {r}.y = {q}.y THEN {q}.i ELSE {q}.i + (height / 2 - {q}.y) / ({r}.y - {q}.y) END"


@query(f"""WITH {PROFILE} SELECT h.vec_id, round(h.i + shift, 6) AS mz, round(height, 6) AS intensity, round({_cross("y1", "y2")} - {_cross("x1", "x2")}, 5) AS fwhm FROM h JOIN lo USING (vec_id, i) JOIN hi USING (vec_id, i)
JOIN p x1 ON x1.vec_id = h.vec_id AND x1.i = lo JOIN p x2 ON x2.vec_id = h.vec_id AND x2.i = lo + 1 JOIN p y1 ON y1.vec_id = h.vec_id AND y1.i = hi - 1 JOIN p y2 ON y2.vec_id = h.vec_id AND y2.i = hi""")
def pick_peaks(spark, d):
    """Centroids of the embeddings read as profiles."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("y"))

    def kernel(batches):
        for b in batches:
            rows = []
            for i, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [(i, *p) for p in spectra.pick_peaks(np.arange(len(y), dtype=float), np.asarray(y), 0.0)]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], ["vec_id", "mz", "intensity", "fwhm"])

    found = e.mapInArrow(kernel, "vec_id long, mz double, intensity double, fwhm double")
    return found.select("vec_id", F.round("mz", 6).alias("mz"), F.round("intensity", 6).alias("intensity"), F.round("fwhm", 5).alias("fwhm"))


@query("""WITH e AS (SELECT CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS y FROM embeddings), g AS (SELECT label, y, unnest(range(0, 2 * len(y) - 1)) AS step FROM e)
SELECT label, CAST(step AS BIGINT) AS step, round(avg(CASE WHEN step % 2 = 0 THEN y[step // 2 + 1] ELSE (y[step // 2 + 1] + y[step // 2 + 2]) / 2 END), 8) AS intensity FROM g GROUP BY label, step""")
def average_scans(spark, d):
    """The mean profile of each label's embeddings on a half-step grid."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("y"))
    return spectra.average_regular(e, "label", "y", 2).select("label", F.col("step").cast("long").alias("step"), F.round("intensity", 8).alias("intensity"))


@query()
def trace_features(spark, d):
    """Features of each channel's signal over time."""
    p = view(spark, d, "v_signal").select("channel", F.col("event_id").alias("id"), "mz", F.unix_micros("ts").alias("time"), "intensity")
    return spectra.trace_features(p, 2e-5, ("channel",))


def scan_vectors(spark, d):
    """(scan_id, mass, tic, bins, values) of every spectrum."""
    s = view(spark, d, "v_peak_scan").select("scan_id", neutral_mass(F.col("precursor_mz"), F.col("charge")).alias("mass"))
    b = view(spark, d, "v_peak").groupBy("scan_id", F.floor("mz").alias("bin")).agg(F.sum("intensity").alias("i"))
    v = b.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("bin", "i"))).alias("x"), F.sum("i").alias("tic"))
    return s.join(v, "scan_id").select("scan_id", "mass", "tic", F.col("x.bin").alias("bins"), F.col("x.i").alias("values"))


@query()
def cluster_scans(spark, d):
    """Scans clustered by precursor mass and binned cosine."""
    return spectra.cluster_scans(scan_vectors(spark, d), 2e-3)


@query()
def iterative_clustering(spark, d):
    """Scans clustered at rising similarity, each cluster again by itself."""
    return spectra.iterative_clusters(scan_vectors(spark, d), 2e-3, (0.1, 0.15, 0.2))


def chromatograms(spark, d):
    """Daily signal of each run."""
    return view(spark, d, "v_signal").groupBy("run", F.unix_date(F.to_date("ts")).alias("day")).agg(F.sum("intensity").alias("y"))


def of_chromatograms(spark, d, kernel, schema):
    """What a kernel makes of lists of chromatograms (run, days, signal), a table for each list.

    A fit costs far more than its bytes tell, so chromatograms are dealt over
    all shuffle partitions by number, which Spark does not put together again.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = chromatograms(spark, d).repartition(n, "run").groupBy("run").agg(F.sort_array(F.collect_list(F.struct("day", "y"))).alias("at"))

    def batches(found):
        for b in found:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                held = [(r, np.array(x, dtype=float), np.array(y, dtype=float)) for r, x, y in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True)]
                yield from kernel(held).to_batches()

    return rows.select("run", "at.day", "at.y").mapInArrow(batches, schema)


@query()
def shape_fit(spark, d):
    """How well each run's daily chromatogram has the shape of a peak."""

    def kernel(held):
        scores = profiles.shape_scores([(x, y) for _, x, y in held], "gaussian", 1)
        return pa.table({"run": pa.array([r for r, _, _ in held], pa.int64()), "n": pa.array([len(x) for _, x, _ in held], pa.int32()), "score": pa.array(scores, pa.float64())})

    return of_chromatograms(spark, d, kernel, "run long, n int, score double")


@query()
def adaptive_shape_fit(spark, d):
    """Each run's daily chromatogram fitted by several shapes, cut at its valleys or peak by peak: the best of them, how well it does and how many peaks it has."""

    def kernel(held):
        kind, way, test, centres = zip(*profiles.adaptive_fits([(x, y) for _, x, y in held], 1), strict=True)
        columns = {"run": pa.array([r for r, _, _ in held], pa.int64()), "n": pa.array([len(x) for _, x, _ in held], pa.int32()), "shape": pa.array(kind, pa.string()), "way": pa.array(way, pa.string())}
        return pa.table(columns | {"line_test": pa.array(test, pa.float64()), "peaks": pa.array(map(len, centres), pa.int32())})

    return of_chromatograms(spark, d, kernel, "run long, n int, shape string, way string, line_test double, peaks int")


@query()
def profile_split(spark, d):
    """Each run's daily chromatogram cut at its valleys."""

    def kernel(held):
        cut = [(r, i, float(a[0]), float(a[-1]), float(b.sum())) for r, x, y in held for i, (a, b) in enumerate(profiles.split_profile(x, y, 0.3))]
        kinds = {"run": pa.int64(), "part": pa.int32(), "start": pa.float64(), "end": pa.float64(), "total": pa.float64()}
        return pa.table({c: pa.array([row[k] for row in cut], t) for k, (c, t) in enumerate(kinds.items())})

    return of_chromatograms(spark, d, kernel, "run long, part int, start double, end double, total double")


@query()
def deconvolute_compositions(spark, d):
    """Envelopes of a few sugar compositions in every scan."""
    known = [(f"hex{h}hexnac{n}", {"C": 6 * h + 8 * n, "H": 10 * h + 13 * n + 2, "N": n, "O": 5 * h + 5 * n + 1}) for h in range(1, 5) for n in range(1, 3)]
    return compositions.deconvolute_compositions(view(spark, d, "v_peak"), known, charges=range(1, 4), tolerance=1e-4)
