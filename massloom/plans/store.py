"""Cut lineage through Parquet tables in the folder that every executor shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings of the writes: shuffle files go when a write has ended, and Python
#: workers get batches of few rows, since one row may hold a long text.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent (tests, notebooks on one machine) a temporary
    folder is made and stored in the session; on a cluster that would not be
    shared, so it is refused there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
        own = tempfile.mkdtemp(prefix="massloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = "file://" + own
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(spark: SparkSession) -> set[str]:
    """Folders of this application that are written and not yet deleted; kept at its context, so that no function carries them along."""
    return spark.sparkContext.__dict__.setdefault("massloom_tables", set())


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    written(spark).discard(folder)


@atexit.register
def clear() -> None:
    """Delete every table that is still there: at the end of the driver, or before, once no result is read any more."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:  # else the session has ended before
        for folder in list(written(spark)):
            remove(spark, folder)


def materialize(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of it.

    A lost executor costs no more than the tasks that were running: what is
    written stays readable by all others. The shuffle files of the write are
    dropped when it has ended, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = {key: spark.conf.get(key, None) for key in WHILE_WRITING}
    try:
        for key, value in WHILE_WRITING.items():
            spark.conf.set(key, value)
        written(spark).add(path)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for each table, once nothing reads it."""
    bare = lambda p: p.split("://")[-1].removeprefix("file:").lstrip("/")
    for df in tables:
        spark = df.sparkSession
        root = bare(shared_dir(spark))
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if bare(folder).startswith(root + "/"):
                remove(spark, next((w for w in written(spark) if bare(w) == bare(folder)), folder))
