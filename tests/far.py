"""Run queries in a process whose workers have no copy of the package: an empty folder, no PYTHONPATH."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__
queries, failed = __spark_entry__.queries(), {}
for name in sys.argv[3:]:
    try:
        queries[name](spark, sys.argv[2]).write.format("noop").mode("overwrite").save()
    except Exception as e:
        failed[name] = [x for x in str(e).splitlines() if "Error" in x][-1:]
print("failed", failed)
sys.exit(bool(failed))
"""


def failures(data: str, names: list[str]) -> str:
    """What a run of the queries says if one fails, else an empty string."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    with tempfile.TemporaryDirectory() as empty:
        done = subprocess.run([sys.executable, "-c", SCRIPT, ROOT, data, *names], cwd=empty, env=env, capture_output=True, text=True)
    return "" if done.returncode == 0 else done.stdout[-3000:] + done.stderr[-500:]
