import os
import subprocess
import sys

SCRIPT = r"""
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", "{entry}")
E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").getOrCreate())
print("ROWS", E.queries()["packed_rows"](spark, "/root/testdata/sf0.001").count())
"""


def test_python_stages_run_from_another_directory(tmp_path):
    """Python workers get the package shipped with the job (no reliance on the
    driver's working directory or PYTHONPATH)."""
    entry = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(entry=entry)], cwd=str(tmp_path), env=env,
                         capture_output=True, text=True, timeout=600)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
    assert int(out.stdout.split("ROWS")[1].split()[0]) > 0
