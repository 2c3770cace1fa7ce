"""Spark session helpers.

The library never creates a cluster session on its own: callers pass their
``SparkSession``.  ``local_session`` is the single-machine builder used by the
tests and by ``bench.py``; ``checkpoint_dir`` reads the shared folder the
cluster names in ``spark.checkpoint.dir`` and only falls back to a scratch
folder when that setting is absent (local runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE_ZIP: str | None = None


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "voxloom") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        # checkpoint files are removed once their DataFrame is garbage collected
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: ``spark.checkpoint.dir`` when the cluster sets
    it, else a fresh local scratch folder (tests and single-machine runs)."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        spark.sparkContext.setCheckpointDir(conf)
        return conf
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    # a single-machine run (tests)
    local = tempfile.mkdtemp(prefix="voxloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder: computed once, read by
    column as often as needed, and still there when an executor is lost."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/voxloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make ``voxloom`` importable in Python workers (the ``--py-files`` step of
    a cluster submit): the package is zipped once per process and added once
    per SparkContext.  Operators that run Python on executors call this."""
    global _PACKAGE_ZIP
    sc = spark.sparkContext
    if getattr(sc, "_voxloom_shipped", False):
        return
    if _PACKAGE_ZIP is None or not os.path.exists(_PACKAGE_ZIP):
        pkg = os.path.dirname(os.path.abspath(__file__))
        root = os.path.dirname(pkg)
        out = os.path.join(tempfile.mkdtemp(prefix="voxloom-pkg-"), "voxloom.zip")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for dirpath, _, files in os.walk(pkg):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(dirpath, f)
                        z.write(full, os.path.relpath(full, root))
        _PACKAGE_ZIP = out
    sc.addPyFile(_PACKAGE_ZIP)
    sc._voxloom_shipped = True
