"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.session import checkpoint_dir, ship_package

#: ASCII white space, as a Java regex class body
WS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Make the package importable in Python workers."""
    ship_package(spark)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor re-reads the file, it does not recompute
    the plan, and what a nondeterministic partition numbering produced stays
    as written.  The write's own shuffle files go once it is done."""
    spark = df.sparkSession
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, None)
    spark.conf.set(clean, "true")
    path = f"{checkpoint_dir(spark).rstrip('/')}/voxloom-{tag}-{uuid.uuid4().hex}"
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(clean)
        else:
            spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{WS}]+"), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def free_name(taken: Iterable[str], base: str) -> str:
    """A column name that no input column has (case-insensitive)."""
    low, name = {c.lower() for c in taken}, base
    while name.lower() in low:
        name = f"_{name}"
    return name


def held_out(doc_id: Column) -> Column:
    """The fixed fold no label is learned from: crc32(doc_id as text) mod 5 = 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
