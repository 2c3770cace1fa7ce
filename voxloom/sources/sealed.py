"""Sealed shards (S7, K5, S2): rows first, the manifest that makes them readable last.

Layout: ``<path>/run=<run>/shard=<i>/`` holds the rows of one write and
``<path>/_manifest/run=<run>/`` its seals, one row per shard ``(shard, version,
n_rows, checksum)``.  Readers take the newest sealed version of a shard and
nothing else, so a write that dies leaves every shard as it was, and a shard
written again replaces only itself.  Older versions stay on disk.

Defined results: a shard none of whose rows are written has no seal; NULL is
not a shard; an unsealed folder has no rows; asking for a shard without a seal
is an error; repeated rows count.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.session import written

__all__ = ["write_sealed", "read_seals", "read_sealed", "damaged_shards"]

SEAL_SCHEMA = T.StructType([T.StructField("shard", T.LongType()), T.StructField("version", T.LongType()),
                            T.StructField("n_rows", T.LongType()), T.StructField("checksum", T.StringType())])
_WITH_RUN = T.StructType([*SEAL_SCHEMA.fields, T.StructField("run", T.StringType())])


def _contents(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per ``by``: rows and a checksum that does not depend on their order."""
    cols = sorted(c for c in rows.columns if c not in by)
    row = F.xxhash64(*(F.col(f"`{c}`") for c in cols)).cast("decimal(38,0)")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(row).cast("string").alias("checksum"))


def _all_seals(spark: SparkSession, path: str) -> DataFrame:
    root = f"{path}/_manifest"
    try:
        return spark.read.schema(_WITH_RUN).option("basePath", root).parquet(f"{root}/run=*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _WITH_RUN)  # nothing is sealed yet


def read_seals(spark: SparkSession, path: str) -> DataFrame:
    """The newest seal of every shard: ``shard, version, n_rows, checksum, run``."""
    seal = F.struct("version", "run", "n_rows", "checksum")
    return (_all_seals(spark, path).groupBy("shard").agg(F.max(seal).alias("s"))
            .select("shard", "s.version", "s.n_rows", "s.checksum", "s.run"))


#: bytes of the rows of one file, about (before compression)
FILE_BYTES = 128 << 20


def _row_bytes(schema: T.StructType) -> Column:
    """About the bytes of a row."""
    size = F.lit(8)
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType | T.MapType):
            inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType.valueType
            width = 4 if isinstance(inner, T.IntegerType | T.FloatType) else 8 if isinstance(inner, T.NumericType) else 32
            size = size + F.coalesce(F.size(c), F.lit(0)).cast("long") * width
        else:
            size = size + 8
    return size


def _dealt(rows: DataFrame, files_per_shard: int) -> DataFrame:
    """``rows`` dealt so that a shard's rows make at least ``files_per_shard`` files and one for each
    FILE_BYTES.  Rows that lie in about as many tasks already are left where they are."""
    per = written(rows.groupBy("shard").agg(F.sum(_row_bytes(rows.schema)).alias("_bytes")).select(
        "shard", F.greatest(F.lit(files_per_shard), F.ceil(F.col("_bytes") / FILE_BYTES)).cast("int").alias("_files")), "shard-files")
    shards, files = per.agg(F.count(F.lit(1)), F.coalesce(F.sum("_files"), F.lit(0))).first()
    tasks = rows.rdd.getNumPartitions()
    if files_per_shard <= tasks and files <= 4 * tasks and tasks * shards <= 4 * files:
        return rows
    salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns if c != "shard")), F.col("_files"))
    return rows.join(F.broadcast(per), "shard").repartition(max(1, files), "shard", salt).drop("_files")


def write_sealed(df: DataFrame, path: str, shard_col: str = "shard", files_per_shard: int = 1) -> str:
    """Writes the rows, reads back what the files hold, then seals it.  Returns
    the run's name.  A shard's rows are spread over ``files_per_shard`` files, or more where it
    is large (FILE_BYTES).  ``df`` is read twice: pass a written table."""
    spark, run = df.sparkSession, f"r-{uuid.uuid4().hex}"
    rows = df.where(F.col(shard_col).isNotNull()).withColumn("shard", F.col(shard_col).cast("long"))
    if shard_col != "shard":
        rows = rows.drop(shard_col)
    _dealt(rows, files_per_shard).select(rows.columns).write.partitionBy("shard").parquet(f"{path}/run={run}")
    held = _contents(spark.read.schema(rows.schema).parquet(f"{path}/run={run}"), ["shard"])
    before = read_seals(spark, path).select("shard", F.col("version").alias("_before"))
    seals = held.join(before, "shard", "left").select(
        "shard", (F.coalesce("_before", F.lit(0)) + 1).cast("long").alias("version"), "n_rows", "checksum")
    seals.write.parquet(f"{path}/_manifest/run={run}")
    return run


def read_sealed(spark: SparkSession, path: str, schema: T.StructType, shards: list[int] | None = None) -> DataFrame:
    """The rows of sealed shards, newest versions only, with ``shard``.  The
    seals are small beside the rows, so Spark prunes the runs and shards it
    reads by them.  ``shards`` without a seal raise an error."""
    seals = read_seals(spark, path)
    if shards is not None:
        seals = seals.where(F.col("shard").isin([int(s) for s in shards]))
        missing = set(map(int, shards)) - {r["shard"] for r in seals.select("shard").collect()}
        if missing:
            raise ValueError(f"shards without a seal: {sorted(missing)}")
    fields = [f for f in schema.fields if f.name not in ("shard", "run")]
    full = T.StructType([*fields, T.StructField("run", T.StringType()), T.StructField("shard", T.LongType())])
    rows = spark.read.schema(full).option("basePath", path).parquet(f"{path}/run=*")
    return rows.join(seals.select("run", "shard"), ["run", "shard"], "left_semi").drop("run")


def damaged_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Sealed shards whose files no longer hold what was sealed: ``shard,
    sealed_rows, n_rows`` (one full scan)."""
    held = _contents(read_sealed(spark, path, schema), ["shard"]).withColumnsRenamed({"n_rows": "_rows", "checksum": "_sum"})
    both = read_seals(spark, path).join(held, "shard", "left")
    return both.where(~F.col("checksum").eqNullSafe(F.col("_sum")) | ~F.col("n_rows").eqNullSafe(F.col("_rows"))).select(
        "shard", F.col("n_rows").alias("sealed_rows"), F.coalesce("_rows", F.lit(0)).alias("n_rows"))
