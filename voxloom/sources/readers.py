"""Scans (S1-S6).  Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom import vocab as V
from voxloom.functions.text import list_literal, py_strip, shard_path

__all__ = ["BULK_SCHEMA", "SPEAKER_ROW_SCHEMA", "read_table", "read_corpus", "read_shards", "shard_manifest",
           "scan_manifest", "read_transcripts", "scan_transcript_files", "read_transcript_files", "read_url_lists"]

BULK_SCHEMA = T.StructType([
    T.StructField("codes_list", T.ArrayType(T.IntegerType())),
    T.StructField("speaker_embedding", T.ArrayType(T.FloatType())),
    T.StructField("text", T.StringType()),
])

SPEAKER_ROW_SCHEMA = T.StructType([
    T.StructField("input_ids", T.ArrayType(T.IntegerType())),
    T.StructField("speaker_embedding", T.ArrayType(T.FloatType())),
])


def read_table(spark: SparkSession, path: str, min_partitions: int | None = None) -> DataFrame:
    """Parquet scan.  When the files give fewer scan splits than
    ``min_partitions`` (a single large row group, as in small fixtures), rows are
    spread round-robin so array-heavy work is not stuck in one task; a scan of
    a real corpus already has many splits and is left alone."""
    df = spark.read.parquet(path)
    if min_partitions and df.rdd.getNumPartitions() < min_partitions:
        df = df.repartition(min_partitions)
    return df


def read_corpus(spark: SparkSession, path: str, schema: T.StructType = BULK_SCHEMA) -> DataFrame:
    """A corpus table with a declared schema."""
    return spark.read.schema(schema).parquet(path)


def shard_manifest(indexes: DataFrame, index_col: str = "shard", root: str = "", fmt: str = V.SHARD_PATH_FORMAT) -> DataFrame:
    """S3: shard index -> path; indexes below 1 map to shard 0."""
    p = shard_path(index_col, fmt)
    return indexes.withColumn("path", F.concat(F.lit(root.rstrip("/") + "/") if root else F.lit(""), p))


def read_shards(spark: SparkSession, root: str, shards: list[int] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Rows of exported shards ``<root>/shard=<i>/``; partition pruning on
    ``shard`` reads only the requested ones."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.option("basePath", root).parquet(root)
    if shards is not None:
        df = df.filter(F.col("shard").isin(list(shards)))
    return df


def scan_manifest(spark: SparkSession, root: str, suffix: str = ".txt", skip_prefix: str | None = "-",
                  recursive: bool = False) -> DataFrame:
    """File manifest ``(stem, path)`` of files ending in ``suffix`` whose name
    does not start with ``skip_prefix``.  Only metadata is read."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}")
          .option("recursiveFileLookup", str(recursive).lower()).load(root).select("path"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    df = df.withColumn("_name", name)
    if skip_prefix:
        df = df.filter(~F.col("_name").startswith(skip_prefix))
    stem = F.expr(f"substring(_name, 1, length(_name) - {len(suffix)})")
    return df.filter(F.col("_name").endswith(suffix)).select(stem.alias("stem"), "path")


def read_transcripts(spark: SparkSession, root: str, suffix: str = ".txt", skip_prefix: str | None = "-") -> DataFrame:
    """One row per transcript file ``(stem, text)``, whole file, stripped the
    way ``str.strip()`` does; names starting with ``skip_prefix`` are left out."""
    df = (spark.read.option("pathGlobFilter", f"*{suffix}").text(root, wholetext=True)
          .select(F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("_name"), "value"))
    if skip_prefix:
        df = df.filter(~F.col("_name").startswith(skip_prefix))
    stem = F.expr(f"substring(_name, 1, length(_name) - {len(suffix)})")
    return df.select(stem.alias("stem"), py_strip("value").alias("text"))


def scan_transcript_files(spark: SparkSession, root: str, skip_prefix: str | None = "-") -> DataFrame:
    """S4 over the files of ``sinks.write_transcript_files``: ``(stem, path)``, stems
    that start with ``skip_prefix`` left out.  Only metadata is read."""
    file = [T.StructField("path", T.StringType(), False), T.StructField("modificationTime", T.TimestampType(), False),
            T.StructField("length", T.LongType(), False), T.StructField("content", T.BinaryType())]
    df = spark.read.format("binaryFile").schema(T.StructType([*file, T.StructField("stem", T.StringType())])).option("pathGlobFilter", "*.txt").load(root)
    if skip_prefix:
        df = df.filter(~F.col("stem").startswith(skip_prefix))
    return df.select("stem", "path")


def read_transcript_files(spark: SparkSession, root: str, skip_prefix: str | None = "-", strip: bool = True) -> DataFrame:
    """S5 over the same files: ``(stem, text)``, stripped as ``str.strip()`` does, or
    with ``strip=False`` exactly as written.  Stems are read as text, never as numbers."""
    schema = T.StructType([T.StructField("value", T.StringType()), T.StructField("stem", T.StringType())])
    df = spark.read.schema(schema).option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    if skip_prefix:
        df = df.filter(~F.col("stem").startswith(skip_prefix))
    # the sink ends each file with one line break
    text = py_strip("value") if strip else F.substring("value", F.lit(1), F.length("value") - 1)
    return df.select("stem", text.alias("text"))


def read_url_lists(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Files holding one list literal of URLs -> one row per URL.  Files that
    do not parse as a list go to the second (quarantine) frame."""
    raw = (spark.read.text(root, wholetext=True)
           .select(F.col("_metadata.file_path").alias("file"), "value"))
    parsed = raw.withColumn("_urls", list_literal("value"))
    good = parsed.filter(F.col("_urls").isNotNull()).select("file", F.posexplode("_urls").alias("pos", "url"))
    bad = parsed.filter(F.col("_urls").isNull()).select("file", F.lit("not a list literal").alias("error"))
    return good, bad
