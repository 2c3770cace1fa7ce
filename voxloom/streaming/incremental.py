"""Process every shard exactly once, with a run log.

The reference pulls the next shard index from a central counter and loops until
the last index.  Here the shard directory is a file stream: each run picks up
only files not yet committed in the checkpoint, processes them with the given
transform, then stops (``availableNow``).  A crashed
run restarts from the checkpoint; no shard is processed twice.

``ingest_new_shards`` appends rows only.  ``ingest_logged`` also isolates failing
shards: each micro-batch writes the rows of its good shards, and a log row per
shard with status, row count and error text.  ``retry_failed`` reads the shards whose
last entry is a failure again.  Rows and log of an attempt go to folders
named by it (``run=...``), rows first, so an attempt that is repeated after a
crash replaces itself and is never counted twice; a run without a log entry is
not read back.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.session import written

#: longer than any corpus is collected for
NO_AGE_LIMIT = "36500d"

LOG_SCHEMA = "shard string, attempt int, status string, n_rows long, n_errors long, error string, run string"


def _stream(spark: SparkSession, source_dir: str, schema: T.StructType, max_files_per_trigger: int | None) -> DataFrame:
    # the age limit counts back from the newest file seen; shards may come late
    reader = spark.readStream.schema(schema).option("maxFileAge", NO_AGE_LIMIT)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(source_dir)


def _batches(query) -> int:
    """Micro-batches with rows that the ended query ran, from its progress."""
    ids = [p["batchId"] for p in query.recentProgress if p["numInputRows"]]
    # the oldest progress is dropped in a long run; ids count on without gaps
    return max(ids) - min(ids) + 1 if ids else 0


def ingest_new_shards(spark: SparkSession, source_dir: str, schema: T.StructType, sink_dir: str, checkpoint: str,
                      transform: Callable[[DataFrame], DataFrame] | None = None,
                      max_files_per_trigger: int | None = None) -> int:
    """Run one incremental pass; returns the number of micro-batches executed."""
    stream = _stream(spark, source_dir, schema, max_files_per_trigger)
    if transform is not None:
        stream = transform(stream)
    q = (stream.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return _batches(q)


def _file_path() -> Column:
    """The path of a row's file, as a reader takes it (``_metadata`` has it as a URI)."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


#: rows with their shard's path and the attempt's number (from 1) -> rows with ``error`` (NULL: good)
Transform = Callable[[DataFrame, int], DataFrame]


def _attempt(rows: DataFrame, attempt: int, run: str, sink_dir: str, log_dir: str, transform: Transform) -> None:
    done = written(transform(rows, attempt), "attempt")
    per = done.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("n_errors"), F.min("error").alias("error"))
    log = written(per.select("shard", F.lit(attempt).alias("attempt"), F.when(F.col("n_errors") > 0, "failed").otherwise("done").alias("status"),
                             F.when(F.col("n_errors") > 0, 0).otherwise(F.col("n")).cast("long").alias("n_rows"), "n_errors", "error"), "attempt-log")
    good = done.join(log.where("status = 'done'").select("shard"), "shard", "left_semi").drop("error")
    good.write.mode("overwrite").parquet(f"{sink_dir}/run={run}")
    log.write.mode("overwrite").parquet(f"{log_dir}/run={run}")  # last: it commits the attempt


def ingest_logged(spark: SparkSession, source_dir: str, schema: T.StructType, sink_dir: str, log_dir: str, checkpoint: str,
                  transform: Transform, max_files_per_trigger: int | None = None) -> int:
    """One pass over the new shard files; returns the number of micro-batches.

    ``transform`` gets the rows with ``shard`` (the file's path) and adds ``error``; a shard with any
    error is logged as failed and none of its rows are written.  A file without rows leaves no entry."""
    stream = _stream(spark, source_dir, schema, max_files_per_trigger).withColumn("shard", _file_path())

    def batch(rows: DataFrame, batch_id: int) -> None:
        _attempt(rows, 1, f"batch-{batch_id}", sink_dir, log_dir, transform)

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return _batches(q)


def read_log(spark: SparkSession, log_dir: str) -> DataFrame:
    """All attempts: shard, attempt, status, n_rows, n_errors, error, run."""
    return spark.read.schema(LOG_SCHEMA).option("basePath", log_dir).parquet(f"{log_dir}/run=*")


def read_ingested(spark: SparkSession, sink_dir: str, log_dir: str) -> DataFrame:
    """Rows of all attempts that the log has."""
    rows = spark.read.option("basePath", sink_dir).parquet(f"{sink_dir}/run=*")
    return rows.join(read_log(spark, log_dir).select("run").distinct(), "run", "left_semi")


def retry_failed(spark: SparkSession, schema: T.StructType, sink_dir: str, log_dir: str, transform: Transform) -> int:
    """Reads the shards whose last attempt failed once more; returns how many.
    Their paths are collected (one per failed shard)."""
    last = read_log(spark, log_dir).groupBy("shard").agg(F.max("attempt").alias("attempt"), F.max_by("status", "attempt").alias("status"))
    failed = last.where("status = 'failed'").groupBy("attempt").agg(F.collect_list("shard").alias("shards")).orderBy("attempt").collect()
    for r in failed:
        rows = spark.read.schema(schema).parquet(*r["shards"]).withColumn("shard", _file_path())
        _attempt(rows, r["attempt"] + 1, f"retry-{r['attempt'] + 1}-{_name(r['shards'])}", sink_dir, log_dir, transform)
    return sum(len(r["shards"]) for r in failed)


def _name(shards: list[str]) -> str:
    """The same name for the same shards, so a repeated retry replaces itself."""
    import hashlib
    return hashlib.sha256("\n".join(sorted(shards)).encode()).hexdigest()[:16]
