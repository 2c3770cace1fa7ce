"""Ingest bookkeeping: quarantine, skip-done, pairing, run-log counts
(P7, S10, J1, A6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def tag_errors(df: DataFrame, error: Column, error_col: str = "error") -> DataFrame:
    """Attach the row's error text (NULL = good row); nothing is dropped."""
    return df.withColumn(error_col, error)


def split_quarantine(df: DataFrame, error: Column, error_col: str = "error") -> tuple[DataFrame, DataFrame]:
    """P7 as two frames (good rows, quarantined rows with their error).

    Each frame re-reads its input; to produce both in one pass, write the
    tagged frame with ``write_with_quarantine``."""
    tagged = tag_errors(df, error, error_col)
    return tagged.filter(F.col(error_col).isNull()).drop(error_col), tagged.filter(F.col(error_col).isNotNull())


def write_with_quarantine(df: DataFrame, error: Column, path: str, error_col: str = "error",
                          mode: str = "overwrite", counts: dict[str, Column] | None = None) -> dict[str, int]:
    """P7 sink: one pass writes good rows under ``quarantined=false`` and bad rows
    (with their error) under ``quarantined=true``, and returns what that pass
    observed: ``good``, ``quarantined``, and ``counts`` (aggregates over the tagged rows)."""
    tagged = tag_errors(df, error, error_col).withColumn("quarantined", F.col(error_col).isNotNull())
    seen = Observation()
    aggs = {"good": F.count_if(~F.col("quarantined")), "quarantined": F.count_if(F.col("quarantined"))} | (counts or {})
    tagged.observe(seen, *(c.alias(n) for n, c in aggs.items())).write.mode(mode).partitionBy("quarantined").parquet(path)
    return seen.get


def skip_done(todo: DataFrame, done: DataFrame, key: str = "stem") -> DataFrame:
    """Keep only work whose output does not exist yet (anti join on the key)."""
    return todo.join(done.select(key), key, "left_anti")


def pair_by_stem(audio: DataFrame, text: DataFrame, key: str = "stem") -> tuple[DataFrame, DataFrame, DataFrame]:
    """audio/transcript pairs by stem, plus the unmatched stems of each side."""
    return (audio.join(text, key, "inner"), audio.join(text, key, "left_anti"), text.join(audio, key, "left_anti"))


def status_counts(log: DataFrame, status_col: str = "status", error_col: str | None = None) -> DataFrame:
    """Rows per status (and the first error text in shard order, if any)."""
    aggs = [F.count("*").alias("n")]
    if error_col:
        aggs.append(F.min_by(error_col, "shard").alias("first_error"))
    return log.groupBy(status_col).agg(*aggs)
