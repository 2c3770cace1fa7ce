"""Sinks (S7-S9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["write_sharded", "write_table", "write_transcripts", "write_transcript_files"]


def write_sharded(df: DataFrame, path: str, shard_col: str = "shard", mode: str = "overwrite", files_per_shard: int = 1) -> None:
    """One directory per shard; re-running a shard replaces only that shard
    (dynamic partition overwrite), so a retried job is idempotent.  A shard's rows are
    brought together in at most ``files_per_shard`` files."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_shard)) if files_per_shard > 1 else F.lit(0)
    (df.repartition(shard_col, salt).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(shard_col).parquet(path))


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Unsharded dataset."""
    df.write.mode(mode).parquet(path)


def write_transcripts(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Transcript table keyed by stem ``(stem, text)``."""
    df.select("stem", "text").write.mode(mode).parquet(path)


def write_transcript_files(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S9 as one text file per stem, ``<path>/stem=<escaped stem>/``, for tools that
    read files; ``readers.read_transcript_files`` reads it.  Dynamic overwrite: a stem
    written again replaces only itself.  Of several texts of a stem the
    smallest is written; NULL and empty stems are left out, a NULL text is empty.
    Any text comes back whole, line breaks and carriage returns included."""
    one = df.where(F.length("stem") > 0).groupBy("stem").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    (one.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").partitionBy("stem").text(path))
