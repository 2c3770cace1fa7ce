"""Training-row operators over DataFrames.

Thin compositions of the array expressions in ``voxloom.functions.arrays``;
every array is produced once in a projection and reused by name afterwards, so
it is never recomputed for a second output column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom import vocab as V
from voxloom.functions import arrays as A


def plain_rows(df: DataFrame, keys, text_ids: str = "text_ids", codes: str = "codes_list",
               max_len: int | None = V.MAX_LEN_PLAIN) -> DataFrame:
    """Q4 -> Q7 -> Q8 -> Q9: ``input_ids, attention_mask, labels`` (labels = ids)."""
    ids = A.assemble_plain(text_ids, codes)
    if max_len:
        ids = A.truncate(ids, max_len)
    out = df.select(*keys, ids.alias("input_ids"))
    return out.select(*keys, "input_ids", A.attention_mask("input_ids").alias("attention_mask"),
                      F.col("input_ids").alias("labels"))


def speaker_rows(df: DataFrame, keys, text_ids: str = "text_ids", codes: str = "codes_list",
                 placeholder: int = V.PLACEHOLDER, dedupe: bool = True) -> DataFrame:
    """Q3 -> Q5 -> P11: speaker rows plus ``placeholder_ok`` (exactly one placeholder)."""
    audio = A.dedupe_frames(codes) if dedupe else F.col(codes)
    out = df.select(*keys, A.assemble_speaker(text_ids, audio, placeholder).alias("input_ids"))
    return out.withColumn("placeholder_ok", A.count_value("input_ids", placeholder) == 1)


def speaker_labels(df: DataFrame, ids_col: str = "input_ids", max_len: int | None = None) -> DataFrame:
    """Q10 (+ Q7): labels with every placeholder position set to -100."""
    labels = A.mask_labels(ids_col)
    return df.withColumn("labels", A.truncate(labels, max_len) if max_len else labels)


def collate(df: DataFrame, max_len: int = V.MAX_LEN_COLLATE, ids_col: str = "input_ids",
            mask_col: str = "attention_mask") -> DataFrame:
    """Q12: the batch collator's projection — ids and mask cut to ``max_len``,
    labels = ids.  Rows stay ragged (no padding), so any batch size works."""
    return (df.withColumn(ids_col, A.truncate(ids_col, max_len))
            .withColumn(mask_col, A.truncate(mask_col, max_len))
            .withColumn("labels", F.col(ids_col)))


def truncation_stats(df: DataFrame, len_col: str, max_len: int, group_cols=()) -> DataFrame:
    """A4: rows truncated and tokens removed at ``max_len`` (partial aggregates
    per task, so no group is ever collected)."""
    n = F.col(len_col)
    return df.groupBy(*group_cols).agg(
        F.count("*").cast("long").alias("n_rows"), F.count_if(n > max_len).cast("long").alias("n_truncated"),
        F.sum(F.greatest(n - max_len, F.lit(0))).cast("long").alias("tokens_removed"),
        F.max(n).cast("long").alias("max_len"))
