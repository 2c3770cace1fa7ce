"""Placeholder / embedding alignment on packed rows.

A packed row holds k placeholders and ``k * dim`` embedding floats; the k-th
placeholder takes the k-th vector.  Alignment is done per row with array
functions (bounded by the row length), output in long form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom import vocab as V
from voxloom.functions.arrays import count_value, normalise_placeholder


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def placeholders_match(ids, emb, dim: int) -> Column:
    """Placeholders in the row times ``dim`` equal the embedding floats."""
    return count_value(ids, V.PLACEHOLDER) * dim == F.size(_c(emb))


def placeholder_positions(ids) -> Column:
    """0-based positions of the placeholders of a row, in order."""
    return F.filter(F.transform(_c(ids), lambda x, i: F.when(x == V.PLACEHOLDER, i).otherwise(-1)),
                    lambda p: p >= 0)


def align_placeholders(df: DataFrame, keys, ids_col: str = "input_ids", emb_col: str = "speaker_embeddings",
                       dim: int = V.SPEAKER_DIM, normalise: bool = True) -> DataFrame:
    """J4 (slice form): one row per placeholder ``(keys..., k, pos, vector)``.

    Rows failing P12 have no slots here; ``misaligned_rows`` reports them.
    """
    ids = normalise_placeholder(ids_col) if normalise else F.col(ids_col)
    base = df.select(*keys, placeholder_positions(ids).alias("_pos"), F.col(emb_col).alias("_emb"))
    # no Filter node: a pushed-down filter would recompute the positions
    ok = F.size("_pos") * dim == F.size("_emb")
    return (base.select(*keys, "_emb", F.posexplode(F.when(ok, F.col("_pos"))).alias("k", "pos"))
            .select(*keys, "k", "pos", F.slice("_emb", F.col("k") * dim + 1, dim).alias("vector")))


def misaligned_rows(df: DataFrame, keys, ids_col: str = "input_ids", emb_col: str = "speaker_embeddings",
                    dim: int = V.SPEAKER_DIM) -> DataFrame:
    """P12 rejects: packed rows whose placeholders and vectors differ in number,
    or hold a part of a vector, with both counts (for quarantine)."""
    n = count_value(normalise_placeholder(ids_col), V.PLACEHOLDER)
    out = df.select(*keys, n.alias("n_placeholders"), F.coalesce(F.size(emb_col), F.lit(0)).alias("n_floats"))
    return out.where(F.coalesce(F.col("n_placeholders") * dim != F.col("n_floats"), F.lit(True)))


def placeholder_ordinals_long(df: DataFrame, keys, ids_col: str = "input_ids") -> DataFrame:
    """W2 in long form: ``cumsum(mask) - 1`` at every placeholder position.

    At a placeholder, the running count of placeholders equals its rank among
    the placeholders: the index that ``posexplode`` gives, without a shuffle."""
    return df.select(*keys, F.posexplode(placeholder_positions(normalise_placeholder(ids_col))).alias("k", "pos"))


def fill_placeholders(packed: DataFrame, keys, weights, ids_col: str = "input_ids",
                      emb_col: str = "speaker_embeddings", dim: int = V.SPEAKER_DIM) -> DataFrame:
    """M5 in one pass: J4 slots of each packed row, their vectors projected by
    ``weights`` (M4, per Arrow batch), output ``(keys..., pos, projection)``."""
    from voxloom.operators.inference import project_embeddings
    slots = align_placeholders(packed, keys, ids_col, emb_col, dim)
    return project_embeddings(slots, "vector", weights).select(*keys, "pos", "projection")


def fill_from_projected(slots: DataFrame, projected: DataFrame, keys) -> DataFrame:
    """M5 when the projections come from elsewhere: ``slots (keys..., k, pos)``
    joined with ``projected (keys..., k, projection)``."""
    return slots.join(projected, [*keys, "k"]).select(*keys, "pos", "projection")
