"""Waveform operators over tables of samples.

Array form: one row per file with ``array<double>`` samples (what a decoded
file is).  Chunked form: ``(file, [channel,] chunk, samples)`` with a fixed number
of samples per chunk, which runs at corpus scale: a long file is many rows, and
what needs a neighbouring sample takes it from a halo.  Long form: one row per
sample ``(file, [channel,] t, value)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom import vocab as V
from voxloom.functions.arrays import let

CHUNK = 65536            # samples of a chunk


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mono_mix(channels) -> Column:
    """Mean over channels when there is more than one; ``channels`` is
    ``array<array<double>>`` of equal-length channels."""
    def body(ch):
        n = F.size(ch)
        mixed = F.transform(F.get(ch, 0), lambda x, i: F.aggregate(
            ch, F.lit(0.0).cast("double"), lambda acc, c: acc + F.get(c, i).cast("double")) / n)
        return F.when(n > 1, mixed).otherwise(F.transform(F.get(ch, 0), lambda x: x.cast("double")))
    return let(channels, body)


def mono_mix_long(samples: DataFrame, file_col: str = "file", t_col: str = "t", value_col: str = "value") -> DataFrame:
    """R1 long form: ``(file, channel, t, value) -> (file, t, value)`` mean over channels."""
    return samples.groupBy(file_col, t_col).agg(F.avg(value_col).alias(value_col))


def resample_linear(samples, sr, target_sr: int = V.TARGET_SR) -> Column:
    """R2: linear resampling (half-pixel centres, edge clamp) of an
    ``array<double>``; ``floor(T * target/sr)`` outputs; unchanged when
    ``sr == target_sr``."""
    sr_c = _c(sr) if not isinstance(sr, int) else F.lit(sr)

    def body(v):
        t = F.size(v)
        s = F.lit(float(target_sr)) / sr_c.cast("double")
        n_out = F.floor(t * s).cast("int")

        def at(i):
            x = F.greatest((i.cast("double") + 0.5) / s - 0.5, F.lit(0.0))
            x0 = F.floor(x).cast("int")
            x1 = F.least(x0 + 1, t - 1)
            w = x - x0
            return F.get(v, x0) * (1 - w) + F.get(v, x1) * w

        out = F.when(n_out <= 0, F.array().cast("array<double>")).otherwise(
            F.transform(F.sequence(F.lit(0), n_out - 1), at))
        return F.when(sr_c == target_sr, v).otherwise(out)

    return let(_c(samples).cast("array<double>"), body)


def chunk_samples(samples: DataFrame, file_col: str = "file", t_col: str = "t", value_col: str = "value",
                  chunk: int = CHUNK, by: tuple[str, ...] = ()) -> DataFrame:
    """Long form to chunked form: ``(file, *by, chunk, samples)`` where chunk
    ``c`` holds samples ``c * chunk`` up to ``(c + 1) * chunk`` of a file.  The
    samples of a file are numbered from 0 without gaps; ``by`` may name a channel."""
    at = F.struct(F.col(t_col).alias("t"), F.col(value_col).cast("double").alias("v"))
    number = F.floor(F.col(t_col) / F.lit(chunk)).cast("long")
    c = samples.groupBy(file_col, *by, number.alias("chunk")).agg(F.sort_array(F.collect_list(at)).alias("_s"))
    return c.select(file_col, *by, "chunk", F.transform("_s", lambda x: x["v"]).alias("samples"))


def explode_chunks(chunks: DataFrame, file_col: str = "file", t_col: str = "t", value_col: str = "value",
                   first_col: str = "first_t") -> DataFrame:
    """Chunked form to long form; ``first_col`` is the position of a chunk's first sample."""
    c = chunks.select(file_col, F.col(first_col).alias("_first"), F.posexplode("samples").alias("_i", value_col))
    return c.select(file_col, (F.col("_first") + F.col("_i")).alias(t_col), value_col)


def with_halo(chunks: DataFrame, file_col: str = "file", by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``halo``: the first sample of a file's next chunk, NULL at the end.
    One narrow row per chunk is joined, never a sample."""
    keys = [file_col, *by, "chunk"]
    following = chunks.select(file_col, *by, (F.col("chunk") - 1).alias("chunk"), F.get("samples", F.lit(0)).alias("halo"))
    return chunks.join(following, keys, "left")


def mono_mix_chunks(chunks: DataFrame, file_col: str = "file", channel_col: str = "channel") -> DataFrame:
    """R1 on chunks: ``(file, channel, chunk, samples) -> (file, chunk, samples)``, the mean over channels."""
    c = chunks.groupBy(file_col, "chunk").agg(
        F.sort_array(F.collect_list(F.struct(channel_col, "samples"))).alias("_c"))
    return c.select(file_col, "chunk", F.transform("_c", lambda x: x["samples"]).alias("_c")).select(
        file_col, "chunk", mono_mix(F.col("_c")).alias("samples"))


def resample_chunks(chunks: DataFrame, rates: DataFrame, target_sr: int = V.TARGET_SR, file_col: str = "file",
                    chunk: int = CHUNK) -> DataFrame:
    """R2 on chunks: ``(file, chunk, samples)`` to ``(file, chunk, first_t,
    samples)`` with the outputs whose left source sample lies in the chunk.

    A chunk needs its own samples and one of the next chunk; exchanges carry
    chunks and one narrow row per chunk and file.  ``rates`` holds ``(file, sr)``;
    a file without a rate has no output.  A chunk in which no output starts has no row.
    """
    totals = chunks.groupBy(file_col).agg(F.sum(F.size("samples").cast("long")).alias("_n")).join(
        rates.select(file_col, "sr"), file_col)
    d = with_halo(chunks, file_col).join(totals, file_col)
    d = d.withColumn("_s", F.lit(float(target_sr)) / F.col("sr").cast("double"))
    d = d.withColumn("_a", F.col("chunk") * chunk).withColumn("_len", F.size("samples"))
    same = F.col("sr") == target_sr
    n_out = F.floor(F.col("_n") * F.col("_s")).cast("long")
    # positions that may start in the chunk, one more at each end against rounding
    low = F.greatest(F.floor((F.col("_a") + 0.5) * F.col("_s") - 0.5).cast("long") - 1, F.lit(0))
    low = F.when(F.col("_a") == 0, F.lit(0)).otherwise(low).cast("long")
    high = F.least(F.ceil((F.col("_a") + F.col("_len") + 0.5) * F.col("_s")).cast("long") + 1, n_out - 1)
    d = d.withColumn("_low", low).withColumn("_high", high)

    def source(t: Column) -> Column:
        return F.greatest((t.cast("double") + 0.5) / F.col("_s") - 0.5, F.lit(0.0))

    def mine(t: Column) -> Column:
        left = F.floor(source(t)).cast("long") - F.col("_a")
        return (left >= 0) & (left < F.col("_len"))

    at = F.filter(F.sequence("_low", "_high"), mine)
    d = d.withColumn("_at", F.when(same | (F.col("_high") < F.col("_low")), F.array().cast("array<bigint>")).otherwise(at))

    def values(v: Column) -> Column:
        def one(t: Column) -> Column:
            x = source(t)
            x0 = F.floor(x)
            left, w = (x0 - F.col("_a")).cast("int"), x - x0
            return F.get(v, left) * (1 - w) + F.get(v, left + 1) * w
        return F.transform("_at", one)

    # the last sample of a file is its own right neighbour
    padded = F.concat("samples", F.array(F.when(F.col("_a") + F.col("_len") < F.col("_n"), F.col("halo"))
                                         .otherwise(F.element_at("samples", -1))))
    first = F.when(same, F.col("_a")).otherwise(F.get("_at", F.lit(0)))
    out = F.when(same, F.col("samples")).otherwise(let(padded, values))
    return d.select(file_col, "chunk", first.alias("first_t"), out.alias("samples")).filter(F.col("first_t").isNotNull())


def resample_linear_long(samples: DataFrame, rates: DataFrame, target_sr: int = V.TARGET_SR,
                         file_col: str = "file", t_col: str = "t", value_col: str = "value", chunk: int = CHUNK) -> DataFrame:
    """R2 long form.  ``rates`` holds ``(file, sr)``.  Output ``(file, t, value)``.
    The samples are brought together in chunks once and resampled there."""
    chunks = chunk_samples(samples, file_col, t_col, value_col, chunk)
    return explode_chunks(resample_chunks(chunks, rates, target_sr, file_col, chunk), file_col, t_col, value_col)
