"""Speaker-segment analytics.

Segments are long-form rows ``(file, start, end, speaker[, seg_order])`` with
times in seconds.  Durations are summed in double; before the arg-max they are
rounded to microseconds so the winner does not depend on the (partition
dependent) order of floating-point additions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators.sampling import rank_in_group
from voxloom.operators.waveform import CHUNK

OUT_CHUNK = 65536        # characters or samples of a chunk of joined output


def ms_index(seconds) -> Column:
    """Seconds -> millisecond index, truncated toward zero."""
    c = F.col(seconds) if isinstance(seconds, str) else seconds
    return (c * 1000).cast("int")


def speaker_time(segments: DataFrame, file_col: str = "file", speaker_col: str = "speaker",
                 order_col: str = "seg_order") -> DataFrame:
    """A1: total speaking time per ``(file, speaker)``; overlaps count twice.
    ``first_seen`` is the speaker's first segment in segment order."""
    return segments.groupBy(file_col, speaker_col).agg(
        F.sum(F.col("end") - F.col("start")).alias("duration"),
        F.count("*").alias("n_segments"),
        F.min(order_col).alias("first_seen"))


def main_speaker(segments: DataFrame, file_col: str = "file", speaker_col: str = "speaker",
                 order_col: str = "seg_order") -> DataFrame:
    """A2: the speaker with the largest total time per file; ties go to the
    speaker seen first.  Files without segments have no row (D15)."""
    t = speaker_time(segments, file_col, speaker_col, order_col)
    rank_key = F.struct(F.round("duration", 6).alias("d"), (-F.col("first_seen")).alias("f"))
    return t.groupBy(file_col).agg(
        F.max_by(speaker_col, rank_key).alias("main_speaker"),
        F.max_by("duration", rank_key).alias("main_duration"))


def main_speaker_segments(segments: DataFrame, main: DataFrame | None = None, file_col: str = "file",
                          speaker_col: str = "speaker", order_col: str = "seg_order") -> DataFrame:
    """Only the segments of each file's main speaker (semi join)."""
    if main is None:
        main = main_speaker(segments, file_col, speaker_col, order_col)
    keys = main.select(file_col, F.col("main_speaker").alias(speaker_col))
    return segments.join(keys, [file_col, speaker_col], "left_semi")


def concat_segments(segments: DataFrame, payload_col: str, file_col: str = "file", sep: str = "",
                    order_col: str = "seg_order") -> DataFrame:
    """O5 + R3: a file's segments sorted by start (ties by ``order_col``, as a
    stable sort leaves them) and their payloads joined in that order.  String payloads are joined with ``sep``; array payloads are flattened.
    One output row per file (its audio); a file with no part has no row."""
    parts = F.sort_array(F.collect_list(F.struct("start", order_col, F.col(payload_col).alias("p"))))
    agg = segments.groupBy(file_col).agg(parts.alias("_parts"), F.count("*").alias("n_parts"))
    dt = segments.schema[payload_col].dataType.simpleString()
    if dt.startswith("array"):
        joined = F.flatten(F.transform("_parts", lambda x: x["p"]))
    else:
        joined = F.array_join(F.transform("_parts", lambda x: x["p"]), sep)
    return agg.select(file_col, "n_parts", joined.alias(payload_col))


def segment_offsets(segments: DataFrame, len_col: str, file_col: str = "file", order_col: str = "seg_order") -> DataFrame:
    """Long form of R3: where each part lands in the joined output
    (``out_start`` = total length of the parts that start earlier).

    A running sum per file without a window per file: ``rank_in_group`` splits
    a long file over several tasks.  ``order_col`` breaks ties between parts
    with the same start.
    """
    return rank_in_group(segments, file_col, ["start", order_col], "out_start", weight=F.col(len_col))


def assemble_chunks(parts: DataFrame, payload_col: str, start_col: str, file_col: str = "file",
                    chunk: int = OUT_CHUNK) -> DataFrame:
    """R3 at scale: parts with their place in a file's joined output
    (``start_col``) to ``(file, chunk_no, payload)``, cut at fixed output
    offsets.  Parts are cut before they are exchanged, so no row and no group
    is longer than a chunk, however long a part or a file is.  Chunk numbers
    are gapless where the parts are; empty and NULL parts add nothing."""
    is_array = parts.schema[payload_col].dataType.simpleString().startswith("array")
    p = F.col(payload_col)
    size = (F.size(p) if is_array else F.length(p)).cast("long")
    at = F.col(start_col).cast("long")
    cut = F.slice if is_array else F.substring
    d = parts.filter(size > 0).select(file_col, at.alias("_at"), size.alias("_size"), p.alias("_p"))
    d = d.withColumn("chunk_no", F.explode(F.sequence(F.expr(f"_at div {chunk}"), F.expr(f"(_at + _size - 1) div {chunk}"))))
    first = F.greatest(F.col("chunk_no") * chunk, F.col("_at"))
    last = F.least((F.col("chunk_no") + 1) * chunk, F.col("_at") + F.col("_size"))
    d = d.select(file_col, "chunk_no", first.alias("_first"),
                 cut(F.col("_p"), (first - F.col("_at") + 1).cast("int"), (last - first).cast("int")).alias("_p"))
    d = d.groupBy(file_col, "chunk_no").agg(F.sort_array(F.collect_list(F.struct("_first", "_p"))).alias("_parts"))
    pieces = F.transform("_parts", lambda x: x["_p"])
    return d.select(file_col, "chunk_no", (F.flatten(pieces) if is_array else F.array_join(pieces, "")).alias(payload_col))


def concat_chunks(segments: DataFrame, payload_col: str, file_col: str = "file", order_col: str = "seg_order",
                  chunk: int = OUT_CHUNK) -> DataFrame:
    """O5 + R3 in chunks: what ``concat_segments`` joins (without a separator),
    as rows ``(file, chunk_no, payload)`` of ``chunk`` characters or samples."""
    is_array = segments.schema[payload_col].dataType.simpleString().startswith("array")
    size = F.size(payload_col) if is_array else F.length(payload_col)
    sized = segments.select(file_col, "start", order_col, payload_col, F.coalesce(F.greatest(size, F.lit(0)), F.lit(0)).alias("_len"))
    return assemble_chunks(segment_offsets(sized, "_len", file_col, order_col), payload_col, "out_start", file_col, chunk)


def slice_samples(samples, start, end, sr: int = 1000) -> Column:
    """J2 on one file's sample array: ``[start, end)`` in seconds, cut in whole
    milliseconds first (R4).  Empty where the segment lies past the samples."""
    def index(seconds):
        at = ms_index(seconds).cast("long") * sr
        return F.greatest((at - F.pmod(at, F.lit(1000))) / 1000, F.lit(0)).cast("int")

    first, last = index(start), index(end)
    return F.slice(samples, first + 1, F.greatest(last - first, F.lit(0)))


def slice_waveform(samples: DataFrame, segments: DataFrame, file_col: str = "file", t_col: str = "t",
                   sr: int = 1000, bin_width: int = 4096) -> DataFrame:
    """J2 in long form: samples with ``start_idx <= t < end_idx`` of a segment.

    As in the reference, times are cut in whole milliseconds first
    (``ms = int(seconds * 1000)``, R4) and then turned into sample indexes
    ``ms * sr div 1000``.

    A range join on an equi key: each segment is expanded to the ``bin_width``
    sample bins it covers and joined on ``(file, bin)``, so a long file is spread
    over many keys instead of pairing all of its samples with all of its
    segments.
    """
    seg = (segments
           .withColumn("_s", F.expr(f"(cast(cast(start * 1000 as int) as long) * {int(sr)}) div 1000"))
           .withColumn("_e", F.expr(f"(cast(cast(`end` * 1000 as int) as long) * {int(sr)}) div 1000"))
           .filter(F.col("_e") > F.col("_s"))
           .withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_s") / bin_width),
                                                    F.floor((F.col("_e") - 1) / bin_width)))))
    smp = samples.withColumn("_bin", F.floor(F.col(t_col) / bin_width))
    j = smp.join(seg.drop(*[c for c in seg.columns if c in smp.columns and c not in (file_col, "_bin")]),
                 [file_col, "_bin"])
    return j.filter((F.col(t_col) >= F.col("_s")) & (F.col(t_col) < F.col("_e"))).drop("_bin")


def slice_chunks(chunks: DataFrame, segments: DataFrame, file_col: str = "file", sr: int = 1000, chunk: int = CHUNK) -> DataFrame:
    """J2 on chunked waveforms: the columns of ``segments``, its sample indexes
    ``_s`` and ``_e`` (cut in whole milliseconds first, R4), and per chunk it
    touches the part of the samples there (``samples``) with the index of the
    part's first sample (``first_t``).

    A segment is expanded to the chunks it covers and joined on ``(file,
    chunk)``: the exchange carries chunks and segments, not samples.  A segment
    outside the samples has no row.
    """
    seg = (segments
           .withColumn("_s", F.expr(f"(cast(cast(start * 1000 as int) as long) * {int(sr)}) div 1000"))
           .withColumn("_e", F.expr(f"(cast(cast(`end` * 1000 as int) as long) * {int(sr)}) div 1000"))
           .filter((F.col("_e") > F.col("_s")) & (F.col("_e") > 0))
           .withColumn("chunk", F.explode(F.sequence(F.expr(f"greatest(_s, 0L) div {chunk}"), F.expr(f"(_e - 1) div {chunk}")))))
    seg = seg.drop(*(c for c in ("samples", "first_t") if c in seg.columns))
    j = seg.join(chunks.select(file_col, "chunk", "samples"), [file_col, "chunk"])
    first = F.greatest(F.col("_s"), F.col("chunk") * chunk)
    last = F.least(F.col("_e"), F.col("chunk") * chunk + F.size("samples"))
    j = j.withColumn("first_t", first).filter(last > first)
    return j.withColumn("samples", F.slice("samples", (first - F.col("chunk") * chunk + 1).cast("int"), (last - first).cast("int")))
