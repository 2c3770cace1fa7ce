import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom import vocab as V
from voxloom.functions import arrays as A
from voxloom.functions import text as TX
from tests import oracles as O

INTS = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("a", T.ArrayType(T.IntegerType()))])


def ints_df(spark, arrays):
    return spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], INTS)


def test_utf8_bytes_edge_texts(spark):
    texts = ["", "a", "hé", "😀 emoji", "　 wide space", "x" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(A.byte_tokens("text")).collect()]
    assert got == [[V.START_OF_TEXT] + list(t.encode("utf-8")) for t in texts]
    # every id of the byte encoder stays below the special ids
    assert all(max(g) <= V.START_OF_TEXT for g in got)


DEDUPE_CASES = [
    [], [5], list(range(6)), list(range(7)), list(range(8)), list(range(13)),
    [1, 2, 3, 4, 5, 6, 7] * 3,                      # a run of equal frames
    [1] * 7 + [2] * 7 + [2] * 7 + [2] * 3,          # run at the end, partial last frame
    [9] * 7 + [9] * 7 + [3] * 7,                    # run at the start
    [4] * 7 + [4],                                  # full frame equal to partial frame's slot 0
]


def test_dedupe_matches_python(spark):
    df = ints_df(spark, DEDUPE_CASES)
    got = [r[0] for r in df.orderBy("id").select(A.dedupe_frames("a")).collect()]
    assert got == [O.dedupe_frames(c) for c in DEDUPE_CASES]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=0, max_size=40), min_size=1, max_size=8))
def test_dedupe_property(spark, arrays):
    df = ints_df(spark, arrays)
    got = [r[0] for r in df.orderBy("id").select(A.dedupe_frames("a")).collect()]
    assert got == [O.dedupe_frames(a) for a in arrays]


def test_dedupe_idempotent_on_deduped_runs(spark):
    df = ints_df(spark, DEDUPE_CASES)
    once = df.select("id", A.dedupe_frames("a").alias("a"))
    twice = once.select("id", A.dedupe_frames("a").alias("a"))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 4095), min_size=0, max_size=10))
def test_flatten_unflatten_roundtrip(spark, c0):
    n = len(c0)
    c1 = [(x * 3 + 1) % 4096 for x in range(2 * n)]
    c2 = [(x * 7 + 2) % 4096 for x in range(4 * n)]
    df = spark.createDataFrame([(c0, c1, c2)], "c0 array<int>, c1 array<int>, c2 array<int>")
    flat = df.select(A.flatten_frames("c0", "c1", "c2").alias("f"))
    r = flat.select("f", A.unflatten_frames("f").alias("u"), A.frame_shape_ok("f").alias("ok")).collect()[0]
    assert len(r["f"]) == 7 * n and r["ok"]
    assert (r["u"]["c0"], r["u"]["c1"], r["u"]["c2"]) == (c0, c1, c2)
    # frame i slot order: c0, c1[2i], c2[4i], c2[4i+1], c1[2i+1], c2[4i+2], c2[4i+3]
    if n:
        off, cb = V.AUDIO_OFFSET, V.CODEBOOK_SIZE
        assert r["f"][:7] == [c0[0] + off, c1[0] + off + cb, c2[0] + off + 2 * cb, c2[1] + off + 3 * cb,
                              c1[1] + off + 4 * cb, c2[2] + off + 5 * cb, c2[3] + off + 6 * cb]


def test_codes_in_range(spark):
    df = spark.createDataFrame([([0, 4095],), ([-1],), ([4096],), ([],)], "c array<int>")
    assert [r[0] for r in df.select(A.codes_in_range("c")).collect()] == [True, False, False, True]


SPAN_CASES = [
    [1, 2, V.START_OF_AUDIO] + list(range(7)) + [V.END_OF_AUDIO],   # marker and end
    list(range(14)),                                                 # no marker: keep all
    [1, V.START_OF_AUDIO],                                           # marker last: empty
    [],                                                              # empty row
    [V.START_OF_AUDIO, 5, V.START_OF_AUDIO, 6, V.END_OF_AUDIO],      # two markers: first wins
    [V.START_OF_AUDIO, V.END_OF_AUDIO, V.END_OF_AUDIO],              # only one end marker dropped
]


def test_audio_span(spark):
    df = ints_df(spark, SPAN_CASES)
    got = [r[0] for r in df.orderBy("id").select(A.audio_span("a")).collect()]
    assert got == [O.audio_span(c) for c in SPAN_CASES]


def test_prompt_shapes(spark):
    df = spark.createDataFrame([([V.START_OF_TEXT, 1, 2], [10, 11])], "t array<int>, a array<int>")
    r = df.select(A.assemble_plain("t", "a").alias("p"), A.assemble_speaker("t", "a").alias("s"),
                  A.assemble_speaker("t", "a", V.IGNORE_LABEL).alias("s2"),
                  A.generation_prompt("t").alias("g"), A.generation_prompt("t", speaker=True).alias("gs")).collect()[0]
    assert r["p"] == [V.START_OF_HUMAN, V.START_OF_TEXT, 1, 2, V.END_OF_TEXT, V.END_OF_HUMAN, V.START_OF_GPT,
                      V.START_OF_AUDIO, 10, 11, V.END_OF_AUDIO, V.END_OF_GPT]
    assert len(r["s"]) == 3 + 2 + 10 and r["s"].count(V.PLACEHOLDER) == 1
    assert r["s2"].count(V.IGNORE_LABEL) == 1 and r["s2"].count(V.PLACEHOLDER) == 0
    assert r["g"] == r["p"][:8]
    assert r["gs"]["head"] + [V.PLACEHOLDER] + r["gs"]["tail"] == r["s"][:len(r["gs"]["head"]) + 4]


def test_truncate_mask_labels(spark):
    df = ints_df(spark, [[1, V.PLACEHOLDER, 3, V.IGNORE_LABEL, 5], []])
    r = df.orderBy("id").select(A.truncate("a", 3).alias("t"), A.attention_mask("a").alias("m"),
                                A.mask_labels("a").alias("l"), A.normalise_placeholder("a").alias("n")).collect()
    assert r[0]["t"] == [1, V.PLACEHOLDER, 3] and r[0]["m"] == [1] * 5
    assert r[0]["l"] == [1, -100, 3, -100, 5] and r[0]["n"] == [1, V.PLACEHOLDER, 3, V.PLACEHOLDER, 5]
    assert r[1]["t"] == [] and r[1]["m"] == [] and r[1]["l"] == []


def test_split_and_flatten_embeddings(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],), ([],)], "e array<float>")
    got = [r[0] for r in df.select(A.split_flat("e", 3)).collect()]
    assert got == [[[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]], []]
    nested = spark.createDataFrame([([[[1.0, 2.0]]],)], "e array<array<array<float>>>")
    assert nested.select(A.flatten_nested("e")).collect()[0][0] == [1.0, 2.0]


def test_py_strip_matches_python(spark):
    texts = ["  a b  ", "\t\n x \r\n", "　 y ", "\x1c\x1fz\x85", "   ", "", "no-space"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(TX.py_strip("t")).collect()] == [t.strip() for t in texts]


def test_transcript_from_words(spark):
    df = spark.createDataFrame([([("word", "hi"), ("spacing", " "), ("word", "there")],), ([],)],
                               "w array<struct<type:string,text:string>>")
    assert [r[0] for r in df.select(TX.transcript_from_words("w")).collect()] == ["hi there", ""]


@pytest.mark.parametrize("url,vid", [
    ("https://youtu.be/abc123?t=1", "abc123"),
    ("https://www.youtube.com/watch?v=XyZ&feature=share", "XyZ"),
    ("https://youtube.com/shorts/sh0rt", "sh0rt"),
    ("https://m.youtube.com/watch?app=desktop&v=q9", "q9"),
    ("https://example.com/video/1", None),
])
def test_video_id(spark, url, vid):
    df = spark.createDataFrame([(url,)], "url string")
    r = df.select(TX.video_id("url").alias("v"), TX.output_path("out", TX.video_id("url")).alias("p")).collect()[0]
    assert r["v"] == vid
    assert r["p"] == (f"out/{vid}.mp3" if vid else None)


def test_shard_path(spark):
    df = spark.createDataFrame([(-3,), (0,), (1,), (42,), (1139,)], "i int")
    got = [r[0] for r in df.select(TX.shard_path("i")).collect()]
    assert got == ["EN/EN-B000000.tar", "EN/EN-B000000.tar", "EN/EN-B000001.tar", "EN/EN-B000042.tar",
                   "EN/EN-B001139.tar"]


def test_truncate_keep_tail_markers(spark):
    df = ints_df(spark, [list(range(10)) + [V.END_OF_AUDIO, V.END_OF_GPT], [1, 2, 3]])
    got = [r[0] for r in df.orderBy("id").select(A.truncate("a", 6, keep_tail=2)).collect()]
    assert got == [[0, 1, 2, 3, V.END_OF_AUDIO, V.END_OF_GPT], [1, 2, 3]]


def test_unflatten_partial_last_frame(spark):
    off, cb = V.AUDIO_OFFSET, V.CODEBOOK_SIZE
    raw = list(range(9))                               # one whole frame + two codes
    codes = [x + off + (i % 7) * cb for i, x in enumerate(raw)]
    df = ints_df(spark, [codes, []])
    got = [r[0] for r in df.orderBy("id").select(A.unflatten_frames("a")).collect()]
    assert (got[0]["c0"], got[0]["c1"], got[0]["c2"]) == ([0, 7], [1, 4, 8], [2, 3, 5, 6])
    assert (got[1]["c0"], got[1]["c1"], got[1]["c2"]) == ([], [], [])
