import numpy as np
from pyspark.sql import functions as F

from voxloom.operators import segments as SEG
from voxloom.operators import waveform as WV
from tests import oracles as O

SEG_SCHEMA = "file string, speaker string, seg_order int, start double, end double, text string"


def test_main_speaker_tie_goes_to_first_seen(spark):
    segs = spark.createDataFrame([
        ("f1", "B", 0, 0.0, 1.5, "b1"), ("f1", "A", 1, 1.5, 2.0, "a1"), ("f1", "A", 2, 2.0, 3.0, "a2"),
        ("f2", "X", 0, 0.0, 1.0, "x"), ("f2", "Y", 1, 0.5, 3.0, "y"),        # overlap counts twice
    ], SEG_SCHEMA)
    m = {r["file"]: r["main_speaker"] for r in SEG.main_speaker(segs).collect()}
    assert m == {"f1": "B", "f2": "Y"}     # f1: A and B both 1.5 s, B seen first


def test_file_without_segments_has_no_main_speaker(spark):
    segs = spark.createDataFrame([("f1", "A", 0, 0.0, 1.0, "a")], SEG_SCHEMA)
    files = spark.createDataFrame([("f1",), ("f9",)], "file string")
    missing = files.join(SEG.main_speaker(segs), "file", "left_anti").collect()
    assert [r["file"] for r in missing] == ["f9"]


def test_concat_main_speaker_in_start_order(spark):
    segs = spark.createDataFrame([
        ("f", "A", 0, 5.0, 6.0, "late"), ("f", "B", 1, 0.0, 2.0, "other"), ("f", "A", 2, 1.0, 2.0, "early"),
        ("f", "A", 3, 3.0, 4.5, "mid"),
    ], SEG_SCHEMA)
    mine = SEG.main_speaker_segments(segs)
    r = SEG.concat_segments(mine, "text", "file", sep="|").collect()[0]
    assert r["n_parts"] == 3 and r["text"] == "early|mid|late"


def test_concat_ties_keep_segment_order(spark):
    segs = spark.createDataFrame([("f", "A", 0, 1.0, 3.0, "zz"), ("f", "A", 1, 1.0, 2.0, "aa")], SEG_SCHEMA)
    assert SEG.concat_segments(segs, "text", "file").first()["text"] == "zzaa"


def test_ms_index_truncates_toward_zero(spark):
    df = spark.createDataFrame([(1.9999,), (-0.0026,), (0.0,), (2.5,)], "x double")
    assert [r[0] for r in df.select(SEG.ms_index("x")).collect()] == [1999, -2, 0, 2500]


def test_slice_waveform_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    samples = [(f, t, float(rng.normal())) for f in ("a", "b") for t in range(300)]
    segs = [("a", 0, 0.010, 0.050), ("a", 1, 0.040, 0.299), ("b", 2, -0.005, 0.003), ("b", 3, 0.1, 0.1),
            ("b", 4, 0.2995, 0.5), ("a", 5, 0.0, 0.3)]
    sdf = spark.createDataFrame(samples, "file string, t long, value double")
    gdf = spark.createDataFrame(segs, "file string, seg int, start double, end double")
    got = SEG.slice_waveform(sdf, gdf, "file", "t", sr=1000, bin_width=16).groupBy("seg").agg(
        F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).collect()
    got = {r["seg"]: (r["n"], r["lo"], r["hi"]) for r in got}
    expect = {}
    for f, seg, s, e in segs:
        lo, hi = int(s * 1000), int(e * 1000)
        ts = [t for (ff, t, _) in samples if ff == f and lo <= t < hi]
        if ts:
            expect[seg] = (len(ts), min(ts), max(ts))
    assert got == expect


def test_resample_array_form_matches_python(spark):
    rng = np.random.default_rng(5)
    waves = [(1, 16000, rng.normal(size=50).tolist()), (2, 22050, rng.normal(size=33).tolist()),
             (3, 24000, [1.0, 2.0]), (4, 8000, [0.5]), (5, 16000, [])]
    df = spark.createDataFrame(waves, "id int, sr int, v array<double>")
    got = {r["id"]: r["o"] for r in df.select("id", WV.resample_linear("v", F.col("sr")).alias("o")).collect()}
    for i, sr, v in waves:
        assert np.allclose(got[i], O.resample_linear(v, sr), atol=1e-12), i


def test_resample_long_form_equals_array_form(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=41).tolist()
    long = spark.createDataFrame([("w", t, x) for t, x in enumerate(v)], "file string, t long, value double")
    rates = spark.createDataFrame([("w", 16000)], "file string, sr int")
    got = [r["value"] for r in WV.resample_linear_long(long, rates).orderBy("t").collect()]
    assert np.allclose(got, O.resample_linear(v, 16000), atol=1e-12)


def test_mono_mix_array_and_long(spark):
    df = spark.createDataFrame([([[1.0, 2.0, 3.0], [3.0, 2.0, 1.0]],), ([[5.0, 6.0]],)], "ch array<array<double>>")
    assert [r[0] for r in df.select(WV.mono_mix("ch")).collect()] == [[2.0, 2.0, 2.0], [5.0, 6.0]]
    long = spark.createDataFrame([("f", c, t, float(c * 10 + t)) for c in range(2) for t in range(3)],
                                 "file string, channel int, t long, value double")
    got = sorted((r["t"], r["value"]) for r in WV.mono_mix_long(long).collect())
    assert got == [(0, 5.0), (1, 6.0), (2, 7.0)]


def test_resample_long_form_chunked_positions(spark):
    v = [float((i * 37) % 11) for i in range(45)]
    long = spark.createDataFrame([("w", t, x) for t, x in enumerate(v)], "file string, t long, value double")
    rates = spark.createDataFrame([("w", 16000)], "file string, sr int")
    got = WV.resample_linear_long(long, rates, chunk=7).orderBy("t").collect()
    assert [r["t"] for r in got] == list(range(67))
    assert np.allclose([r["value"] for r in got], O.resample_linear(v, 16000), atol=1e-12)


def test_segment_offsets_running_length(spark):
    segs = spark.createDataFrame([
        (1, "A", 0, 0.0, 1.0, "abc"), (1, "A", 1, 2.0, 3.0, "de"), (1, "A", 2, 1.0, 1.5, "f"),
        (2, "B", 0, 0.5, 1.0, "gh"), (2, "B", 1, 0.5, 2.0, "ijk"),
    ], "file long, speaker string, seg_order int, start double, end double, text string")
    got = {(r["file"], r["seg_order"]): r["out_start"]
           for r in SEG.segment_offsets(segs.withColumn("n", F.length("text")), "n").collect()}
    assert got == {(1, 0): 0, (1, 2): 3, (1, 1): 4, (2, 0): 0, (2, 1): 2}


def test_dedupe_long_form_equals_array_form(spark):
    from voxloom.functions.arrays import dedupe_frames
    from voxloom.operators.frames import dedupe_frames_long
    arrays = [[1] * 7 + [1] * 7 + [2] * 3, list(range(20)), [], [5] * 7 + [6] * 7 + [5] * 7 + [5] * 7]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "k long, a array<int>")
    from voxloom.operators.frames import dedupe_frame_rows, frames_long
    want = {r["k"]: r["d"] for r in df.select("k", dedupe_frames("a").alias("d")).collect()}
    for longf in (dedupe_frames_long(df, "k", "a"), dedupe_frame_rows(frames_long(df, "k", "a"), "k")):
        got = {}
        for r in longf.collect():
            got.setdefault(r["k"], {})[r["pos"]] = r["code"]
        for k, d in want.items():
            assert [got.get(k, {})[i] for i in range(len(d))] == d and len(got.get(k, {})) == len(d)


def test_slice_waveform_cuts_whole_milliseconds(spark):
    # 16 kHz: 0.0105 s -> 10 ms -> sample 160 (not 168); 0.02 s -> 20 ms -> 320
    sdf = spark.createDataFrame([("a", t, 1.0) for t in range(400)], "file string, t long, value double")
    gdf = spark.createDataFrame([("a", 0, 0.0105, 0.02)], "file string, seg int, start double, end double")
    r = SEG.slice_waveform(sdf, gdf, "file", "t", sr=16000, bin_width=64).agg(F.min("t"), F.max("t"), F.count("*")).first()
    assert tuple(r) == (160, 319, 160)


def test_slice_samples(spark):
    df = spark.createDataFrame([([float(i) for i in range(10)], a, b) for a, b in
                                [(0.002, 0.005), (0.0019, 0.0051), (0.008, 0.5), (0.5, 0.6), (0.004, 0.002)]],
                               "v array<double>, a double, b double")
    got = [r["x"] for r in df.select(SEG.slice_samples("v", F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [[2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.0], [8.0, 9.0], [], []]


def test_resample_chunks_any_rate_and_chunk(spark):
    """Every chunk size gives the samples of the whole file, also where a chunk starts no output."""
    rng = np.random.default_rng(11)
    rates = {"a": 16000, "b": 22050, "c": 24000, "d": 8000, "e": 44100, "f": 96000, "g": 16000}
    waves = {f: rng.normal(size=n).tolist() for f, n in zip(rates, (50, 33, 20, 1, 97, 64, 0))}
    long = spark.createDataFrame([(f, t, x) for f, v in waves.items() for t, x in enumerate(v)], "file string, t long, value double")
    sr = spark.createDataFrame(list(rates.items()), "file string, sr int")
    for chunk in (1, 2, 5, 64):
        got = {}
        for r in WV.resample_linear_long(long, sr, chunk=chunk).collect():
            got.setdefault(r["file"], {})[r["t"]] = r["value"]
        for f, v in waves.items():
            want = O.resample_linear(v, rates[f])
            assert sorted(got.get(f, {})) == list(range(len(want))), (f, chunk)
            assert np.allclose([got[f][i] for i in range(len(want))] if len(want) else [], want, atol=1e-12)


def test_slice_chunks_equals_slice_waveform(spark):
    samples = spark.createDataFrame([(f, t, float(t * 3 % 17)) for f, n in (("a", 300), ("b", 5)) for t in range(n)],
                                    "file string, t long, value double")
    segs = spark.createDataFrame([("a", 0, 0.010, 0.050), ("a", 1, 0.040, 0.299), ("b", 2, -0.005, 0.003), ("b", 3, 0.1, 0.2),
                                  ("a", 4, 0.2995, 0.5), ("a", 5, -0.3, -0.1), ("a", 6, 0.05, 0.05)],
                                 "file string, seg int, start double, end double")
    want = {(r["seg"], r["t"]): r["value"] for r in SEG.slice_waveform(samples, segs).collect()}
    parts = SEG.slice_chunks(WV.chunk_samples(samples, chunk=16), segs, chunk=16).collect()
    got = {(r["seg"], r["first_t"] + i): x for r in parts for i, x in enumerate(r["samples"])}
    assert got == want and sum(len(r["samples"]) for r in parts) == len(want)
    assert max(len(r["samples"]) for r in parts) <= 16


def test_concat_chunks_joined_equal_concat_segments(spark):
    rows = [("f", "A", i, float((i * 7) % 5), 9.0, "äb" * (i % 4) + "x" * (40 if i == 3 else 0)) for i in range(12)]
    rows += [("g", "A", 0, 0.0, 1.0, ""), ("h", "A", 0, 0.0, 1.0, None), ("i", "A", 0, 0.0, 1.0, "z")]
    segs = spark.createDataFrame(rows, SEG_SCHEMA)
    whole = {r["file"]: r["text"] for r in SEG.concat_segments(segs, "text").collect()}
    for chunk in (1, 7, 1000):
        got = {}
        for r in SEG.concat_chunks(segs, "text", chunk=chunk).collect():
            got.setdefault(r["file"], {})[r["chunk_no"]] = r["text"]
        assert sorted(got) == ["f", "i"]
        for f, c in got.items():
            assert sorted(c) == list(range(len(c))) and "".join(c[i] for i in sorted(c)) == whole[f]
            assert all(len(c[i]) == chunk for i in range(len(c) - 1))
    arrays = segs.withColumn("text", F.transform(F.split("text", ""), lambda x: F.ascii(x).cast("double")))
    flat = {r["file"]: r["text"] for r in SEG.concat_segments(arrays.filter("text is not null"), "text").collect()}
    got = sorted((r["file"], r["chunk_no"], r["text"]) for r in SEG.concat_chunks(arrays, "text", chunk=9).collect())
    assert [x for f, _, v in got for x in v if f == "f"] == flat["f"]


def test_mono_mix_chunks(spark):
    long = spark.createDataFrame([("f", c, t, float(c * 10 + t)) for c in range(2) for t in range(5)] + [("g", 0, 0, 4.0)],
                                 "file string, channel int, t long, value double")
    chunks = WV.chunk_samples(long, chunk=2, by=("channel",))
    got = sorted((r["file"], r["chunk"], r["samples"]) for r in WV.mono_mix_chunks(chunks).collect())
    assert got == [("f", 0, [5.0, 6.0]), ("f", 1, [7.0, 8.0]), ("f", 2, [9.0]), ("g", 0, [4.0])]
