from pyspark.sql import functions as F

from voxloom import vocab as V
from voxloom.plans import fixtures as FX
from voxloom.plans import paths as P
from tests.conftest import SF_SMOKE


def test_bulk_path_invariants(spark):
    rows = FX.bulk_rows(spark, SF_SMOKE)
    sp = P.bulk_speaker_rows(rows, "doc_id", text_ids="text_ids")
    assert sp.filter(~F.col("placeholder_ok")).count() == 0 and sp.filter(F.col("error").isNotNull()).count() == 0
    sp = sp.drop("error", "placeholder_ok")
    packed = P.pack_corpus(sp, "doc_id", outer=2, inner=3)
    got = packed.select(F.sum("n_rows").alias("rows"), F.sum("n_tokens").alias("tok"),
                        F.max("outer_shard").alias("mo")).collect()[0]
    want = sp.select(F.count("*").alias("rows"), F.sum(F.size("input_ids")).alias("tok")).collect()[0]
    assert (got["rows"], got["tok"], got["mo"]) == (want["rows"], want["tok"], 1)
    bad = packed.filter((F.col("n_tokens") > V.PACK_LIMIT) & (F.col("n_rows") > 1)).count()
    assert bad == 0
    inputs, slots = P.model_inputs(packed, dim=64)
    assert inputs.filter(~F.col("placeholders_ok")).count() == 0
    assert inputs.filter(F.size("segment_ids") != F.size("input_ids")).count() == 0
    # one slot per placeholder that the cut to the model length leaves
    left = inputs.select(F.sum(F.size(F.filter("input_ids", lambda x: x == V.PLACEHOLDER)))).first()[0]
    assert slots.count() == left <= want["rows"]


def test_plain_rows_and_decode(spark):
    rows = FX.bulk_rows(spark, SF_SMOKE, with_embedding=False)
    plain = P.plain_training_rows(rows, "doc_id")
    n = rows.count()
    assert plain.count() == n // 5
    assert plain.filter(F.size("input_ids") > V.MAX_LEN_PLAIN).count() == 0
    gen = rows.select("doc_id", F.concat(A_prompt(), F.slice("codes_list", 1, 14), F.array(F.lit(V.END_OF_AUDIO)))
                      .alias("output_tokens"))
    dec = P.decode_generated(gen)
    # rows with fewer than two frames give a span that is not whole frames (P9 reports it)
    short = rows.filter((F.size("codes_list") < 14) & (F.size("codes_list") % 7 != 0)).count()
    assert dec.filter(~F.col("shape_ok")).count() == short
    assert dec.filter(F.col("shape_ok") & ~F.col("codes_ok")).count() == 0


def A_prompt():
    from voxloom.functions.arrays import lit_array
    return lit_array([V.START_OF_HUMAN, 1, 2, V.START_OF_AUDIO])


def test_curated_helpers(spark):
    urls = spark.createDataFrame([("https://youtu.be/a",), ("https://youtu.be/a",), ("https://youtu.be/b",),
                                  ("https://nope.example/x",)], "url string")
    done = spark.createDataFrame([("b",)], "video_id string")
    jobs, bad = P.download_jobs(urls, done, "out")
    assert [(r["video_id"], r["out_path"]) for r in jobs.collect()] == [("a", "out/a.mp3")]
    assert bad.count() == 1
    segs = spark.createDataFrame([("f", "A", 0, 0.0, 0.004, ""), ("f", "B", 1, 0.004, 0.005, ""), ("f", "A", 2, 0.006, 0.008, "")],
                                 "file string, speaker string, seg_order int, start double, end double, text string")
    samples = spark.createDataFrame([("f", t, float(t)) for t in range(10)], "file string, t long, value double")
    audio = P.main_speaker_audio(segs, samples, sr=1000, bin_width=3).orderBy("start", "t").collect()
    assert [r["t"] for r in audio] == [0, 1, 2, 3, 6, 7]
    tx = spark.createDataFrame([("s1", " hi "), ("s2", "  ")], "stem string, text string")
    codes = spark.createDataFrame([("s1", [V.AUDIO_OFFSET] * 7), ("s2", [V.AUDIO_OFFSET] * 7)], "stem string, codes_list array<int>")
    emb = spark.createDataFrame([("s1", [0.5]), ("s2", [0.1])], "stem string, speaker_embedding array<float>")
    rows = P.speaker_rows(tx, codes, emb).collect()
    assert len(rows) == 1 and rows[0]["input_ids"].count(V.IGNORE_LABEL) == 1


def test_transcripts_stage(spark):
    audio = spark.createDataFrame([("a", "/x/a.mp3"), ("b", "/x/b.mp3")], "stem string, path string")

    def transcribe(client, path):
        if path.endswith("b.mp3"):
            raise RuntimeError("service down")
        return [{"type": "word", "text": "hello"}, {"type": "spacing", "text": " "}, {"type": "word", "text": "there"}]

    out = {r["stem"]: (r["text"], r["status"]) for r in P.transcripts(audio, lambda: ["client"], transcribe).collect()}
    assert out == {"a": ("hello there", "ok"), "b": ("", "error")}


def test_bulk_rows_with_failed_encode_are_tagged(spark):
    rows = spark.createDataFrame([(1, "hi", [V.AUDIO_OFFSET] * 7, [0.1]), (2, "yo", None, [0.2])],
                                 "doc_id long, text string, codes_list array<int>, speaker_embedding array<float>")
    got = {r["doc_id"]: (r["error"], r["placeholder_ok"]) for r in P.bulk_speaker_rows(rows, "doc_id").collect()}
    assert got == {1: (None, True), 2: ("no audio codes", False)}
