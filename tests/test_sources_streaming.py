import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.operators import ingest
from voxloom.sources import readers as R
from voxloom.sources import sealed
from voxloom.sources import sinks as S
from voxloom.streaming import ingest_new_shards


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_manifest_and_transcripts(spark, scratch):
    d = os.path.join(scratch, "chunks")
    os.makedirs(d)
    _write(os.path.join(d, "a_main.txt"), "  hello world \n")
    _write(os.path.join(d, "b_main.txt"), "\t\n")
    _write(os.path.join(d, "-skip.txt"), "ignored")
    _write(os.path.join(d, "a_main.wav"), "RIFF")
    man = {r["stem"] for r in R.scan_manifest(spark, d, ".txt").collect()}
    assert man == {"a_main", "b_main"}
    wav = {r["stem"] for r in R.scan_manifest(spark, d, ".wav", skip_prefix=None).collect()}
    assert wav == {"a_main"}
    tx = {r["stem"]: r["text"] for r in R.read_transcripts(spark, d).collect()}
    assert tx["a_main"] == "hello world" and tx["b_main"] == ""
    # J1 pairing and P5: the empty transcript is dropped, the unmatched stems reported
    audio = spark.createDataFrame([("a_main",), ("c_main",)], "stem string")
    pairs, audio_only, text_only = ingest.pair_by_stem(audio, R.read_transcripts(spark, d).filter(F.length("text") > 0))
    assert [r["stem"] for r in pairs.collect()] == ["a_main"]
    assert [r["stem"] for r in audio_only.collect()] == ["c_main"]
    assert text_only.count() == 0


def test_url_lists(spark, scratch):
    d = os.path.join(scratch, "urls")
    os.makedirs(d)
    _write(os.path.join(d, "good.txt"), "['https://youtu.be/a1', \"https://youtube.com/shorts/b2\"]")
    _write(os.path.join(d, "trailing.txt"), "['https://youtu.be/c3',]\n")
    _write(os.path.join(d, "bad.txt"), "https://youtu.be/d4")
    good, bad = R.read_url_lists(spark, d)
    assert sorted(r["url"] for r in good.collect()) == ["https://youtu.be/a1", "https://youtu.be/c3",
                                                         "https://youtube.com/shorts/b2"]
    assert [os.path.basename(r["file"]) for r in bad.collect()] == ["bad.txt"]


def test_sharded_sink_overwrites_only_its_shard(spark, scratch):
    out = os.path.join(scratch, "sharded")
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "shard int, v string")
    S.write_sharded(df, out)
    S.write_sharded(spark.createDataFrame([(1, "B")], "shard int, v string"), out)
    got = sorted((r["shard"], r["v"]) for r in R.read_shards(spark, out).collect())
    assert got == [(0, "a"), (1, "B"), (2, "c")]
    assert [r["v"] for r in R.read_shards(spark, out, shards=[2]).collect()] == ["c"]


def test_skip_done_and_quarantine_sink(spark, scratch):
    todo = spark.createDataFrame([("x",), ("y",), ("z",)], "stem string")
    done = spark.createDataFrame([("y",), ("y",)], "stem string")
    assert sorted(r["stem"] for r in ingest.skip_done(todo, done).collect()) == ["x", "z"]
    rows = spark.createDataFrame([(1, [1] * 7), (2, [])], "id int, codes array<int>")
    err = F.when(F.size("codes") < 7, F.lit("no full audio frame"))
    out = os.path.join(scratch, "q")
    ingest.write_with_quarantine(rows, err, out)
    back = spark.read.parquet(out)
    assert sorted((r["id"], str(r["quarantined"]).lower()) for r in back.collect()) == [(1, "false"), (2, "true")]


def test_status_counts(spark):
    log = spark.createDataFrame([(3, "ok", None), (1, "error", "boom"), (2, "error", "later"), (4, "ok", None)],
                                "shard int, status string, error string")
    got = {r["status"]: (r["n"], r["first_error"]) for r in ingest.status_counts(log, "status", "error").collect()}
    assert got == {"ok": (2, None), "error": (2, "boom")}


def test_incremental_ingest_processes_each_shard_once(spark, scratch):
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("text", T.StringType())])
    src, sink, ckpt = (os.path.join(scratch, x) for x in ("src", "sink", "ckpt"))
    for i in range(2):
        spark.createDataFrame([(i, f"t{i}-{j}") for j in range(5)], schema).write.parquet(os.path.join(src, f"s{i}"))

    def transform(df):
        return df.withColumn("n_chars", F.length("text"))

    ingest_new_shards(spark, src + "/*", schema, sink, ckpt, transform)
    assert spark.read.parquet(sink).count() == 10
    spark.createDataFrame([(2, f"t2-{j}") for j in range(5)], schema).write.parquet(os.path.join(src, "s2"))
    ingest_new_shards(spark, src + "/*", schema, sink, ckpt, transform)
    out = spark.read.parquet(sink)
    assert out.count() == 15 and out.select("text").distinct().count() == 15
    ingest_new_shards(spark, src + "/*", schema, sink, ckpt, transform)   # nothing new: no repeats
    assert spark.read.parquet(sink).count() == 15


def test_table_transcript_and_packed_sinks(spark, scratch):
    from voxloom.operators.packing import write_packed
    t = spark.createDataFrame([("a", "x"), ("b", "y")], "stem string, text string")
    S.write_table(t, os.path.join(scratch, "tbl"))
    S.write_transcripts(t, os.path.join(scratch, "tx"))
    assert spark.read.parquet(os.path.join(scratch, "tx")).columns == ["stem", "text"]
    assert spark.read.parquet(os.path.join(scratch, "tbl")).count() == 2
    packed = spark.createDataFrame([(0, 0, [1, 2]), (1, 0, [3])], "outer_shard int, bin int, input_ids array<int>")
    write_packed(packed, os.path.join(scratch, "packed"))
    assert {"outer_shard=0", "outer_shard=1"} <= set(os.listdir(os.path.join(scratch, "packed")))


def test_transcript_stems_are_decoded(spark, scratch):
    for name in ("a b", "c%d", "e+f"):
        with open(os.path.join(scratch, f"{name}.txt"), "w") as f:
            f.write("x")
    got = sorted(r["stem"] for r in R.read_transcripts(spark, scratch).collect())
    assert got == ["a b", "c%d", "e+f"]


def test_late_old_shard_and_batch_count(spark, scratch):
    import time
    src, sink, ckpt = (os.path.join(scratch, x) for x in ("in", "out", "ck"))
    schema = spark.range(1).schema

    def shard(i, days):
        tmp = os.path.join(scratch, f"tmp{i}")
        spark.range(i, i + 1).coalesce(1).write.parquet(tmp)
        os.makedirs(src, exist_ok=True)
        part = next(f for f in os.listdir(tmp) if f.endswith(".parquet"))
        to = os.path.join(src, f"{i}.parquet")
        with open(os.path.join(tmp, part), "rb") as a, open(to, "wb") as b:
            b.write(a.read())
        at = time.time() - days * 86400
        os.utime(to, (at, at))

    for i in range(3):
        shard(i, 0)
    assert ingest_new_shards(spark, src, schema, sink, ckpt, max_files_per_trigger=1) == 3
    assert ingest_new_shards(spark, src, schema, sink, ckpt) == 0
    shard(3, 10)
    assert ingest_new_shards(spark, src, schema, sink, ckpt) == 1
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == [0, 1, 2, 3]


def test_logged_ingest_isolates_and_retries_a_shard(spark, scratch):
    from voxloom.streaming import ingest_logged, read_ingested, read_log, retry_failed
    src, sink, log, state = (os.path.join(scratch, x) for x in ("a b%c", "sink", "log", "state"))
    schema = T.StructType([T.StructField("id", T.LongType())])
    for i in range(3):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.parquet(os.path.join(src, f"s{i}"))

    def transform(rows, attempt):
        return rows.withColumn("error", F.when((F.col("id") == 14) & F.lit(attempt < 3), F.lit("boom")))

    assert ingest_logged(spark, src + "/*", schema, sink, log, state, transform, max_files_per_trigger=1) == 3
    ids = lambda: sorted(r["id"] for r in read_ingested(spark, sink, log).collect())
    assert ids() == [*range(10), *range(20, 30)]
    assert ingest_logged(spark, src + "/*", schema, sink, log, state, transform) == 0
    assert retry_failed(spark, schema, sink, log, transform) == 1
    assert ids() == [*range(10), *range(20, 30)]
    # rows of an attempt without a log entry are not read; the attempt replaces itself
    spark.range(99, 100).write.parquet(os.path.join(sink, "run=retry-9-x"))
    assert retry_failed(spark, schema, sink, log, transform) == 1
    assert ids() == list(range(30)) and retry_failed(spark, schema, sink, log, transform) == 0
    got = sorted((r["attempt"], r["status"], r["n_rows"], r["n_errors"], r["error"]) for r in read_log(spark, log).collect() if "s1/" in r["shard"])
    assert got == [(1, "failed", 0, 1, "boom"), (2, "failed", 0, 1, "boom"), (3, "done", 10, 0, None)]


def test_list_literal_reads_what_python_reads(spark):
    import ast
    from voxloom.functions.text import list_literal
    texts = ["[]", " [ ]\n", "['a', \"b\",]", r"['it\'s', 'a\\n', 'x\x41\u00e9\U0001F600\101\0']", r"['\q', 'a\tb']",
             "['a',  # it's\n 'b' ]  # end", "['" + "x" * 50_000 + "', " + "'y', " * 5_000 + "]", "['#no', \"it's\"]", "['line\\\nnext']",
             "['a'", "'a'", "[1]", "['a' 'b']", "['a',,]", "[,]", r"['\x1']", r"['\N{DASH}']", "['a\nb']", "", "[['a']]", "['a'] x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["u"] for r in rows.select("i", list_literal("t").alias("u")).collect()}
    for i, t in enumerate(texts[:9]):
        assert got[i] == ast.literal_eval(t.strip()), t[:40]
    assert [i for i in range(9, len(texts)) if got[i] is not None] == []
    assert spark.range(1).select(list_literal(F.lit(None).cast("string"))).first()[0] is None


def test_files_of_several_lines_are_one_row(spark, scratch):
    _write(os.path.join(scratch, "a.txt"), " one\ntwo\r\n\nthree \n")
    assert [r["text"] for r in R.read_transcripts(spark, scratch).collect()] == ["one\ntwo\r\n\nthree"]
    urls = os.path.join(scratch, "urls")
    os.makedirs(urls)
    _write(os.path.join(urls, "l.txt"), "['https://youtu.be/a',\n 'https://youtu.be/b']\n")
    good, bad = R.read_url_lists(spark, urls)
    assert sorted(r["url"] for r in good.collect()) == ["https://youtu.be/a", "https://youtu.be/b"] and bad.count() == 0


def test_transcript_files_come_back_whole(spark, scratch):
    out = os.path.join(scratch, "files")
    stems = ["a b", "c%d", "e=f/g", "007", "_x", ".y", "h:i", "-skipped", "ü", "1e3", "z.txt", "null"]
    texts = {s: f" {s}\nline\r\n\n" for s in stems} | {"007": "", "null": None}
    rows = [(s, t) for s, t in texts.items()] + [("a b", "zzz"), (None, "lost"), ("", "lost")]
    S.write_transcript_files(spark.createDataFrame(rows, "stem string, text string"), out)
    exact = {r["stem"]: r["text"] for r in R.read_transcript_files(spark, out, skip_prefix=None, strip=False).collect()}
    assert exact == {s: t or "" for s, t in texts.items()}
    kept = {r["stem"]: r["text"] for r in R.read_transcript_files(spark, out).collect()}
    assert kept == {s: (t or "").strip() for s, t in texts.items() if s != "-skipped"}
    assert sorted(r["stem"] for r in R.scan_transcript_files(spark, out).collect()) == sorted(set(stems) - {"-skipped"})
    # one stem written again: the others stay
    S.write_transcript_files(spark.createDataFrame([("007", "new")], "stem string, text string"), out)
    again = {r["stem"]: r["text"] for r in R.read_transcript_files(spark, out, skip_prefix=None).collect()}
    assert again["007"] == "new" and len(again) == len(stems)


def test_sealed_shards(spark, scratch):
    import pytest
    out = os.path.join(scratch, "sealed")
    schema = spark.createDataFrame([], "part int, v string").schema
    read = lambda **k: sorted((r["shard"], r["v"]) for r in sealed.read_sealed(spark, out, schema, **k).collect())
    sealed.write_sealed(spark.createDataFrame([(0, "a"), (0, "a"), (1, "b"), (None, "lost")], schema), out, "part")
    assert read() == [(0, "a"), (0, "a"), (1, "b")]
    sealed.write_sealed(spark.createDataFrame([(1, "B"), (1, None), (2, "c")], schema), out, "part", files_per_shard=3)
    got = sorted((r["shard"], r["v"] or "") for r in sealed.read_sealed(spark, out, schema).collect())
    assert got == [(0, "a"), (0, "a"), (1, ""), (1, "B"), (2, "c")]
    assert {r["shard"]: (r["version"], r["n_rows"]) for r in sealed.read_seals(spark, out).collect()} == {0: (1, 2), 1: (2, 2), 2: (1, 1)}
    # rows without a seal, of an old or a new shard, are not read, and cannot be asked for
    spark.createDataFrame([(0, "x"), (7, "y")], "shard long, v string").write.partitionBy("shard").parquet(f"{out}/run=r-died")
    assert sorted((r["shard"], r["v"] or "") for r in sealed.read_sealed(spark, out, schema).collect()) == got
    assert read(shards=[2]) == [(2, "c")]
    with pytest.raises(ValueError, match=r"\[7\]"):
        sealed.read_sealed(spark, out, schema, shards=[0, 7])
    assert sealed.damaged_shards(spark, out, schema).count() == 0
    run = next(r["run"] for r in sealed.read_seals(spark, out).collect() if r["shard"] == 2)
    spark.createDataFrame([("more",)], "v string").write.mode("append").parquet(f"{out}/run={run}/shard=2")
    assert [tuple(r) for r in sealed.damaged_shards(spark, out, schema).collect()] == [(2, 1, 2)]


def test_nothing_sealed(spark, scratch):
    schema = spark.createDataFrame([], "shard int, v string").schema
    assert sealed.read_seals(spark, os.path.join(scratch, "none")).count() == 0
    sealed.write_sealed(spark.createDataFrame([], schema), os.path.join(scratch, "empty"))
    assert sealed.read_sealed(spark, os.path.join(scratch, "empty"), schema).count() == 0
