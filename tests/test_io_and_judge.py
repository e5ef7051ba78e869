import json

import pytest
from pyspark.sql import functions as F

from tracewright.operators import validate
from tracewright.sources import chunks as chunks_of
from tracewright.sources import io
from tracewright.streaming import judge


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"judge_id":"1","parse_ok":true}\n\n{"judge_id":"2","parse_ok":false}\n{"judge_id":"3","par')
    assert [r[0] for r in io.done_ids(spark, str(p)).collect()] == ["1"]
    with pytest.raises(Exception):
        io.read_jsonl(spark, str(p), "judge_id string, parse_ok boolean").collect()
    with pytest.raises(Exception, match="line 4"):
        io.read_jsonl_numbered(spark, str(p), "judge_id string").collect()
    assert {r[0] for r in io.done_ids(spark, str(p), failed_too=True).collect()} == {"1", "2"}
    p.write_text('\n{"judge_id":"1"}\n')
    assert [(r.raw_line_no, r.judge_id) for r in io.read_jsonl_numbered(spark, str(p), "judge_id string").collect()] == [(2, "1")]


def test_json_sink_keeps_nulls_and_text(spark, tmp_path):
    io.write_jsonl(spark.createDataFrame([("é", None)], "a string, b string").coalesce(1), str(tmp_path / "o"))
    text = next((tmp_path / "o").glob("part*")).read_text()
    assert text == '{"a":"é","b":null}\n'


def test_split_tables(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('KEY,SENTENCE,Sarcasm\n12.0,"He said ""no"",\nthen left",1.0\nb,x,0.0\n')
    rows = io.canonical_english(io.read_table(spark, str(p)), "valid", "/m").orderBy("id").collect()
    assert [(r.id, r.text, r.label, r.video) for r in rows] == [("12", 'He said "no",\nthen left', 1, "/m/video/12.mp4"), ("b", "x", 0, "/m/video/b.mp4")]
    z = io.zero_shot(io.canonical_english(io.read_table(spark, str(p)), "valid", "/m"), "Say: {{TRANSCRIPT}}").where("id = 'b'").first()
    assert z.messages[0].content == "Say: x" and z.videos == ["/m/video/b.mp4"]


def test_publish_and_chunks(spark, tmp_path):
    rows = spark.range(700).select(F.col("id").alias("row_index"))
    path = str(tmp_path / "out")
    first = io.publish(spark, {"scored": rows}, path)
    with pytest.raises(FileExistsError):
        io.publish(spark, {"scored": rows}, path)
    assert io.publish(spark, {"scored": rows.repartition(3)}, path, overwrite=True) == first
    assert json.loads((tmp_path / "out" / "manifest.json").read_text())["outputs"] == first
    assert io.published(spark, path, "scored").count() == 700 and len([p for p in (tmp_path / "out").iterdir() if p.is_dir()]) == 1
    with pytest.raises(FileNotFoundError):
        io.published(spark, path, "other")
    chunks = chunks_of.chunk_ids(rows)
    done = chunks.where("row_index < 650")
    assert [tuple(r) for r in chunks_of.missing_chunks(chunks, done).collect()] == [(2, 100, 50)]
    with pytest.raises(ValueError):
        chunks_of.merge_chunks(chunks, done)
    assert chunks_of.merge_chunks(chunks, chunks).count() == 700


def test_chunk_runner(spark, tmp_path):
    """A second run does only what is missing or short; a failing job keeps the jobs before it."""
    rows = spark.range(700).select(F.col("id").alias("row_index"), F.concat(F.lit("p"), "id").alias("prompt"))
    path, log = str(tmp_path / "out"), str(tmp_path / "log")

    def work(fail=-1):
        def infer(frames):
            for f in frames:
                with open(log, "a") as out:
                    out.writelines(f"{i}\n" for i in f["row_index"])
                if (f["chunk_id"] == fail).any():
                    raise RuntimeError("out of memory")
                yield f.assign(response="r" + f["prompt"])[["row_index", "response", "chunk_id"]]

        return lambda some: some.mapInPandas(infer, "row_index long, response string, chunk_id int")

    def logged():
        with open(log) as f:
            out = sorted(int(x) for x in f)
        open(log, "w").close()
        return out

    with pytest.raises(Exception, match="out of memory"):
        chunks_of.run_chunks(spark, rows, path, work(fail=4), size=100, chunks_per_job=2)
    logged()
    with pytest.raises(ValueError, match="incomplete"):
        chunks_of.merged(spark, rows, path, size=100)
    assert chunks_of.run_chunks(spark, rows, path, work(), size=100, chunks_per_job=2) == [4, 5, 6] and logged() == list(range(400, 700))
    assert chunks_of.run_chunks(spark, rows, path, work(), size=100) == [] and logged() == []
    kept = {p.name: [f.name for f in p.iterdir()] for p in (tmp_path / "out").glob("chunk_id=[1456]")}
    # One chunk is short, one is gone: these two are written again, and no others.
    short = spark.read.parquet(f"{path}/chunk_id=2").limit(40).toPandas()
    spark.createDataFrame(short).coalesce(1).write.mode("overwrite").parquet(f"{path}/chunk_id=2")
    import shutil

    shutil.rmtree(tmp_path / "out" / "chunk_id=3")
    assert chunks_of.run_chunks(spark, rows, path, work(), size=100) == [2, 3] and logged() == list(range(200, 400))
    assert kept == {p.name: [f.name for f in p.iterdir()] for p in (tmp_path / "out").glob("chunk_id=[1456]")}
    assert [(r.row_index, r.response) for r in chunks_of.merged(spark, rows, path, size=100).collect()] == [(i, f"rp{i}") for i in range(700)]
    with pytest.raises(ValueError, match="incomplete"):
        chunks_of.run_chunks(spark, rows, str(tmp_path / "other"), lambda some: some.where("row_index <> 5"), size=100)


def test_statistics_are_counted_while_writing(spark, tmp_path):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "finish_reason").when(F.col("id") % 5 == 0, "odd").alias("reject_reason"))
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    scanned = rows.mapInPandas(count, rows.schema)
    kept, facts = io.watch(scanned, rows=F.count("*"), **io.reason_counts(F.col("reject_reason"), validate.REASONS))
    digests = io.publish(spark, {"kept": kept.where("reject_reason is null").select("id")}, str(tmp_path / "out"), watched={"kept": facts})
    assert seen.value == 1000  # one scan for the rows, their digest and the counts
    stats = io.statistics(spark, str(tmp_path / "out"))["kept"]
    assert stats == {"rows": 1000, "finish_reason": 334, "malformed_structure": 0, "unparseable_answer": 0, "invalid_gold": 0, "wrong_prediction": 0, "accepted": 533, "other": 133}
    assert digests["kept"] == io.multiset_digest(io.published(spark, str(tmp_path / "out"), "kept"))


def test_metrics_files(spark, tmp_path):
    for step, f1 in ((100, 0.5), (20, 0.7), (300, 0.7)):
        d = tmp_path / f"base_ckpt{step}"
        d.mkdir()
        (d / "metrics.json").write_text(json.dumps({"macro_f1": f1}))
    m = io.read_metrics(spark, str(tmp_path / "*" / "metrics.json"), "macro_f1 double")
    assert [(r.step, r.best) for r in io.checkpoint_curve(m).collect()] == [(20, True), (100, False), (300, False)]


def model(prompts):
    if any("bad" in p for p in prompts):
        raise RuntimeError("no")
    return ["ok " + p for p in prompts]


def test_halving():
    assert judge.halving(model, ["a", "bad", "c"]) == [("ok a", None), (None, "RuntimeError: no"), ("ok c", None)]


def valid(text):
    return text.startswith("ok")


def test_resume_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a"), ("2", "bad"), ("3", "c")], "judge_id string, prompt string")
    journal = str(tmp_path / "journal")
    judge.resume(spark, rows, journal, model, valid)
    judge.resume(spark, rows, journal, model, valid)
    got = lambda: {tuple(r) for r in io.read_jsonl(spark, journal, judge.JOURNAL).groupBy("judge_id").agg(F.count("*"), F.max("attempts"), F.max("parse_ok")).collect()}
    assert got() == {("1", 1, 1, True), ("2", 1, 3, False), ("3", 1, 1, True)}
    judge.resume(spark, rows, journal, model, valid, retry_failures=True)
    assert got() == {("1", 1, 1, True), ("2", 2, 3, False), ("3", 1, 1, True)}
    assert judge.progress_of(spark, journal, 6, 30.0) == {"done": 3, "failed": 1, "percent": 50, "eta": 30}
    with pytest.raises(ValueError, match="outside the input"):
        judge.resume(spark, rows.limit(1), journal, model, valid)
    with pytest.raises(ValueError, match="without settings"):
        judge.resume(spark, rows, journal, model, valid, settings={"seed": 1})
    fresh = str(tmp_path / "fresh")
    judge.resume(spark, rows, fresh, model, valid, settings={"seed": 1})
    judge.resume(spark, rows, fresh, model, valid, settings={"seed": 1})
    with pytest.raises(ValueError, match="seed"):
        judge.resume(spark, rows, fresh, model, valid, settings={"seed": 2})
    with judge.writing(spark, fresh), pytest.raises(RuntimeError, match="another process"):
        judge.resume(spark, rows, fresh, model, valid, settings={"seed": 1})
    judge.resume(spark, rows, fresh, model, valid, settings={"seed": 1})
    rows.write.json(str(tmp_path / "in"))
    q = judge.judge_stream(spark, str(tmp_path / "in"), "judge_id string, prompt string", str(tmp_path / "j2"), str(tmp_path / "c2"), model, valid)
    q.awaitTermination()
    batch = {(r.judge_id, r.raw_output) for r in io.read_jsonl(spark, journal, judge.JOURNAL).collect()}
    assert {(r.judge_id, r.raw_output) for r in io.read_jsonl(spark, str(tmp_path / "j2"), judge.JOURNAL).collect()} == batch


def test_completeness():
    c = judge.completeness
    assert [c(set(), None, 3), c({"predictions", "metrics", "scored"}, 3, 3), c({"predictions"}, 2, 3), c({"metrics"}, None, 3)] == ["absent", "complete", "partial", "legacy"]


def test_line_numbers_over_splits(spark, tmp_path):
    """Files are read in many splits, and lines keep their numbers."""
    for name, n in (("a", 5000), ("b", 3)):
        (tmp_path / f"{name}.jsonl").write_text("".join("\n" if i % 7 == 3 else json.dumps({"k": i, "pad": "x" * (i % 50)}) + "\n" for i in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = io.read_jsonl_numbered(spark, str(tmp_path / "*.jsonl"), "k long").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(r.k == r.raw_line_no for r in rows) and len(rows) == sum(i % 7 != 3 for n in (5000, 3) for i in range(1, n + 1))


def test_pool_tables_and_templates(spark, tmp_path):
    pool = tmp_path / "pool.jsonl"
    pool.write_text('{"judge_id": "1", "text": "a"}\n{"judge_id": "2", "text": "b"}\n')
    assert io.read_pool(spark, str(pool), "judge_id string, text string", ("text",)).count() == 2
    pool.write_text('{"judge_id": "1", "text": "a"}\n{"judge_id": "1", "text": " "}\n')
    with pytest.raises(ValueError, match=r"2 rows, 1 keys, blank: \['text'\]"):
        io.read_pool(spark, str(pool), "judge_id string, text string", ("text",))
    chinese = spark.createDataFrame([("3.0", "t", "s"), ("x", "u", "ns")], ["File Name", "Transcriptions", "Labels"])
    assert [(r.id, r.label, r.dataset) for r in io.canonical_chinese(chinese, "test", "/m").collect()] == [("3", 1, "mcsd"), ("x", 0, "mcsd")]
    (tmp_path / "t.txt").write_text(" Say {{X}} \n")
    assert io.read_template(spark, str(tmp_path / "t.txt")) == "Say {{X}}"
    with pytest.raises(Exception):
        io.read_template(spark, str(tmp_path / "none.txt"))
    io.write_csv(spark.createDataFrame([("a,b", 1)], "x string, n int"), str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("part*")).read_text() == 'x,n\n"a,b",1\n'


def test_media_probe(spark, tmp_path):
    import hashlib
    import wave

    for name in ("a", "copy"):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(16_000)
            w.writeframes(b"\0\0" * 8_000)
    (tmp_path / "bad.wav").write_bytes(b"no audio")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in io.media_frame(spark, str(tmp_path / "*.wav"), io.probe_wave, io.WAVE).collect()}
    assert (rows["a.wav"].duration, rows["a.wav"].rate, rows["a.wav"].channels, rows["a.wav"].width, rows["a.wav"].error) == (0.5, 16_000, 1, 2, None)
    assert rows["a.wav"].sha256 == rows["copy.wav"].sha256 == hashlib.sha256((tmp_path / "a.wav").read_bytes()).hexdigest()
    assert rows["bad.wav"].error and rows["bad.wav"].duration is None
    same = spark.read.format("binaryFile").load(str(tmp_path / "a.wav")).select(io.content_hash(F.col("content"))).first()[0]
    assert same == rows["a.wav"].sha256


def test_sources_stay_together(spark):
    rows = spark.range(200).select((F.col("id") % 5).cast("string").alias("source_id"), F.col("id").alias("raw_index"))
    parts = judge.by_source(rows).select("source_id", "raw_index", F.spark_partition_id().alias("p")).collect()
    assert all(len({r.p for r in parts if r.source_id == s}) == 1 for s in "01234")
