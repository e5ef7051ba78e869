"""Commits of the journal: killed runs, lost states, growing inputs, whole sources, streams."""

import json
import os
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.operators import joins
from tracewright.sources import io
from tracewright.streaming import journal as jn
from tracewright.streaming import judge

ROOT = Path(__file__).resolve().parents[1]

KILLED = """
import os, signal, sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
sys.path.insert(0, {root!r})
from tracewright.streaming import judge

spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.driver.memory", "1g").getOrCreate()
log, driver = {log!r}, os.getpid()

def model(prompts):
    with open(log, "a") as f:
        f.writelines(p + "\\n" for p in prompts)
    if sum(1 for _ in open(log)) > 120:
        os.kill(driver, signal.SIGKILL)
    return ["ok " + p for p in prompts]

rows = spark.range(300).select(F.col("id").cast("string").alias("judge_id"), F.concat(F.lit("p"), F.col("id")).alias("prompt"))
judge.resume(spark, rows, {journal!r}, model, lambda x: True, settings={{"seed": 1}}, buckets=16, rows_per_commit=30, batch=5)
"""


def logging(log):
    def model(prompts):
        with open(log, "a") as f:
            f.writelines(p + "\n" for p in prompts)
        return ["ok " + p if "bad" not in p else "no" for p in prompts]

    return model


def ok(text):
    return text.startswith("ok")


def prompts_for(spark, ids, prefix="p"):
    return spark.createDataFrame([(str(i), f"{prefix}{i}") for i in ids], "judge_id string, prompt string")


def logged(path):
    return Counter(Path(path).read_text().split("\n")[:-1]) if os.path.exists(path) else Counter()


def content(spark, journal):
    return {r.judge_id: r.n for r in jn.rows_of(spark, journal).groupBy("judge_id").agg(F.count("*").alias("n")).collect()}


def test_a_killed_run_loses_one_commit(spark, tmp_path):
    journal, first, second = (str(tmp_path / x) for x in ("journal", "first", "second"))
    script = KILLED.format(root=str(ROOT), log=first, journal=journal)
    done = subprocess.run([sys.executable, "-c", script], timeout=300, capture_output=True, cwd=tmp_path)
    assert done.returncode == -9
    assert os.path.exists(f"{journal}.lock")
    there = content(spark, journal)
    assert 60 <= len(there) < 300 and set(there.values()) == {1}
    assert len(logged(first)) - len(there) <= 30 + 60  # what one commit holds, and what ran beside the killing call
    rows = prompts_for(spark, range(300))
    with pytest.raises(ValueError, match="seed"):
        judge.resume(spark, rows, journal, logging(second), ok, settings={"seed": 2})
    state = judge.resume(spark, rows, journal, logging(second), ok, settings={"seed": 1}, rows_per_commit=30)
    again = logged(second)
    assert not {f"p{i}" for i in there} & set(again) and len(again) == 300 - len(there) and set(again.values()) == {1}
    assert content(spark, journal) == {str(i): 1 for i in range(300)} and state["done"] == 300
    assert not any(os.path.exists(f"{journal}.{x}") for x in ("lock", "queue")) and not os.listdir(f"{journal}.staging")


def test_a_commit_that_the_state_does_not_know(spark, tmp_path):
    journal, log = str(tmp_path / "j"), str(tmp_path / "log")
    rows = prompts_for(spark, range(50))
    judge.resume(spark, rows.where("judge_id < '3'"), journal, logging(log), ok, buckets=4)
    early = io.read_stats(spark, f"{journal}.state.json")
    judge.resume(spark, rows, journal, logging(log), ok, rows_per_commit=1000)
    late = json.loads(Path(f"{journal}.state.json").read_text())
    io.write_stats(spark, early, f"{journal}.state.json")  # killed between the rename and the state
    judge.resume(spark, rows, journal, logging(log), ok)
    assert json.loads(Path(f"{journal}.state.json").read_text()) == late and set(logged(log).values()) == {1}


def test_only_open_buckets_are_read(spark, tmp_path, monkeypatch):
    journal, log = str(tmp_path / "j"), str(tmp_path / "log")
    rows = prompts_for(spark, range(200))
    judge.resume(spark, rows, journal, logging(log), ok, buckets=8, rows_per_commit=40)
    read = []
    plain = jn.rows_of
    monkeypatch.setattr(jn, "rows_of", lambda *a, **b: read.append(a[2]) or plain(*a, **b))
    judge.resume(spark, rows, journal, logging(log), ok)
    assert read == [] and len(logged(log)) == 200
    more = prompts_for(spark, range(201))
    state = judge.resume(spark, more, journal, logging(log), ok)
    assert len(read) == 1 and len(read[0]) == 1 and state["done"] == 201 and set(logged(log).values()) == {1}
    with pytest.raises(ValueError, match="outside the input"):
        judge.resume(spark, rows, journal, logging(log), ok)
    with pytest.raises(ValueError, match="outside the input"):
        judge.resume(spark, rows.limit(1), journal, logging(log), ok)
    judge.resume(spark, rows.limit(3), journal, logging(log), ok, part_of_input=True)
    with pytest.raises(ValueError, match="1 rows without judge_id"):
        judge.resume(spark, rows.unionByName(spark.sql("select null as judge_id, 'x' as prompt")), journal, logging(log), ok)


def test_failures_are_mended(spark, tmp_path):
    journal, log = str(tmp_path / "j"), str(tmp_path / "log")
    bad = prompts_for(spark, range(30), "bad").where("judge_id % 3 = 0").unionByName(prompts_for(spark, range(30)).where("judge_id % 3 > 0"))
    state = judge.resume(spark, bad, journal, logging(log), ok, attempts=1, buckets=4)
    assert (state["done"], state["failed"]) == (30, 10)
    state = judge.resume(spark, prompts_for(spark, range(30)), journal, logging(log), ok, retry_failures=True)
    assert (state["done"], state["failed"]) == (30, 0) and judge.progress_of(spark, journal, 60, 3.0) == {"done": 30, "failed": 0, "percent": 50, "eta": 3}
    assert Counter(content(spark, journal).values()) == {1: 20, 2: 10}
    judge.resume(spark, prompts_for(spark, range(30)), journal, logging(log), ok, retry_failures=True)
    assert sum(logged(log).values()) == 40


def test_units():
    assert jn.units({0: 5, 1: 5, 2: 25, 3: 1}, 10) == [([2], 0, 3), ([2], 1, 3), ([2], 2, 3), ([0, 1], 0, 1), ([3], 0, 1)]
    assert jn.units({}, 10) == []


def test_progress_reads_the_state_alone(spark, tmp_path):
    Path(tmp_path / "j.state.json").write_text(json.dumps({"done": 25, "failed": 2}))
    assert judge.progress_of(spark, str(tmp_path / "j"), 100, 10.0) == {"done": 25, "failed": 2, "percent": 25, "eta": 30}


def plain_calls(keys, most):
    groups = []
    for k in keys:
        if groups and groups[-1][0] == k:
            groups[-1].append(k)
        else:
            groups.append([k])
    out = []
    for g in groups:
        if out and len(out[-1]) + len(g) <= most:
            out[-1] += g
        else:
            out.append(list(g))
    return out


def test_whole_sources_in_calls():
    rng = random.Random(1)
    for _ in range(100):
        keys = [k for k in range(rng.randint(0, 9)) for _ in range(rng.randint(1, 7))]
        frame = pd.DataFrame({"s": keys, "judge_id": range(len(keys))})
        cuts = sorted(rng.randint(0, len(keys)) for _ in range(3))
        parts = [frame.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, len(keys)])]
        assert [f["s"].tolist() for f in judge.calls(iter(parts), 6, together="s")] == plain_calls(keys, 6)
        assert [f["s"].tolist() for f in judge.calls(iter(parts), 6, whole="s")] == plain_calls(keys, 0)


def test_sources_are_judged_together(spark, tmp_path):
    journal = str(tmp_path / "j")
    rows = spark.range(120).select(F.col("id").cast("string").alias("judge_id"), F.concat_ws("-", F.floor(F.col("id") / 6), "id").alias("prompt"), F.floor(F.col("id") / 6).alias("source_id"))

    def model(prompts):
        return [f"{len(prompts)} " + " ".join(sorted({p.split('-')[0] for p in prompts})) for _ in prompts]

    judge.resume(spark, rows, journal, model, bool, together="source_id", buckets=4, batch=8, rows_per_commit=50)
    out = jn.rows_of(spark, journal).collect()
    assert len(out) == 120 and {r.raw_output.split()[0] for r in out} == {"6"}  # six rows a source, and no two sources fit into eight
    assert all(r.raw_output.split()[1] == str(int(r.judge_id) // 6) for r in out)


def test_a_large_journal_is_not_moved(spark):
    rows = spark.range(1_000).select(F.col("id").cast("string").alias("judge_id"))
    done = spark.range(500, 200_000).select(F.col("id").cast("string").alias("judge_id"))
    out = joins.pending_from(rows, done, "judge_id")
    assert out.count() == 500
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "LeftAnti" in plan
    large = joins.SENT_KEYS
    joins.SENT_KEYS = 10
    try:
        assert "LeftSemi" not in joins.pending_from(rows, done, "judge_id")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        joins.SENT_KEYS = large


def test_stream_knows_what_it_has_seen(spark, tmp_path, monkeypatch):
    source, journal, checkpoint, log = (str(tmp_path / x) for x in ("in", "j", "c", "log"))
    schema = "judge_id string, prompt string"
    prompts_for(spark, range(20)).write.json(source)
    judge.judge_stream(spark, source, schema, journal, checkpoint, logging(log), ok, buckets=4).awaitTermination()

    def never(*a, **b):
        raise AssertionError("the journal was read")

    with monkeypatch.context() as m:
        m.setattr(jn, "rows_of", never)
        prompts_for(spark, range(10, 40)).write.mode("append").json(source)
        judge.judge_stream(spark, source, schema, journal, checkpoint, logging(log), ok).awaitTermination()
    assert content(spark, journal) == {str(i): 1 for i in range(40)} and set(logged(log).values()) == {1}
    # Rows of other writers count as well, and a batch that is there already is not judged again.
    judge.resume(spark, prompts_for(spark, range(40, 50)), journal, logging(log), ok, part_of_input=True)
    prompts_for(spark, range(45, 60)).write.mode("append").json(source)
    judge.judge_stream(spark, source, schema, journal, checkpoint, logging(log), ok).awaitTermination()
    assert content(spark, journal) == {str(i): 1 for i in range(60)} and set(logged(log).values()) == {1}
    state = json.loads(Path(f"{journal}.state.json").read_text())
    (writer,) = state["batches"]
    assert jn.has_batch(state, writer, state["batches"][writer]) and not jn.has_batch(state, writer, state["batches"][writer] + 1)


def test_digests_tell_repeated_rows_apart(spark):
    digest = lambda *x: io.multiset_digest(spark.createDataFrame([(i,) for i in x], "a int"))
    assert digest(1, 1, 2, 2) != digest(7, 7, 9, 9) and digest(1, 2, 3) == digest(3, 1, 2) and digest(1, 1, 2) != digest(1, 2, 2)
    assert digest() != digest(0) and io.multiset_digest(spark.sql("select cast(null as int) as a")) != digest()
