"""The pipeline against plain Python, stage by stage, each on its own input."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import words
from tests.llm.test_dedup import brute_near
from tests.llm.test_models_and_mix import brute_targets
from tests.llm.test_text_filters import brute_contamination, brute_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        kept.append((name, docs))
    return [(n, d.orderBy("doc_id").collect(), d.columns) for n, d in kept]


def texts_of(rows):
    return {r.doc_id: r.text for r in rows}


def test_columns(stages):
    assert all(c == stages[0][2] for _, _, c in stages[:-1]) and set(stages[0][2]) < set(stages[-1][2])


def test_quality(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = texts_of(stages[0][1]), texts_of(stages[1][1])
    assert all(before[i] == t for i, t in after.items())
    right = [(i in after) == bool(q) for i, q in labels.items()]
    assert sum(right) >= 0.95 * len(right)


def test_lines(stages):
    before, after = texts_of(stages[1][1]), texts_of(stages[2][1])
    want = brute_lines(list(before), list(before.values()), 8, 2, 0.6)
    want = {i: t for i, (_, t) in want.items() if words(t) or t == before[i]}
    assert after == want
    assert all(r.n_chars == len(r.text) for r in stages[2][1] if r.text != before[r.doc_id])


def test_near(stages):
    before, after = texts_of(stages[2][1]), texts_of(stages[3][1])
    ids = list(before)
    want = brute_near(list(before.values()), 5)
    assert set(after) == {ids[i] for i, (_, root) in want.items() if i == root}


def test_benchmark(stages):
    before, after = texts_of(stages[3][1]), texts_of(stages[4][1])
    t = pq.read_table(f"{SF}/benchmark.parquet")
    items = [(str(i), x) for i, x in zip(t["item_id"].to_pylist(), t["text"].to_pylist()) if x]
    found = brute_contamination(list(before.values()), items, 10)
    assert set(after) == {i for i, x in zip(before, found.values()) if not x[1]}


def test_mix(stages):
    before, mix = stages[4][1], stages[5][1]
    sizes = {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    want, biggest = brute_targets(sizes), max(len(words(r.text)) for r in before)
    for s, t in want.items():
        assert abs(sum(r.taken for r in mix if r.source == s) - t) <= biggest
    assert all(r.copies in (1, 2) and r.taken == r.copies * r.size for r in mix)


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == [(r.doc_id, r.taken) for r in stages[-1][1]]


def test_stages_that_have_been_read_go(spark, monkeypatch):
    """The mix is what stays; a run that fails leaves nothing."""
    from pathlib import Path

    top = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    folders = lambda: {p for p in top.glob("pipeline-*/*") if p.is_dir()}
    before = folders()
    same = [(n, lambda s, d, f: d.where("doc_id < 9")) for n, _ in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", same)
    assert corpus_pipeline.run(spark, SF).count() == 9
    assert [p.name for p in folders() - before] == ["4-mixing"]
    before = folders()
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*same[:2], ("bad", lambda s, d, f: d.where("no_such_column = 1"))])
    with pytest.raises(Exception, match="no_such_column"):
        corpus_pipeline.run(spark, SF)
    assert folders() == before


def odd_documents(spark, sf):
    """The documents with repeated rows, nulls in every column, a very long text and columns of names that operators use."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    schema = docs.schema
    first = docs.orderBy("doc_id").limit(40)
    repeated = first.unionByName(first)
    odd = [(None, None, None, None, None), (9001, None, "en", None, None), (9002, "", None, "web", 0), (9003, "word and so on. " * 20_000, "en", "web", 300_000), (None, "no id but a text of some words", "en", "web", 30)]
    rows = docs.unionByName(repeated).unionByName(spark.createDataFrame(odd, schema))
    extra = ["size", "target", "copies", "taken", "n_lines", "n_dropped", "_s_upper", "_text", "key", "uid", "score", "_mark"]
    return rows.selectExpr("*", *[f"cast(doc_id % 7 as string) as {c}" for c in extra])


def test_odd_rows_and_columns(spark, tmp_path):
    docs = odd_documents(spark, SF)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns and (name == "mixing" or len(out.columns) == len(docs.columns))
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        counts = lambda df: {r.k: r.n for r in df.selectExpr("coalesce(doc_id, -1) as k").groupBy("k").agg(F.count("*").alias("n")).collect()}
        before, now = counts(docs), counts(after)
        assert all(n <= before[k] for k, n in now.items()), name
        assert after.where("size is distinct from cast(doc_id % 7 as string)").count() == 0
        docs = after
    assert docs.columns[-4:] == ["size_", "target_", "copies_", "taken_"]
    rows = docs.collect()
    assert rows and all(r.size_ == len(words(r.text)) and r.taken_ == r.size_ * r.copies_ and r.doc_id is not None for r in rows)


def test_no_documents(spark):
    docs = odd_documents(spark, SF).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
