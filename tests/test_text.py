import re
from pathlib import PurePosixPath

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.functions import text as tx


def values(spark, inputs, column):
    df = spark.createDataFrame(list(enumerate(inputs)), "i int, s string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("s"))).collect()]


def test_answer_modes(spark):
    answers = ["Sarcasm", "sarcastic", "NON SARCASM", "non_sarcasm", "non-sarcasm", "nonsarcastic", "maybe", "", "Non_Sarcasm", " sarcasm　", None]
    expected = {
        "spaced": [1, None, 0, None, 0, None, None, None, None, 1, None],
        "lenient": [1, 1, 0, 0, 0, 0, None, None, 0, 1, None],
        "words": [1, None, 0, 0, 0, None, None, None, 0, 1, None],
        "exact": [1, None, None, None, 0, None, None, None, None, 1, None],
    }
    for mode, want in expected.items():
        assert values(spark, answers, lambda c, m=mode: tx.answer_label(c, m)) == want, mode
    assert values(spark, ["supported", " UNSUPPORTED ", "x"], lambda c: tx.answer_label(c, "verdict")) == [1, 0, None]


def lenient(text, name):
    found = re.findall(rf"<{name}>(.*?)</{name}>", text, re.IGNORECASE | re.DOTALL)
    return (found[0].strip() or None) if len(found) == 1 else None


TAGS = ["", "<a></a>", "<a> x </a>", "<A>x</a>", "<a>x</a><a>y</a>", "<a>x<a>y</a>", "<a> 　</a>", "<a>　b </a>", "<a>x\ny\r\n</a>", "</a>x<a>", "<think><a>z</a></think>", "<a>\x1cq\x1f</a>"]


def test_lenient_tag(spark):
    assert values(spark, TAGS, lambda c: tx.tag(c, "a")) == [lenient(t, "a") for t in TAGS]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["<a>", "</a>", "<A>", "x", " ", "\n", "　", "<", "é"]), max_size=8).map("".join), min_size=30, max_size=60))
def test_lenient_tag_random(spark, texts):
    assert values(spark, texts, lambda c: tx.tag(c, "a")) == [lenient(t, "a") for t in texts]


PARTS = [f"<{s}>" for s in tx.SECTIONS] + [f"</{s}>" for s in tx.SECTIONS] + ["<ANSWER>", "</Answer>", "<answer", "answer>", "/answer>", "<", ">", "x", " ", "\n", "　", "é", "<think>", "K", "\x1c"]


def all_sections(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "_tags int, response string").withColumn("_CHUNKS", F.lit(1))
    return [tuple(r.parsed) for r in tx.with_sections(rows).orderBy("_tags").collect()]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), min_size=60, max_size=120))
def test_sections_random(spark, texts):
    assert all_sections(spark, texts) == [tuple(lenient(t, s) for s in tx.SECTIONS) for t in texts]


def test_sections(spark):
    whole = "".join(f"<{s}> {s} 1 </{s}>" for s in tx.SECTIONS)
    texts = [whole, whole[::-1], whole + whole, whole.upper(), whole.replace("1", "<answer>"), "<" * 200_000 + whole + "<" * 200_000, "a<" * 100_000, "answer>", "", "<integration><answer>x</answer></integration>"]
    assert all_sections(spark, texts) == [tuple(lenient(t, s) for s in tx.SECTIONS) for t in texts]
    assert all_sections(spark, [None]) == [(None,) * 5]


def test_filters_pass_below_the_sections(spark):
    rows = spark.createDataFrame([(1, "<answer>x</answer>", "stop")], "id int, response string, finish string")
    plan = tx.with_sections(rows).where("finish = 'stop' and parsed.answer = 'x'")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate", 1)[0], plan.rsplit("Generate", 1)[1]
    assert "parsed" in above or "_found" in above
    assert "finish" in below and "Filter" in below and plan.count("regexp_extract_all") == 1


def test_blanks_are_those_of_python(spark):
    every = [c for c in map(chr, range(1, 0x10000)) if not "\ud800" <= c <= "\udfff"]
    assert values(spark, [f"{c}x{c}" for c in every], tx.strip) == [f"{c}x{c}".strip() for c in every]


def test_strict_tag_reasons(spark):
    texts = ["<a>x</a>", "x", "<a>x", "<a>x</a></a>", "</a><a>", "<a> \n </a>", "<A>x</A>"]
    want = [None, "a_open_count_0", "a_close_count_0", "a_close_count_2", "a_not_parseable", "a_empty", "a_open_count_0"]
    assert values(spark, texts, lambda c: tx.strict_tag_error(c, ("a",))) == want


def test_answer_errors(spark):
    texts = [None, "  ", "x", "<answer>Sarcasm</answer>", "<answer>a</answer><answer>b</answer>", "<answer>maybe</answer>"]
    assert values(spark, texts, tx.answer_error) == ["missing_response", "missing_response", "missing_answer_tag", None, "multiple_answer_tags", "invalid_answer"]


def test_paths(spark):
    paths = ["/a/b.mp4", "b", "/a/b.tar.gz", "/a/.mp4", "a/b/", "x.wav"]
    assert values(spark, paths, tx.path_stem) == ["b", "b", "b.tar", ".mp4", "b", "x"]
    odd = ["a.", "..a", "a..", "a.b.", "..a.b", ".a.b", "a..b", "a...b", "x/a.b/", ".a"]
    assert values(spark, odd, tx.path_stem) == [PurePosixPath(p).stem for p in odd]


def test_template(spark):
    filled = values(spark, ["$1 \\ {{X}}"], lambda c: tx.fill(F.lit("<{{X}}>"), {"X": c}))
    assert filled == ["<$1 \\ {{X}}>"]
    with pytest.raises(Exception, match="lacks"):
        values(spark, ["a"], lambda c: tx.fill(F.lit("no"), {"X": c}, required=True))


def test_transcripts(spark):
    texts = ['Transcript: "hi there"\nmore', "utterance : a\r\nb", "<transcript> q </transcript>", "nothing"]
    assert values(spark, texts, tx.transcript_line) == ["hi there", "a", None, None]
    assert values(spark, texts[:1] + texts[2:], tx.transcript) == ["hi there", "q", None]


def test_gold_labels(spark):
    assert values(spark, ["1", "true", "Sarcastic", "0.0", "non sarcastic"], tx.gold_label) == [1, 1, 1, 0, 0]
    with pytest.raises(Exception, match="unsupported gold label"):
        values(spark, ["2"], tx.gold_label)


def test_split_of():
    assert tx.split_of("/x/train.jsonl") == "train" and tx.split_of("a/samples_valid_8.jsonl") == "valid"
    with pytest.raises(ValueError):
        tx.split_of("train_test.jsonl")
