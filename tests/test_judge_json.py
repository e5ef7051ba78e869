from pyspark.sql import functions as F

from tracewright.functions import judge_json as jj

GOOD = '{"text":1,"audio":0,"visual":1,"integration":1}'
LABELS = {
    GOOD: None,
    " " + GOOD + "\n": None,
    GOOD.replace("1", "1.0", 1): "invalid_text_value",
    GOOD.replace(":0", ":true"): "invalid_audio_value",
    GOOD.replace(":0", ':"1"'): "invalid_audio_value",
    GOOD.replace(":0", ":null"): "invalid_audio_value",
    GOOD.replace(":0", ":2"): "invalid_audio_value",
    GOOD.replace('"', "'"): "invalid_json",
    GOOD + " x": "invalid_json",
    GOOD[:-1] + ",}": "invalid_json",
    GOOD.replace(":0", ":01"): "invalid_json",
    "[1]": "not_json_object",
    "3": "not_json_object",
    '{"text":1}': "wrong_fields",
    GOOD[:-1] + ',"x":1}': "wrong_fields",
    "": "missing",
    "  ": "missing",
    "nope": "invalid_json",
}


def test_labels_python():
    assert {k: jj.read_labels(k)["error"] for k in LABELS} == LABELS
    assert jj.read_labels(None)["error"] == "missing" and jj.read_labels(5)["error"] == "invalid_type"


def test_labels_native_and_udf(spark):
    df = spark.createDataFrame([(k,) for k in LABELS], "raw string")
    got = df.select("raw", jj.strict_labels(F.col("raw")).alias("n"), jj.labels_udf()(F.col("raw")).alias("u")).collect()
    assert {r.raw: r.n.error for r in got} == LABELS
    assert {r.raw: r.u.error for r in got} == LABELS
    assert [tuple(r.n)[:4] for r in got] == [tuple(r.u)[:4] for r in got]


def test_scores():
    ok = '{"text":1,"audio":2,"visual":3}'
    assert jj.read_scores(ok)["mode"] == "json"
    assert jj.read_scores("<think>{}</think>```json\n" + ok + "\n```")["mode"] == "after_think+fence"
    assert jj.read_scores(ok.replace('":', '_evidence":'))["mode"] == "json+evidence_keys"
    assert jj.read_scores("<think>" + ok)["error"] == "unfinished_thinking"
    assert jj.read_scores('{"text":1,"text":2,"audio":1,"visual":1}')["error"] == "invalid_json"
    assert jj.read_scores(ok.replace("3", "4"))["error"] == "invalid_visual_value"
    assert jj.read_scores(ok.replace("1", "true"))["error"] == "invalid_text_value"


def test_verdicts():
    v = lambda *a, **k: (r := jj.read_verdict(*a, **k), (r["verdict"], r["evidence"], r["parse_ok"]))[1]
    assert v('{"verdict": "supported", "evidence": "e"}') == ("SUPPORTED", "e", True)
    assert v("```json\n{'verdict': 'UNSUPPORTED', 'evidence': None}\n```") == ("UNSUPPORTED", None, True)
    assert v('so: {"verdict": "SUPPORTED", "evidence": "a "q" b"}') == ("SUPPORTED", None, True)
    assert v('{\\"verdict\\": \\"SUPPORTED\\", \\"evidence\\": \\"x\\"}', unescape=True) == ("SUPPORTED", "x", True)
    assert v("none") == (None, None, False)
    d = jj.read_verdict('{"verdict": "HALLUCINATION"}', drift=True, issues=("HALLUCINATED_CUE",))
    assert (d["verdict"], d["issue"], d["issue_ok"]) == ("UNSUPPORTED", "HALLUCINATED_CUE", True)
    assert jj.read_verdict('{"issue": "NONE"}', drift=True)["verdict"] == "SUPPORTED"
