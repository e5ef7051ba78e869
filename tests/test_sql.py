import json

from pyspark.sql import functions as F

from tracewright.functions import judge_json
from tracewright.operators import metrics
from tracewright.plans import sql


def test_sql_surface(spark):
    sql.register_functions(spark)
    r = spark.sql("""select parse_judge_verdict('{"verdict": "SUPPORTED"}').grounded g, parse_judge_labels('x').error e, parse_judge_scores('{"text":1,"audio":1,"visual":2}').visual v""").first()
    assert tuple(r) == (1, "invalid_json", 2)
    sql.register_views(spark, "/root/testdata/sf0.001", "best_of_n", "retention")
    assert spark.sql("select count(*) from q_best_of_n").first()[0] > 0


def test_payload_omits_the_answer(spark):
    row = spark.createDataFrame([('he said "so"', "t\n", None, "v")], "s string, a string, b string, c string")
    out = row.select(judge_json.payload_json(F.col("s"), {"text_evidence": F.col("a"), "audio_evidence": F.col("b"), "visual_evidence": F.col("c")})).first()[0]
    assert json.loads(out) == {"TRANSCRIPT": 'he said "so"', "CANDIDATE_SECTIONS": {"text": "t\n", "audio": None, "visual": "v"}}


def test_id_lists(spark):
    rows = spark.createDataFrame([("s", "b", 2, None), ("s", "a", 3, None), ("s", "c", 1, "x"), ("s", "c", 5, "y"), ("t", "d", 4, "z")], "g string, k string, o int, reject_reason string")
    got = {r.g: (list(r.kept), r.rejected) for r in metrics.id_lists(rows, "g", "k", "o").collect()}
    assert got == {"s": (["b", "a"], {"c": "y"}), "t": ([], {"d": "z"})}
