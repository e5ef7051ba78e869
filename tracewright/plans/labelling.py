"""Queries: judge labels, their merge, and reward-model training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import judge_json
from tracewright.functions.judge_json import COMPONENTS
from tracewright.operators import labels, metrics
from tracewright.plans.traj import LABELS_SQL, RAW_JSON_SQL, component_labels, raw_labels, tables


def _long(spark, sf_dir):
    lab = component_labels(spark, sf_dir)
    return lab.select("judge_id", F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("grounded")) for c in COMPONENTS])).alias("x")).select("judge_id", "x.*")


def merge_labels(spark, sf_dir):
    tables(spark, sf_dir, "documents")
    pool = spark.table("documents").select(F.col("doc_id").alias("judge_id"), "source")
    return labels.merge_labels(pool, _long(spark, sf_dir))


def pattern_counts(spark, sf_dir):
    return metrics.patterns(component_labels(spark, sf_dir), COMPONENTS)


def component_rates(spark, sf_dir):
    return metrics.component_rates(component_labels(spark, sf_dir), COMPONENTS)


def sum_histogram(spark, sf_dir):
    return metrics.histogram(merge_labels(spark, sf_dir), "grounding_sum", 0, 4)


def chat_rows(spark, sf_dir):
    tables(spark, sf_dir, "documents")
    d = spark.table("documents").select("doc_id", F.col("text").alias("t"), "lang", "source")
    rows = d.join(component_labels(spark, sf_dir), F.col("doc_id") == F.col("judge_id"))
    template = F.lit("T: {{TRANSCRIPT}}\nE: {{EVIDENCE}}")
    chat = labels.chat_row(F.lit("You judge."), template, {"TRANSCRIPT": F.col("t"), "EVIDENCE": F.col("lang")}, {c: F.col(c) for c in COMPONENTS})
    return rows.select("doc_id", chat.alias("m")).select("doc_id", F.size("m").cast("long").alias("turns"), F.col("m")[1]["content"].alias("user"), F.col("m")[2]["content"].alias("target"))


def strict_label_json(spark, sf_dir):
    r = raw_labels(spark, sf_dir).select("judge_id", judge_json.strict_labels(F.col("raw")).alias("p"))
    return r.select("judge_id", *[F.col(f"p.{c}").alias(c) for c in COMPONENTS], F.col("p.error").alias("error"))


def exact_label_json(spark, sf_dir):
    r = raw_labels(spark, sf_dir).select("judge_id", judge_json.labels_udf()(F.col("raw")).alias("p"))
    return r.select("judge_id", *[F.col(f"p.{c}").alias(c) for c in COMPONENTS], F.col("p.error").alias("error"))


QUERIES = {f.__name__: f for f in (merge_labels, pattern_counts, component_rates, sum_histogram, chat_rows, strict_label_json, exact_label_json)}

_JSON = f"""with {RAW_JSON_SQL} select judge_id,
 case when judge_id % 12 > 8 then text end as text, case when judge_id % 12 > 8 then audio end as audio, case when judge_id % 12 > 8 then visual end as visual, case when judge_id % 12 > 8 then integration end as integration,
 case judge_id % 12 when 0 then 'invalid_audio_value' when 1 then 'invalid_audio_value' when 2 then 'invalid_text_value' when 3 then 'wrong_fields' when 4 then 'wrong_fields'
  when 5 then 'not_json_object' when 6 then 'missing' when 7 then 'invalid_json' when 8 then 'invalid_integration_value' end as error from raws join lab using (judge_id)"""
ORACLES = {
    "merge_labels": f"with {LABELS_SQL} select judge_id, source, lab.text, audio, visual, integration, lab.text + audio + visual + integration as grounding_sum, lab.text + audio + visual + integration = 4 as all_grounded from lab join documents on doc_id = judge_id",
    "pattern_counts": f"with {LABELS_SQL} select concat(text, audio, visual, integration) as pattern, count(*) as n from lab group by 1",
    "component_rates": f"with {LABELS_SQL}, l as ("
    + " union all ".join(f"select '{c}' as component, {c} as v from lab" for c in COMPONENTS)
    + ") select component, count(*) filter (v = 1) as supported, count(*) filter (v = 0) as unsupported, round(avg(v), 6) as rate from l group by 1",
    "sum_histogram": f"with {LABELS_SQL} select cast(k as integer) as grounding_sum, count(judge_id) as n from range(0, 5) r(k) left join lab on text + audio + visual + integration = k group by 1",
    "chat_rows": f"""with {LABELS_SQL} select doc_id, cast(3 as bigint) as turns, 'T: ' || d.text || chr(10) || 'E: ' || lang as "user",
 concat('{{"text":', lab.text, ',"audio":', audio, ',"visual":', visual, ',"integration":', integration, '}}') as target from lab join documents d on doc_id = judge_id""",
    "strict_label_json": _JSON,
    "exact_label_json": _JSON,
}
