"""Queries: row checks, media records, judge scores and verdicts, numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import judge_json, numeric
from tracewright.functions import text as tx
from tracewright.operators import metrics, validate
from tracewright.plans.traj import CLASSIFIED_SQL, tables, trajectories


def _documents(spark, sf_dir):
    tables(spark, sf_dir, "documents")
    return spark.table("documents")


def gold_labels(spark, sf_dir):
    spellings = ["1", "0", "Sarcasm", "non-sarcasm", "true", "NON_SARCASM", "1.0", "sarcastic"]
    d = _documents(spark, sf_dir)
    return d.select("doc_id", tx.gold_label(F.element_at(F.array(*[F.lit(s) for s in spellings]), (F.col("doc_id") % 8 + 1).cast("int"))).alias("gold"))


def media_checks(spark, sf_dir):
    k = F.col("doc_id")
    duration = F.when(k % 5 == 0, F.lit(float("nan"))).when(k % 5 == 1, F.lit(None).cast("double")).otherwise(k % 40 / F.lit(4.0) + 0.25)
    reason = validate.media_reason(duration, (k % 900).cast("int"), duration + F.when(k % 7 == 0, 1.0).otherwise(0.1), F.when(k % 11 == 0, "mp3").otherwise("pcm_s16le"), 768, 0.5, "pcm_s16le")
    return _documents(spark, sf_dir).groupBy(F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def length_guard(spark, sf_dir):
    d = _documents(spark, sf_dir).select("doc_id", F.coalesce(validate.length_reason(F.col("n_chars"), 512, 3000), F.lit("ok")).alias("reason"))
    return d.groupBy("reason").agg(F.count("*").alias("n"))


def media_fallback(spark, sf_dir):
    d = _documents(spark, sf_dir)
    own = F.when(F.col("doc_id") % 3 == 0, F.array("source")).when(F.col("doc_id") % 3 == 1, F.array().cast("array<string>"))
    other = F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(F.array(F.lit("")))
    return d.select("doc_id", validate.first_media(own, other).alias("media"))


def kept_and_rejected(spark, sf_dir):
    rows = validate.classify(trajectories(spark, sf_dir)).select("source_id", "raw_index", "reject_reason")
    out = metrics.id_lists(rows, "source_id", "raw_index", "raw_index")
    shown = F.transform(F.array_sort(F.map_entries("rejected")), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"]))
    return out.select("source_id", F.array_join(F.transform("kept", lambda x: x.cast("string")), ",").alias("kept"), F.coalesce(F.array_join(shown, ","), F.lit("")).alias("rejected"))


def invariants(spark, sf_dir):
    """How many rows break rules that hold by construction, and one that does not."""
    t = trajectories(spark, sf_dir)
    return validate.violations(t, {"has_source": F.col("source_id").isNotNull(), "gold_is_binary": F.col("gold").isin(0, 1), "has_score": F.col("score").isNotNull()}).select("rule", F.col("rows").alias("n"))


def quality_scores(spark, sf_dir):
    """Scores out of plain, thinking, fenced, aliased and broken answers."""
    k = F.col("doc_id")
    body = F.format_string('{"text":%d,"audio":%d,"visual":%d}', k % 3 + 1, k % 2 + 1, k % 3 + 1)
    raw = (
        F.when(k % 7 == 0, F.concat(F.lit("<think>hm</think> "), body))
        .when(k % 7 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(k % 7 == 2, F.regexp_replace(body, '":', '_evidence":'))
        .when(k % 7 == 3, F.concat(F.lit("<think>"), body))
        .when(k % 7 == 4, F.concat(body, F.lit(" so")))
        .when(k % 7 == 5, F.replace(body, F.lit('"text":'), F.lit('"text":7')))
        .otherwise(body)
    )
    d = _documents(spark, sf_dir).select("doc_id", judge_json.scores_udf()(raw).alias("s"))
    return d.select("doc_id", *[F.col(f"s.{c}").alias(c) for c in ("text", "audio", "visual", "mode", "error")])


def judge_verdicts(spark, sf_dir):
    """Verdicts out of JSON, literals, fences, malformed JSON, and answers that name an issue instead."""
    k = F.col("doc_id")
    raw = (
        F.when(k % 7 == 0, '{"verdict": "supported", "evidence": "e"}')
        .when(k % 7 == 1, "{'verdict': 'UNSUPPORTED', 'evidence': None, 'issue': 'MISATTRIBUTED'}")
        .when(k % 7 == 2, 'I say ```json\n{"verdict": "SUPPORTED"}\n```')
        .when(k % 7 == 3, '{"verdict": "UNSUPPORTED", "evidence": "a "b" c"}')
        .when(k % 7 == 4, '{"verdict": "HALLUCINATION"}')
        .when(k % 7 == 5, '{"issue": "NONE"}')
        .otherwise("cannot tell")
    )
    d = _documents(spark, sf_dir).select(judge_json.verdict_udf(drift=True)(raw).alias("v"))
    return d.groupBy(F.col("v.verdict").alias("verdict"), F.col("v.issue").alias("issue"), F.col("v.evidence").alias("evidence"), F.col("v.parse_ok").alias("parse_ok")).agg(F.count("*").alias("n"))


#: Verdicts in 6 x 4 x 3 x 2 x 3 shapes, by digits of the document's length: the word, quotes as in JSON or as in Python, what stands around, an issue, and evidence.
_VARIED = """
select doc_id, case p when 0 then body when 1 then concat('So:', chr(10), '```json', chr(10), body, chr(10), '```') else concat('Well. ', body, ' That is all.') end as raw from (
 select *, concat('{', qs, 'verdict', qs, ': ', qs, word, qs, case when i = 1 then concat(', ', qs, 'issue', qs, ': ', qs, 'hallucination ', qs) else '' end,
  case e when 1 then concat(', ', qs, 'evidence', qs, ': ', qs, source, ' in ', lang, qs) when 2 then concat(', ', qs, 'evidence', qs, case when q = 3 then ': None' else ': null' end) else '' end, '}') as body from (
 select doc_id, coalesce(source, 'none') as source, coalesce(lang, 'none') as lang, cast(floor(n_chars / 6) as bigint) % 4 as q, cast(floor(n_chars / 24) as bigint) % 3 as p,
  cast(floor(n_chars / 72) as bigint) % 2 as i, cast(floor(n_chars / 144) as bigint) % 3 as e, case when cast(floor(n_chars / 6) as bigint) % 4 = 3 then chr(39) else '"' end as qs,
  case n_chars % 6 when 0 then 'SUPPORTED' when 1 then 'supported' when 2 then ' Unsupported ' when 3 then 'UNSUPPORTED' when 4 then 'Maybe' else 'NONE' end as word from documents) a) b
"""


def varied_verdicts(spark, sf_dir):
    """Verdicts in hundreds of shapes, with names from their documents."""
    tables(spark, sf_dir, "documents")
    read = judge_json.verdict_udf(drift=True)(F.col("raw"))
    return spark.sql(_VARIED).select("doc_id", read.alias("v")).select("doc_id", "v.verdict", "v.issue", "v.evidence", "v.parse_ok")


def first_finite(spark, sf_dir):
    k = F.col("doc_id")
    a = F.when(k % 3 == 0, F.lit("NaN")).when(k % 3 == 1, F.lit("x")).otherwise((k % 10).cast("string"))
    b = F.when(k % 2 == 0, F.lit(float("inf"))).otherwise((k % 7).cast("double"))
    return _documents(spark, sf_dir).select("doc_id", numeric.first_finite(a, b, F.lit(-1.0)).alias("value"))


def progress(spark, sf_dir):
    p = numeric.progress(F.col("doc_id") % 50, F.lit(50), F.col("n_chars") % 1000)
    return _documents(spark, sf_dir).select("doc_id", p["percent"].alias("percent"), p["eta"].alias("eta"))


def payload_size(spark, sf_dir):
    d = _documents(spark, sf_dir)
    j = judge_json.payload_json(F.col("lang"), {f"{m}_evidence": F.col("source") for m in judge_json.MODALITIES})
    return d.select("doc_id", j.alias("payload"))


QUERIES = {
    f.__name__: f
    for f in (gold_labels, media_checks, length_guard, media_fallback, kept_and_rejected, invariants, quality_scores, judge_verdicts, varied_verdicts, first_finite, progress, payload_size)
}

_BAD = "doc_id % 7 in (3, 4, 5)"
ORACLES = {
    "gold_labels": "select doc_id, cast(case when doc_id % 8 in (0, 2, 4, 6, 7) then 1 else 0 end as integer) as gold from documents",
    "media_checks": """select case when doc_id % 5 < 2 then 'bad_duration' when doc_id % 900 > 768 then 'too_many_frames' when doc_id % 7 = 0 then 'durations_differ' when doc_id % 11 = 0 then 'bad_format' else 'ok' end as reason, count(*) as n from documents group by 1""",
    "length_guard": "select case when n_chars + 512 > 3000 then 'too_long' else 'ok' end as reason, count(*) as n from documents group by 1",
    "media_fallback": "select doc_id, case when doc_id % 3 = 0 then source when doc_id % 2 = 0 then lang end as media from documents",
    "kept_and_rejected": f"""with {CLASSIFIED_SQL} select source_id, coalesce(string_agg(cast(raw_index as varchar), ',' order by raw_index) filter (reject_reason is null), '') as kept,
 coalesce(string_agg(raw_index || '=' || reject_reason, ',' order by raw_index) filter (reject_reason is not null), '') as rejected from cl group by 1""",
    "invariants": "select 'has_source' as rule, cast(0 as bigint) as n union all select 'gold_is_binary', 0 union all select 'has_score', count(*) filter (doc_id % 31 = 0 or n_chars is null) from documents",
    "quality_scores": f"""select doc_id, cast(case when not {_BAD} then doc_id % 3 + 1 end as integer) as text, cast(case when not {_BAD} then doc_id % 2 + 1 end as integer) as audio, cast(case when not {_BAD} then doc_id % 3 + 1 end as integer) as visual,
 case doc_id % 7 when 0 then 'after_think' when 1 then 'json+fence' when 2 then 'json+evidence_keys' when 6 then 'json' end as mode,
 case doc_id % 7 when 3 then 'unfinished_thinking' when 4 then 'invalid_json' when 5 then 'invalid_text_value' end as error from documents""",
    "judge_verdicts": """with k as (select doc_id % 7 as k from documents) select case when k in (0, 2, 5) then 'SUPPORTED' when k in (1, 3, 4) then 'UNSUPPORTED' end as verdict,
 case k when 0 then 'NONE' when 1 then 'MISATTRIBUTION' when 2 then 'NONE' when 4 then 'HALLUCINATED_CUE' when 5 then 'NONE' end as issue, case when k = 0 then 'e' end as evidence, k <> 6 as parse_ok, count(*) as n from k group by all""",
    "varied_verdicts": """with k as (select doc_id, n_chars % 6 as w, n_chars // 72 % 2 = 1 as named, n_chars // 144 % 3 as e, coalesce(source, 'none') || ' in ' || coalesce(lang, 'none') as said from documents),
 v as (select *, case when w < 2 then 'SUPPORTED' when w < 5 or named then 'UNSUPPORTED' end as verdict from k)
 select doc_id, verdict, case when w = 4 then 'MAYBE' when named then 'HALLUCINATED_CUE' when verdict is not null then 'NONE' end as issue, case when verdict is not null and e = 1 then said end as evidence, verdict is not null as parse_ok from v""",
    "first_finite": "select doc_id, cast(case when doc_id % 3 = 2 then doc_id % 10 when doc_id % 2 = 1 then doc_id % 7 else -1 end as double) as value from documents",
    "progress": "select doc_id, cast(floor(doc_id % 50 * 100 / 50) as bigint) as percent, case when doc_id % 50 > 0 then cast(floor((50 - doc_id % 50) * (n_chars % 1000) / cast(doc_id % 50 as double)) as bigint) end as eta from documents",
    "payload_size": """select doc_id, concat('{"TRANSCRIPT":"', lang, '","CANDIDATE_SECTIONS":{"text":"', source, '","audio":"', source, '","visual":"', source, '"}}') as payload from documents""",
}
