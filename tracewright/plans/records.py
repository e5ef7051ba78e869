"""Queries: loosely shaped records, transcripts in all their forms, judge pools, label problems, training rows with their audit columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import records
from tracewright.functions import text as tx
from tracewright.functions.judge_json import COMPONENTS
from tracewright.operators import labels, metrics, rewards, select, validate
from tracewright.plans.traj import CLASSIFIED_SQL, LABELS_SQL, PARSED_SQL, TRAJ_SQL, component_labels, tables, trajectories

#: A record for each document, in one of twelve shapes; ``{t}`` is its text as JSON.
_RECORDS = """
select doc_id, text, case doc_id % 12
  when 0 then concat('{{"source_id": "s', doc_id, '", "response": ', {t}, ', "finish_reason": "stop", "label": 1}}')
  when 1 then concat('{{"id": ', doc_id, ', "response": "  ", "generated_text": ', {t}, ', "gold_label": "Non-Sarcastic", "sample_idx": 3}}')
  when 2 then concat('{{"example_id": "e', doc_id, '", "completion": {{"content": "", "text": ', {t}, '}}, "target": true, "sample_idx": null, "generation_idx": 4}}')
  when 3 then concat('{{"uid": 7, "messages": [{{"role": "assistant", "content": "first"}}, {{"role": "user", "content": "q"}}, {{"role": "assistant", "content": ', {t}, '}}, {{"role": "assistant", "content": " "}}], "y": 0.0}}')
  when 4 then concat('{{"utterance_id": "u", "messages": [{{"role": "assistant", "content": [{{"type": "text", "text": ', {t}, '}}, {{"type": "image"}}, "end"]}}], "label": "sarcasm"}}')
  when 5 then concat('{{"source_id": "c", "choices": [{{"message": {{"content": ', {t}, '}}, "finish_reason": " STOP "}}], "label": "0"}}')
  when 6 then concat('{{"source_id": "c", "choices": [{{"text": ', {t}, ', "finish_reason": "length"}}], "label": 0, "mean_logprob": "x"}}')
  when 7 then concat('{{"source_id": "c", "response": null, "output": ', {t}, ', "finish_reason": "eos", "label": 1, "mean_token_logprob": null, "avg_logprob": -0.25}}')
  when 8 then concat('{{"source_id": "c", "stop_reason": "EOS_token", "assistant_response": ', {t}, ', "label": 1, "mean_logp": "-1.5"}}')
  when 9 then '{{"source_id": "c", "finish_reason": null, "stop_reason": "max_tokens", "label": 1}}'
  when 10 then '{{"source_id": "c", "response": {{"other": 1}}, "messages": [{{"role": "assistant", "content": "   "}}], "label": 1}}'
  else concat('{{"source_id": 12, "prediction_text": ', {t}, ', "label": 0, "trajectory_idx": "t"}}') end as record
from documents
"""
_SPARK_JSON = "substr(to_json(named_struct('t', text)), 6, length(to_json(named_struct('t', text))) - 6)"


def _records(spark, sf_dir):
    tables(spark, sf_dir, "documents")
    return spark.sql(_RECORDS.format(t=_SPARK_JSON)).select("doc_id", "text", F.parse_json("record").alias("r"))


def response_resolution(spark, sf_dir):
    return _records(spark, sf_dir).select("doc_id", records.response(F.col("r")).alias("response"))


def alias_fields(spark, sf_dir):
    r = F.col("r")
    out = _records(spark, sf_dir).select(
        "doc_id",
        records.required_alias(r, "source_id").alias("source_id"),
        records.alias(r, "sample_idx").alias("sample_idx"),
        records.gold(r).alias("gold"),
        records.logprob(r).alias("logprob"),
        records.finish_reason(r).alias("finish"),
    )
    return out.withColumn("finish_ok", validate.finished(F.col("finish"), lenient=True))


def sampled_sources(spark, sf_dir):
    tables(spark, sf_dir, "documents")
    record = F.expr("""case doc_id % 5 when 0 then concat('{"source_id": " s', doc_id, ' ", "id": "x"}')
      when 1 then concat('{"source_id": "", "id": "', md5(cast(doc_id as string)), '", "videos": ["https://h/v.mp4", {"path": "/m/v', doc_id, '.x.mp4"}]}')
      when 2 then concat('{"id": ', doc_id, ', "videos": "/m/other.mp4"}')
      when 3 then concat('{"videos": {"path": "data:video/mp4;base64,AA"}, "audios": "a', doc_id, '.wav"}')
      else concat('{"id": null, "videos": [], "audios": ["/m/.w', doc_id, '"]}') end""")
    return spark.table("documents").select("doc_id", records.sampled_source_id(F.parse_json(record)).alias("source_id"))


#: A message with the document's text as a transcript, in one of eight forms.
_MESSAGES = """
select doc_id, case doc_id % 8
  when 0 then concat('Judge.', chr(10), '<transcript>', chr(10), text, chr(10), '</transcript>', chr(10), 'Answer.')
  when 1 then concat('Judge.', chr(10), 'Transcript: "', text, '"', chr(10), 'Answer.')
  when 2 then concat('TRANSCRIPT : “', text, '” and so on')
  when 3 then concat('Transcript:', chr(10), text, chr(10), chr(10), 'Answer.')
  when 4 then concat('transcript: ', text)
  when 5 then concat('Utterance: “', text, '”')
  when 6 then concat('Utterance:', chr(10), '  ', text, chr(10), ' ', chr(10), 'Answer.')
  else concat('Text: ', text) end as m
from documents
"""


def transcript_extract(spark, sf_dir):
    tables(spark, sf_dir, "documents")
    m = spark.sql(_MESSAGES)
    direct = F.when(F.col("doc_id") % 16 == 3, F.lit("  given ")).when(F.col("doc_id") % 16 == 11, F.lit(" "))
    return m.select("doc_id", tx.transcript_line(F.col("m")).alias("line"), tx.transcript(F.col("m"), direct).alias("cascade"))


def pool_reasons(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    response = F.when(F.col("raw_index") % 3 > 0, F.replace(F.replace("response", F.lit("<ANSWER>"), F.lit("<answer>")), F.lit("</ANSWER>"), F.lit("</answer>"))).when(F.col("raw_index") % 9 > 0, F.col("response"))
    reason = F.coalesce(validate.pool_reason(F.col("finish_reason"), response), F.lit("ok"))
    return t.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def label_problems(spark, sf_dir):
    tables(spark, sf_dir, "documents")
    pool = spark.table("documents").select(F.col("doc_id").alias("judge_id")).where("doc_id % 11 <> 0")
    lab = component_labels(spark, sf_dir)
    long = lab.select("judge_id", F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("grounded")) for c in COMPONENTS])).alias("x")).select("judge_id", "x.*")
    long = long.where("judge_id % 7 <> 0 or component <> 'audio'")
    return labels.label_problems(pool, long.unionByName(long.where("judge_id % 13 = 0 and component = 'text'")))


def cluster_sample_by_split(spark, sf_dir):
    t = trajectories(spark, sf_dir).select("raw_index", "source_id", F.when(F.col("sample_idx") < 4, "a").otherwise("b").alias("split"))
    return select.cluster_sample(t, ["split", "source_id"], "raw_index", 9, 2)


def sft_audit(spark, sf_dir):
    usable = validate.classify(trajectories(spark, sf_dir)).where(F.col("reject_reason").isNull())
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    rows = usable.withColumns(
        {
            "messages": F.array(turn("user", F.lit("q")), turn("assistant", F.col("response"))),
            "label": F.col("gold"),
            "mean_token_logprob": F.col("score"),
            "videos": F.when(F.col("raw_index") % 2 == 0, F.array(F.lit("v.mp4"))).otherwise(F.array().cast("array<string>")),
        }
    )
    out = validate.sft_rows(rows, "best_of_8")
    return out.select(
        "source_id", "label", "teacher_sample_idx", "teacher_mean_token_logprob", "sft_variant", F.array_join("videos", ",").alias("videos"), F.col("messages")[1]["content"].alias("target"), F.size("messages").cast("long").alias("turns")
    )


def reward_plugins(spark, sf_dir):
    rows = validate.parse_trajectories(trajectories(spark, sf_dir))
    return rewards.rewarded(rows, ["accuracy", "format"]).select("raw_index", "accuracy", "format")


def distinct_ids(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    return metrics.distinct_counts(t, ["raw_index", "source_id", "finish_reason"])


def required_fields(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    blank = t.withColumn("finish_reason", F.when(F.col("raw_index") % 5 == 0, F.lit(" \t")).otherwise(F.col("finish_reason")))
    return validate.violations(blank, validate.filled(["source_id", "finish_reason", "score"])).select("rule", F.col("rows").alias("n"))


def gold_join(spark, sf_dir):
    """Every document's label, for those that have one; the others are not asked for."""
    from tracewright.operators import joins

    tables(spark, sf_dir, "documents", "labels")
    known = spark.table("documents").join(spark.table("labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang")
    return joins.lookup(known, spark.table("labels"), "doc_id", required=True).select("doc_id", "lang", "quality")


QUERIES = {
    f.__name__: f
    for f in (response_resolution, alias_fields, sampled_sources, transcript_extract, pool_reasons, label_problems, cluster_sample_by_split, sft_audit, reward_plugins, distinct_ids, required_fields, gold_join)
}

_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_COUNTS = ", ".join(
    f"(length(r) - length(replace(r, '<{s}>', ''))) // {len(s) + 2} as o_{s}, (length(r) - length(replace(r, '</{s}>', ''))) // {len(s) + 3} as c_{s}" for s in tx.SECTIONS
)
_STRICT = " ".join(
    f"when o_{s} <> 1 then 'malformed::{s}_open_count_' || o_{s} when c_{s} <> 1 then 'malformed::{s}_close_count_' || c_{s}"
    f" when not regexp_matches(r, '(?s)<{s}>.*?</{s}>') then 'malformed::{s}_not_parseable' when {_STRIP(f'''regexp_extract(r, '(?s)<{s}>(.*?)</{s}>', 1)''')} = '' then 'malformed::{s}_empty'"
    for s in tx.SECTIONS
)
_WORDS = "trim(regexp_replace(replace(replace(lower(regexp_extract(r, '(?s)<answer>(.*?)</answer>', 1)), '_', ' '), '-', ' '), '\\s+', ' ', 'g'))"
_QUOTED = [p.replace("'", "''") for p in tx.TRANSCRIPTS]
_CASCADE = ", ".join(f"nullif({_STRIP(f'''regexp_extract(m, '(?is){p}', 1)''')}, '')" for p in _QUOTED)
ORACLES = {
    "response_resolution": f"""select doc_id, case when doc_id % 12 in (9, 10) then null when doc_id % 12 = 4 then nullif({_STRIP("text || chr(10) || 'end'")}, '')
 else nullif({_STRIP('text')}, '') end as response from documents""",
    "alias_fields": """select doc_id, case doc_id % 12 when 0 then 's' || doc_id when 1 then cast(doc_id as varchar) when 2 then 'e' || doc_id when 3 then '7' when 4 then 'u' when 11 then '12' else 'c' end as source_id,
 case doc_id % 12 when 1 then '3' when 2 then '4' when 11 then 't' end as sample_idx, case when doc_id % 12 in (1, 3, 5, 6, 11) then 0 else 1 end as gold,
 case doc_id % 12 when 7 then -0.25::double when 8 then -1.5::double end as logprob,
 case doc_id % 12 when 0 then 'stop' when 5 then 'stop' when 6 then 'length' when 7 then 'eos' when 8 then 'eos_token' when 9 then 'max_tokens' end as finish, doc_id % 12 not in (6, 9) as finish_ok from documents""",
    "sampled_sources": """select doc_id, case doc_id % 5 when 0 then 's' || doc_id when 1 then 'v' || doc_id || '.x' when 2 then cast(doc_id as varchar) when 3 then 'a' || doc_id else '.w' || doc_id end as source_id from documents""",
    "transcript_extract": f"""with m as ({_MESSAGES}) select doc_id,
 nullif({_STRIP('''regexp_extract(m, '(?is)(?:transcript|utterance|text)\\s*:\\s*["'']?(.+?)["'']?(?:\\n|\\z)', 1)''')}, '') as line,
 coalesce(case when doc_id % 16 = 3 then 'given' end, {_CASCADE}) as cascade from m""",
    "pool_reasons": f"""with {TRAJ_SQL}, f as (select finish_reason, case when raw_index % 3 > 0 then replace(replace(response, '<ANSWER>', '<answer>'), '</ANSWER>', '</answer>') when raw_index % 9 > 0 then response end as r from traj),
 c as (select *, {_COUNTS} from f)
 select case when finish_reason is not null and lower(trim(finish_reason)) not in ('stop', 'eos', 'eos_token') then 'finish_reason' when coalesce({_STRIP('r')}, '') = '' then 'missing_trajectory' {_STRICT}
  when {_WORDS} not in ('sarcasm', 'non sarcasm', 'nonsarcasm') then 'invalid_answer' else 'ok' end as reason, count(*) as n from c group by 1""",
    "label_problems": f"""with {LABELS_SQL}, c as (select judge_id, unnest(['text', 'audio', 'visual', 'integration']) as component from lab), p as (select *, judge_id % 11 <> 0 as wanted, judge_id % 7 = 0 and component = 'audio' as gone from c)
 select cast(judge_id as varchar) as judge_id, component, case when wanted and gone then 'missing' when not wanted then 'extra' else 'repeated' end as problem
 from p where wanted and gone or not wanted and not gone or judge_id % 13 = 0 and component = 'text' and not gone""",
    "cluster_sample_by_split": f"""with {TRAJ_SQL}, t as (select raw_index, source_id, case when sample_idx < 4 then 'a' else 'b' end as split from traj),
 c as (select distinct split, source_id from t order by md5(split || ':' || source_id || ':42'), split, source_id limit 9)
 select raw_index, source_id, split from t where (split, source_id) in (select (split, source_id) from c) qualify row_number() over (partition by split, source_id order by md5(raw_index || ':42'), raw_index) <= 2""",
    "sft_audit": f"""with {CLASSIFIED_SQL} select source_id, cast(gold as integer) as label, sample_idx as teacher_sample_idx, score as teacher_mean_token_logprob, 'best_of_8' as sft_variant,
 case when raw_index % 2 = 0 then 'v.mp4' end as videos, target, cast(2 as bigint) as turns from usable""",
    "reward_plugins": f"""with {PARSED_SQL}, x as (select *, lower(answer) as a from parsed) select raw_index,
 case when (a = 'sarcasm' and gold = 1) or (a = 'non-sarcasm' and gold = 0) then 1.0::double else 0.0::double end as accuracy,
 case when text_evidence is not null and audio_evidence is not null and visual_evidence is not null and integration is not null and a in ('sarcasm', 'non-sarcasm') then 1.0::double else 0.0::double end as format from x""",
    "distinct_ids": f"""with {TRAJ_SQL} select 'raw_index' as "column", count(*) as "rows", count(raw_index) as known, count(distinct raw_index) as different from traj
 union all select 'source_id', count(*), count(source_id), count(distinct source_id) from traj union all select 'finish_reason', count(*), count(finish_reason), count(distinct finish_reason) from traj""",
    "required_fields": f"""with {TRAJ_SQL} select 'has_source_id' as rule, cast(0 as bigint) as n union all select 'has_finish_reason', count(*) filter (raw_index % 5 = 0 or finish_reason is null) from traj
 union all select 'has_score', count(*) filter (score is null) from traj""",
    "gold_join": "select doc_id, lang, quality from documents join labels using (doc_id)",
}
