"""Queries: rewards and group trust."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.functions.numeric import grounding, linear_factor, linear_factor_col, phase
from tracewright.operators import rewards, validate
from tracewright.plans.traj import CLASSIFIED_SQL, LABELS_SQL, component_labels, tables, trajectories


def _rows(spark, sf_dir):
    """Parsed trajectories with the raw grounding score of their judge."""
    t = validate.parse_trajectories(trajectories(spark, sf_dir))
    raw = component_labels(spark, sf_dir).select("judge_id", grounding(F.col("text"), F.col("audio"), F.col("visual")).alias("raw"))
    return t.join(raw, t["raw_index"] == raw["judge_id"])


def reward_accuracy(spark, sf_dir):
    return _rows(spark, sf_dir).select("raw_index", rewards.accuracy_reward(F.col("parsed"), F.col("gold")).alias("reward"))


def reward_format(spark, sf_dir):
    return _rows(spark, sf_dir).select("raw_index", rewards.format_reward(F.col("parsed")).alias("reward"))


def _gated():
    return rewards.gated_reward(F.col("parsed"), F.col("gold"), F.col("raw"))


def reward_gated(spark, sf_dir):
    return _rows(spark, sf_dir).select("raw_index", F.round(_gated(), 6).alias("reward"))


def reward_linear(spark, sf_dir):
    return _rows(spark, sf_dir).select("raw_index", F.round(rewards.scheduled_reward(_gated(), 200, 841), 6).alias("reward"))


def reward_total(spark, sf_dir):
    total = rewards.total_reward(rewards.accuracy_reward(F.col("parsed"), F.col("gold")), rewards.format_reward(F.col("parsed")), _gated())
    return _rows(spark, sf_dir).select("raw_index", F.round(total, 6).alias("reward"))


def _groups(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    correct = rewards.accuracy_reward(F.col("parsed"), F.col("gold")) == 1.0
    from tracewright.functions.text import reasoning

    scorable = F.when(reasoning(F.col("parsed")).isNotNull(), F.col("raw"))
    return rows.select("raw_index", F.floor(F.col("raw_index") / 8).alias("group_id"), correct.alias("correct"), scorable.alias("raw"))


def reward_trust(spark, sf_dir):
    out = rewards.trust_reward(_groups(spark, sf_dir), linear_factor(300, 841, 0.1, 0.4), margin=1e-9)
    return out.select("raw_index", "group_type", F.round("trust_reward", 6).alias("reward"))


def trust_stats(spark, sf_dir):
    out = rewards.trust_stats(rewards.trust_groups(_groups(spark, sf_dir), margin=1e-9))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def schedule(spark, sf_dir):
    """Each user's events as the steps of a run: its factor by the step's share of the run, and the steps that are logged."""
    tables(spark, sf_dir, "events")
    run = Window.partitionBy("user_id")
    steps = spark.table("events").select("user_id", (F.row_number().over(run.orderBy("event_id")) - 1).alias("step"), F.count("*").over(run).alias("total"))
    factor = linear_factor_col(F.col("step"), F.col("total"), 0.1, 0.4)
    out = steps.select("user_id", "step", F.round(factor, 6).alias("factor"), phase(factor).alias("phase"))
    return rewards.logged_steps(out, 25, "user_id")


def reward_inputs(spark, sf_dir):
    """What inputs lack, where transcripts, audio and video names are missing or blank in some."""
    tables(spark, sf_dir, "documents")
    k = F.col("doc_id")
    transcript = F.when(k % 7 == 0, F.lit(" \u3000")).when(k % 11 != 0, F.col("text"))
    audio = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 == 1, F.array(F.lit(""))).otherwise(F.array("source"))
    video = F.when(k % 3 > 0, F.array("lang"))
    return spark.table("documents").select("doc_id", rewards.input_error(transcript, audio, video).alias("error"))


QUERIES = {f.__name__: f for f in (reward_accuracy, reward_format, reward_gated, reward_linear, reward_total, reward_trust, trust_stats, schedule, reward_inputs)}

_ROWS = f"""{CLASSIFIED_SQL}, {LABELS_SQL}, rw as (select raw_index, gold, reasoning, (lab.text + audio + visual) / 3.0::double as raw,
 case when lower(answer) = 'sarcasm' and gold = 1 or lower(answer) = 'non-sarcasm' and gold = 0 then 1.0::double else 0.0::double end as acc,
 case when reasoning is not null and lower(answer) in ('sarcasm', 'non-sarcasm') then 1.0::double else 0.0::double end as fmt from cl join lab on judge_id = raw_index),
 g as (select *, case when acc = 1 and reasoning is not null then raw else 0.0::double end as gated from rw)"""
_TRUST = f"""{_ROWS}, h as (select raw_index, cast(floor(raw_index / 8) as bigint) as group_id, acc = 1 as ok, case when reasoning is not null then raw end as raw from g),
 w as (select group_id, count(*) as n, count(*) filter (ok) as k, avg(raw) filter (ok) - avg(raw) filter (not ok) as d from h group by 1),
 t as (select group_id, case when k > 0 and k < n then d end as delta, case when k = 0 then 'all_wrong' when k = n then 'all_correct' when d is null then 'unscorable' when d > 1e-9::double then 'trusted' else 'untrusted' end as group_type from w)"""
_FACTOR = "((300 / 841.0::double - 0.1::double) / (0.4::double - 0.1::double))"
ORACLES = {
    "reward_accuracy": f"with {_ROWS} select raw_index, acc as reward from g",
    "reward_format": f"with {_ROWS} select raw_index, fmt as reward from g",
    "reward_gated": f"with {_ROWS} select raw_index, round(gated, 6) as reward from g",
    "reward_linear": f"with {_ROWS} select raw_index, round(gated * ((200 / 841.0::double - 0.1::double) / (0.4::double - 0.1::double)), 6) as reward from g",
    "reward_total": f"with {_ROWS} select raw_index, round(acc * 1.0::double + fmt * 0.2::double + gated * 0.2::double, 6) as reward from g",
    "reward_trust": f"with {_TRUST} select raw_index, group_type, round(case when group_type = 'trusted' and ok and raw is not null then raw * {_FACTOR} else 0.0::double end, 6) as reward from h join t using (group_id)",
    "trust_stats": f"""with {_TRUST} select count(*) as groups, count(*) filter (group_type = 'all_wrong') as n_all_wrong, count(*) filter (group_type = 'all_correct') as n_all_correct,
 count(*) filter (group_type = 'trusted') as n_trusted, count(*) filter (group_type = 'untrusted') as n_untrusted, count(*) filter (group_type = 'unscorable') as n_unscorable,
 round(count(*) filter (group_type = 'trusted') / cast(count(*) as double), 6) as trusted_rate, round(min(delta), 6) as min_delta, round(avg(delta), 6) as mean_delta, round(max(delta), 6) as max_delta from t""",
    "schedule": """with e as (select user_id, cast(row_number() over (partition by user_id order by event_id) - 1 as integer) as step, count(*) over (partition by user_id) as total from events),
 s as (select user_id, step, greatest(0.0::double, least(1.0::double, (step / total::double - 0.1::double) / (0.4::double - 0.1::double))) as f from e),
 p as (select user_id, step, round(f, 6) as factor, case when f = 0 then 'zero' when f = 1 then 'full' else 'ramp' end as phase from s)
 select * from p qualify lag(phase) over (partition by user_id order by step) is distinct from phase or step % 25 = 0""",
    "reward_inputs": """select doc_id, case when doc_id % 7 = 0 or doc_id % 11 = 0 or trim(text) = '' then 'missing_transcript' when doc_id % 5 < 2 then 'missing_audio' when doc_id % 3 = 0 then 'missing_video' end as error from documents""",
}
