"""Queries: metrics of predictions, components, agreement and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import text as tx
from tracewright.functions.judge_json import COMPONENTS
from tracewright.operators import metrics, validate
from tracewright.plans.traj import LABELS_SQL, PARSED_SQL, component_labels, tables, trajectories


def _rounded(df, places=6):
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _predictions(spark, sf_dir):
    return validate.parse_trajectories(trajectories(spark, sf_dir))


def binary_metrics(spark, sf_dir):
    return _rounded(metrics.binary_metrics(_predictions(spark, sf_dir)))


def teacher_metrics(spark, sf_dir):
    t = _predictions(spark, sf_dir).withColumn("tagged", tx.answer_label(F.col("response"), "tagged")).withColumn("complete", tx.is_complete(F.col("response")))
    return _rounded(metrics.teacher_metrics(t, "gold", "tagged"))


def _judged(spark, sf_dir):
    """Gold labels, and predictions that are off or missing for some rows."""
    lab = component_labels(spark, sf_dir)
    gold = lab.select("judge_id", *[F.col(c).alias(f"gold_{c}") for c in COMPONENTS])
    k = F.col("judge_id")
    off = {c: F.when(k % 7 == i, 1 - F.col(f"gold_{c}")).when(k % 19 == 0, F.lit(None).cast("int")).otherwise(F.col(f"gold_{c}")) for i, c in enumerate(COMPONENTS)}
    return gold.select("*", *[v.alias(f"pred_{c}") for c, v in off.items()])


def component_metrics(spark, sf_dir):
    out = metrics.component_metrics(_judged(spark, sf_dir), COMPONENTS)
    return _rounded(out.select("component", "total", "parsed", "tn", "fp", "fn", "tp", "invalid_neg", "invalid_pos", "f1_neg", "f1_pos", "macro_f1", "accuracy"))


def component_summary(spark, sf_dir):
    return _rounded(metrics.component_summary(_judged(spark, sf_dir), COMPONENTS))


def kappa(spark, sf_dir):
    rows = _judged(spark, sf_dir).select(F.col("gold_audio").alias("human"), F.col("pred_audio").alias("pred"))
    return _rounded(metrics.agreement(rows))


def hard_negatives(spark, sf_dir):
    rows = _judged(spark, sf_dir).select(F.col("gold_integration").alias("gold"), F.col("pred_integration").alias("pred"))
    return metrics.hard_negative_summary(rows)


def _pairs(spark, sf_dir):
    k = F.col("judge_id")
    a = [F.col(f"gold_{c}").alias(f"a_{c}") for c in COMPONENTS]
    b = [F.col(f"pred_{c}").alias(f"b_{c}") for c in COMPONENTS]
    return _judged(spark, sf_dir).select((k % 3 == 0).alias("a_right"), (k % 4 == 0).alias("b_right"), *a, *b)


def paired_summary(spark, sf_dir):
    return _rounded(metrics.paired_summary(_pairs(spark, sf_dir)), 9)


def win_tie_loss(spark, sf_dir):
    return metrics.paired_summary(_pairs(spark, sf_dir)).where("subset = 'all'").select("valid_pairs", "wins", "ties", "losses")


def _scores(spark, sf_dir):
    tables(spark, sf_dir, "documents", "labels")
    d = spark.table("documents").join(spark.table("labels"), "doc_id", "left")
    score = lambda m: (F.col("n_chars") % m % 3 + 1).cast("int")
    return d.select("quality", "toxic", score(7).alias("text"), score(11).alias("audio"), score(13).alias("visual"))


def score_stats(spark, sf_dir):
    return _rounded(metrics.score_stats(_scores(spark, sf_dir), ("text", "audio", "visual")))


def diagnostics(spark, sf_dir):
    return _rounded(metrics.diagnostics(_scores(spark, sf_dir), ("quality", "toxic", "absent"), ("text", "audio", "visual")))


def journal_summary(spark, sf_dir):
    tables(spark, sf_dir, "events")
    e = spark.table("events")
    rows = e.select(F.col("user_id").alias("judge_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 3 == 0).alias("ok"), (F.col("event_id") % 2 + 1).cast("int").alias("attempts"))
    return metrics.journal_summary(rows, 1_000_000)


def journal_latest(spark, sf_dir):
    tables(spark, sf_dir, "events")
    rows = spark.table("events").select(F.col("user_id").alias("judge_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 3 == 0).alias("ok"))
    return metrics.latest(rows, "judge_id", "seq", "ok")


def checkpoint_curve(spark, sf_dir):
    from tracewright.sources.io import checkpoint_curve as curve

    t = _predictions(spark, sf_dir).withColumns({"method": F.concat(F.lit("m"), (F.col("sample_idx") % 2).cast("string")), "step": (F.col("raw_index") % 5 * 100).cast("int")})
    m = metrics.binary_metrics(t, by=["method", "step"]).select("method", "step", F.round("macro_f1", 6).alias("macro_f1"))
    return curve(m).select("method", "step", "macro_f1", "best")


QUERIES = {
    f.__name__: f
    for f in (
        binary_metrics, teacher_metrics, component_metrics, component_summary, kappa, hard_negatives, paired_summary, win_tie_loss, score_stats, diagnostics,
        journal_summary, journal_latest, checkpoint_curve,
    )
}

_R = lambda n, d: f"case when {d} = 0 then 0.0 else cast({n} as double) / ({d}) end"
_CELLS = """count(*) as total, count(prediction) as parsed, count(*) filter (gold = 0 and prediction = 0) as tn, count(*) filter (gold = 0 and prediction = 1) as fp,
 count(*) filter (gold = 1 and prediction = 0) as fn, count(*) filter (gold = 1 and prediction = 1) as tp,
 count(*) filter (gold = 0 and prediction is null) as invalid_neg, count(*) filter (gold = 1 and prediction is null) as invalid_pos"""
_FULL = f"""total, parsed, tn as tp_neg, fn as fp_neg, fp + invalid_neg as fn_neg, tn + fp + invalid_neg as support_neg, tp as tp_pos, fp as fp_pos, fn + invalid_pos as fn_pos, tp + fn + invalid_pos as support_pos,
 tn, fp, fn, tp, invalid_neg, invalid_pos, {_R('tn', 'tn + fn')} as precision_neg, {_R('tn', 'tn + fp + invalid_neg')} as recall_neg, {_R('2 * tn', '2 * tn + fn + fp + invalid_neg')} as f1_neg,
 {_R('tp', 'tp + fp')} as precision_pos, {_R('tp', 'tp + fn + invalid_pos')} as recall_pos, {_R('2 * tp', '2 * tp + fp + fn + invalid_pos')} as f1_pos"""
_MACRO = """*, (precision_neg + precision_pos) / 2.0 as macro_precision, (recall_neg + recall_pos) / 2.0 as macro_recall, (f1_neg + f1_pos) / 2.0 as macro_f1,
 case when total = 0 then 0.0 else cast(tn + tp as double) / total end as accuracy, case when total = 0 then 0.0 else cast(parsed as double) / total end as parse_rate"""
_ROUND = "round(precision_neg, 6) as precision_neg, round(recall_neg, 6) as recall_neg, round(f1_neg, 6) as f1_neg, round(precision_pos, 6) as precision_pos, round(recall_pos, 6) as recall_pos, round(f1_pos, 6) as f1_pos"
_JUDGED = LABELS_SQL + ", judged as (select judge_id, " + ", ".join(
    f"{c} as gold_{c}, case when judge_id % 7 = {i} then 1 - {c} when judge_id % 19 = 0 then null else {c} end as pred_{c}" for i, c in enumerate(COMPONENTS)
) + " from lab)"
_LONG = "long as (" + " union all ".join(f"select '{c}' as component, gold_{c} as gold, pred_{c} as prediction from judged" for c in COMPONENTS) + ")"
_COMPONENTS = f"{_JUDGED}, {_LONG}, cells as (select component, {_CELLS} from long group by 1), f as (select component, {_FULL} from cells), cm as (select {_MACRO} from f)"
_AGREE = """n as (select count(*) as total, count(pred) as parsed, count(*) filter (human = 0 and pred = 0) as tn, count(*) filter (human = 0 and pred = 1) as fp,
 count(*) filter (human = 1 and pred = 0) as fn, count(*) filter (human = 1 and pred = 1) as tp from ag)"""
_VALID = " and ".join(f"a_{c} is not null and b_{c} is not null" for c in COMPONENTS)
_SUBSETS = f"""pairs as (select judge_id % 3 = 0 as ar, judge_id % 4 = 0 as br, {', '.join(f'gold_{c} as a_{c}, pred_{c} as b_{c}' for c in COMPONENTS)} from judged),
 sub as (select *, 'all' as subset from pairs union all select *, case when ar and br then 'both_right' when br then 'fixed' when ar then 'broken' else 'both_wrong' end from pairs),
 v as (select *, {_VALID} as valid, a_text + a_audio + a_visual as asum, b_text + b_audio + b_visual as bsum from sub)"""
_SUPPORT = ", ".join(f"avg({m}_{c}) filter (valid) as {m}_{c}_support" for m in "ab" for c in COMPONENTS)
_PAIRED = f"""ps as (select subset, count(*) as selected, count(*) filter (valid) as valid_pairs, {_SUPPORT}, avg(asum / 3.0::double) filter (valid) as a_evidence, avg(bsum / 3.0::double) filter (valid) as b_evidence,
 avg(cast(asum = 3 as integer)) filter (valid) as a_all_three, avg(cast(bsum = 3 as integer)) filter (valid) as b_all_three,
 count(*) filter (valid and bsum > asum) as wins, count(*) filter (valid and bsum = asum) as ties, count(*) filter (valid and bsum < asum) as losses from v group by 1)"""
_MEANS = [*[f"{c}_support" for c in COMPONENTS], "evidence", "all_three"]
_SCORES = "s as (select quality, toxic, cast(n_chars % 7 % 3 + 1 as integer) as text, cast(n_chars % 11 % 3 + 1 as integer) as audio, cast(n_chars % 13 % 3 + 1 as integer) as visual from documents left join labels using (doc_id))"
ORACLES = {
    "binary_metrics": f"""with {PARSED_SQL}, cells as (select {_CELLS} from parsed), f as (select {_FULL} from cells), m as (select {_MACRO} from f)
 select * exclude (precision_neg, recall_neg, f1_neg, precision_pos, recall_pos, f1_pos, macro_precision, macro_recall, macro_f1, accuracy, parse_rate), {_ROUND},
 round(macro_precision, 6) as macro_precision, round(macro_recall, 6) as macro_recall, round(macro_f1, 6) as macro_f1, round(accuracy, 6) as accuracy, round(parse_rate, 6) as parse_rate from m""",
    "teacher_metrics": f"""with {PARSED_SQL}, t as (select gold as g0, contains(response, '</text_evidence>') and contains(response, '</audio_evidence>') and contains(response, '</visual_evidence>') and contains(response, '</integration>') and contains(response, '</answer>') as complete,
 case lower(regexp_extract(response, '(?i)<answer>\\s*(Sarcasm|Non-Sarcasm)\\s*</answer>', 1)) when 'sarcasm' then 1 when 'non-sarcasm' then 0 end as p from parsed),
 c as (select count(*) as total, count(p) as parsed, count(*) filter (p is null) as parse_errors, count(*) filter (not complete) as incomplete, count(*) filter (g0 = p) as hits,
 count(*) filter (g0 = 0 and p = 0) as tn, count(*) filter (g0 = 0 and p = 1) as fp, count(*) filter (g0 = 1 and p = 0) as fn, count(*) filter (g0 = 1 and p = 1) as tp from t),
 f as (select total, parsed, parse_errors, incomplete, hits, tn as tp_neg, fn as fp_neg, fp as fn_neg, tn + fp as support_neg, tp as tp_pos, fp as fp_pos, fn as fn_pos, tp + fn as support_pos,
 {_R('tn', 'tn + fn')} as precision_neg, {_R('tn', 'tn + fp')} as recall_neg, {_R('2 * tn', '2 * tn + fn + fp')} as f1_neg, {_R('tp', 'tp + fp')} as precision_pos, {_R('tp', 'tp + fn')} as recall_pos, {_R('2 * tp', '2 * tp + fp + fn')} as f1_pos,
 {_R('hits', 'parsed')} as accuracy, tn + fn + fp > 0 as n0, tp + fp + fn > 0 as n1 from c)
 select total, parsed, parse_errors, incomplete, hits, tp_neg, fp_neg, fn_neg, support_neg, tp_pos, fp_pos, fn_pos, support_pos, {_ROUND}, round(accuracy, 6) as accuracy,
 round(case when n0 or n1 then (case when n0 then f1_neg else 0 end + case when n1 then f1_pos else 0 end) / (cast(n0 as integer) + cast(n1 as integer)) else 0.0 end, 6) as macro_f1 from f""",
    "component_metrics": f"with {_COMPONENTS} select component, total, parsed, tn, fp, fn, tp, invalid_neg, invalid_pos, round(f1_neg, 6) as f1_neg, round(f1_pos, 6) as f1_pos, round(macro_f1, 6) as macro_f1, round(accuracy, 6) as accuracy from cm",
    "component_summary": f"""with {_COMPONENTS}, x as (select count(*) as total, count(*) filter ({' and '.join(f'gold_{c} = pred_{c}' for c in COMPONENTS)}) as exact from judged),
 y as (select avg(accuracy) as a, avg(macro_f1) as b, avg(macro_f1) filter (component <> 'integration') as c from cm)
 select total, exact, round(cast(exact as double) / total, 6) as pattern_accuracy, round(a, 6) as mean_accuracy, round(b, 6) as mean_f1, round(c, 6) as evidence_macro_f1 from x, y""",
    "kappa": f"""with {_JUDGED}, ag as (select gold_audio as human, pred_audio as pred from judged), {_AGREE},
 k as (select *, cast(tn + tp as double) / parsed as po, ((tn + fp) * (tn + fn) + (tp + fn) * (tp + fp)) / (cast(parsed as double) * parsed) as pe, 2.0 * tn / (2 * tn + fn + fp) as f0, 2.0 * tp / (2 * tp + fn + fp) as f1 from n)
 select total, parsed, round(po, 6) as agreement, round((f0 + f1) / 2, 6) as macro_f1, round((po - pe) / (1 - pe), 6) as kappa from k""",
    "hard_negatives": f"with {_JUDGED} select count(*) as total, count(pred_integration) as parse_ok, count(*) filter (gold_integration = pred_integration) as correct, count(*) filter (gold_integration = 0) as negatives, count(*) filter (gold_integration = 0 and pred_integration = 0) as detected from judged",
    "paired_summary": f"with {_JUDGED}, {_SUBSETS}, {_PAIRED} select subset, selected, valid_pairs, wins, ties, losses, "
    + ", ".join(f"round({m}_{c}, 9) as {m}_{c}" for m in "ab" for c in _MEANS)
    + ", "
    + ", ".join(f"round(b_{c} - a_{c}, 9) + 0.0::double as delta_{c}" for c in _MEANS)
    + " from ps",
    "win_tie_loss": f"with {_JUDGED}, {_SUBSETS}, {_PAIRED} select valid_pairs, wins, ties, losses from ps where subset = 'all'",
    "score_stats": f"""with {_SCORES}, l as (select 'text' as modality, text as v from s union all select 'audio', audio from s union all select 'visual', visual from s)
 select modality, count(*) filter (v = 1) as n_1, count(*) filter (v = 2) as n_2, count(*) filter (v = 3) as n_3, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, round(avg((v - 1) / 2.0::double), 6) as mean_reward from l group by 1""",
    "diagnostics": f"""with {_SCORES}, l as (select 'quality' as field, cast(quality as varchar) as value, text, audio, visual from s union all select 'toxic', cast(toxic as varchar), text, audio, visual from s)
 select field, value, count(*) as n, round(avg(text), 6) as mean_text, round(avg(audio), 6) as mean_audio, round(avg(visual), 6) as mean_visual from l where value is not null group by 1, 2""",
    "journal_summary": """with p as (select user_id, max(cast(event_id % 3 = 0 as integer)) as done, max(event_id % 2 + 1) filter (event_id % 3 = 0) as tries from events group by 1),
 s as (select count(*) filter (done = 1) as succeeded, count(*) filter (done = 0) as failed, count(*) filter (done = 1 and tries > 1) as retry_recovered from p)
 select *, 1000000 - succeeded - failed as pending from s""",
    "journal_latest": "select user_id as judge_id, event_id as seq, event_id % 3 = 0 as ok from events qualify row_number() over (partition by user_id order by cast(event_id % 3 = 0 as integer) desc, event_id desc) = 1",
    "checkpoint_curve": f"""with {PARSED_SQL}, cells as (select 'm' || sample_idx % 2 as method, cast(raw_index % 5 * 100 as integer) as step, {_CELLS} from parsed group by 1, 2),
 f as (select method, step, {_FULL} from cells), m as (select method, step, round((f1_neg + f1_pos) / 2.0, 6) as macro_f1 from f)
 select *, row_number() over (partition by method order by macro_f1 desc, step) = 1 as best from m""",
}
