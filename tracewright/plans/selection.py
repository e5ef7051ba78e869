"""Queries: rejecting, selecting, joining and sampling trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import text as tx
from tracewright.operators import joins, metrics, packing, select, validate
from tracewright.plans.traj import CLASSIFIED_SQL, TRAJ_SQL, component_labels, tables, trajectories
from tracewright.sources.chunks import chunk_ids


def _classified(spark, sf_dir):
    return validate.classify(trajectories(spark, sf_dir))


def _usable(spark, sf_dir):
    return _classified(spark, sf_dir).where(F.col("reject_reason").isNull())


def reject_reason_counts(spark, sf_dir):
    rows = _classified(spark, sf_dir).withColumn("reason", F.coalesce("reject_reason", F.lit("accepted")))
    return metrics.counts(rows, "reason")


def best_of_n(spark, sf_dir):
    return select.best_of_n(_usable(spark, sf_dir), strict=False).select("source_id", "raw_index", "sample_idx", "score", "target")


def diverse_n(spark, sf_dir):
    return select.diverse_n(_usable(spark, sf_dir)).select("source_id", "raw_index", "sample_idx", "target")


def sft_variants(spark, sf_dir):
    usable = _usable(spark, sf_dir)
    best, diverse = select.best_of_n(usable, strict=False), select.diverse_n(usable)
    parts = [rows.select("source_id", "raw_index", "target", F.lit(n).alias("sft_variant")) for n, rows in (("best_8", best), ("diverse_8", diverse))]
    return parts[0].unionByName(parts[1])


def candidates_per_source(spark, sf_dir):
    return metrics.group_size_stats(_usable(spark, sf_dir), "source_id").withColumn("mean_rows", F.round("mean_rows", 6))


def sources_without_candidate(spark, sf_dir):
    return metrics.without_survivor(_classified(spark, sf_dir), "source_id", F.col("reject_reason").isNull())


def retention(spark, sf_dir):
    from tracewright.functions.numeric import ratio

    kept = F.count_if(F.col("reject_reason").isNull())
    return _classified(spark, sf_dir).agg(F.count("*").alias("total"), kept.alias("kept"), F.round(ratio(kept, F.count("*")), 6).alias("retention"))


def finish_reason_filter(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    fr = F.col("finish_reason")
    return t.select("raw_index", validate.finished(fr).alias("strict_ok"), validate.finished(fr, lenient=True).alias("lenient_ok"))


def judge_pool(spark, sf_dir):
    kept = _classified(spark, sf_dir).where(F.col("reject_reason").isNull() | (F.col("reject_reason") == "wrong_prediction"))
    return kept.select(
        tx.judge_key(F.lit("train"), F.col("source_id"), F.col("sample_idx"), F.col("raw_index")).alias("judge_id"),
        "source_id",
        "gold",
        F.col("prediction").alias("pred"),
        (F.col("prediction") == F.col("gold")).alias("prediction_correct"),
        F.col("parsed.text_evidence").alias("text_evidence"),
        F.col("parsed.integration").alias("integration"),
    )


def ordinal_ids(spark, sf_dir):
    kept = _usable(spark, sf_dir).select("raw_index", "source_id")
    return validate.with_ordinal(kept, ["raw_index"], "judge_id").withColumn("judge_id", F.col("judge_id").cast("long"))


def left_join_reject(spark, sf_dir):
    tables(spark, sf_dir, "documents", "labels")
    out = joins.lookup(spark.table("documents").select("doc_id"), spark.table("labels"), "doc_id")
    return out.groupBy("found").agg(F.count("*").alias("n"))


def coverage_missing(spark, sf_dir):
    tables(spark, sf_dir, "documents", "labels")
    return joins.coverage(spark.table("documents"), spark.table("labels"), "doc_id")


def resume_anti(spark, sf_dir):
    tables(spark, sf_dir, "documents", "labels")
    return joins.pending(spark.table("documents").select("doc_id", "lang"), spark.table("labels"), "doc_id")


def last_wins(spark, sf_dir):
    tables(spark, sf_dir, "events")
    return joins.last_wins(spark.table("events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


def align_positional(spark, sf_dir):
    t = trajectories(spark, sf_dir).select(F.lit("same").alias("source_id"), F.col("raw_index").alias("row_index"), "gold")
    p = trajectories(spark, sf_dir).select(F.lit("same").alias("source_id"), F.col("raw_index").alias("row_index"), "sample_idx")
    out, how = joins.align(t, p)
    return out.select("row_index", "gold", F.col("p_sample_idx").alias("sample_idx"), F.lit(how).alias("paired_by"))


def align_by_key(spark, sf_dir):
    tables(spark, sf_dir, "labels")
    a = spark.table("labels").select(F.col("doc_id").alias("source_id"), "quality", F.col("doc_id").alias("row_index"))
    b = spark.table("labels").select(F.col("doc_id").alias("source_id"), "toxic", (-F.col("doc_id")).alias("row_index"))
    out, how = joins.align(a, b)
    return out.select("source_id", "quality", F.col("p_toxic").alias("toxic"), F.lit(how).alias("paired_by"))


def paired_join(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    a = t.where("sample_idx = 0").select("source_id", F.col("score").alias("a_score"))
    b = t.where("sample_idx = 1").select("source_id", F.col("score").alias("b_score"))
    gold = t.groupBy("source_id").agg(F.min("gold").alias("gold"))
    return gold.join(a, "source_id").join(b, "source_id")


def listed_rows(spark, sf_dir):
    tables(spark, sf_dir, "documents")
    return joins.listed(spark.table("documents").select("doc_id", "lang"), "doc_id", [17, 3, 11, 5, 0])


def dereference(spark, sf_dir):
    t = trajectories(spark, sf_dir).select("raw_index", "source_id", "sample_idx", "score")
    refs = component_labels(spark, sf_dir).where("integration = 0").select(F.col("judge_id").alias("raw_index"), F.floor(F.col("judge_id") / 8).cast("string").alias("source_id"), (F.col("judge_id") % 8).alias("sample_idx"))
    return joins.dereference(refs, t).select("raw_index", "source_id", F.col("raw_score").alias("score"))


def fixed_groups(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    n = 8
    # The last group is short where the number of documents is no multiple of n.
    out = select.fixed_groups(t.select("raw_index", "source_id", "gold"), "raw_index", n, ["source_id", "gold"], strict=False)
    return out.groupBy("group_id").agg(F.count("*").alias("n"), F.min("gold").alias("gold"))


def first_seen(spark, sf_dir):
    tables(spark, sf_dir, "documents")
    out = select.first_seen(spark.table("documents").select("doc_id", "source"), "source", "doc_id")
    return out.select("doc_id", "source", "group_order")


def packed_batches(spark, sf_dir):
    tables(spark, sf_dir, "documents")
    sizes = spark.table("documents").groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("o"))
    return packing.pack_groups(sizes, ["o"], "n", 64).select("source", "batch")


def packed_conversations(spark, sf_dir):
    """Whole conversations in calls of 24 turns, as a judge gets them."""
    tables(spark, sf_dir, "conversations")
    rows = spark.table("conversations").select("conv_id", "turn", (F.col("conv_id") * 10_000 + F.col("turn")).alias("row_index"))
    return packing.pack_rows(rows, "conv_id", "row_index", 24).select("conv_id", "turn", "batch")


def balanced_sample(spark, sf_dir):
    t = trajectories(spark, sf_dir).select("raw_index", "gold")
    return select.balanced_sample(t, "gold", "raw_index", 20)


def cluster_sample(spark, sf_dir):
    t = trajectories(spark, sf_dir).select("raw_index", "source_id")
    return select.cluster_sample(t, "source_id", "raw_index", 10, 2)


def disjoint_sample(spark, sf_dir):
    rows = validate.parse_trajectories(trajectories(spark, sf_dir)).where(F.col("prediction").isNotNull())
    rows = rows.select("raw_index", "source_id", (F.col("prediction") == F.col("gold")).alias("is_correct"))
    return select.disjoint_sample(rows, "source_id", "raw_index", "is_correct", 5).select("raw_index", "source_id", "stratum")


def first_rows(spark, sf_dir):
    return select.first_rows(trajectories(spark, sf_dir).select("raw_index", "source_id"), "raw_index", 25)


def chunk_counts(spark, sf_dir):
    t = trajectories(spark, sf_dir).select(F.col("raw_index").alias("row_index"))
    return chunk_ids(t).groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("row_index").alias("first_index"))


def norm_dedup(spark, sf_dir):
    tables(spark, sf_dir, "documents")
    rows = spark.table("documents").select("doc_id", tx.collapse(F.col("text")).alias("norm"))
    return rows.groupBy(F.sha2("norm", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


QUERIES = {
    f.__name__: f
    for f in (
        reject_reason_counts, best_of_n, diverse_n, sft_variants, candidates_per_source, sources_without_candidate, retention, finish_reason_filter,
        judge_pool, ordinal_ids, left_join_reject, coverage_missing, resume_anti, last_wins, align_positional, align_by_key, paired_join, listed_rows,
        dereference, fixed_groups, first_seen, packed_batches, packed_conversations, balanced_sample, cluster_sample, disjoint_sample, first_rows, chunk_counts, norm_dedup,
    )
}

_BEST = "select * from usable where score is not null qualify row_number() over (partition by source_id order by score desc, raw_index) = 1"
_DIVERSE = "select * from usable qualify row_number() over (partition by source_id, trim(regexp_replace(target, '\\s+', ' ', 'g')) order by sample_idx, raw_index) = 1"
ORACLES = {
    "reject_reason_counts": f"with {CLASSIFIED_SQL} select coalesce(reject_reason, 'accepted') as reason, count(*) as n from cl group by 1",
    "best_of_n": f"with {CLASSIFIED_SQL}, b as ({_BEST}) select source_id, raw_index, sample_idx, score, target from b",
    "diverse_n": f"with {CLASSIFIED_SQL}, b as ({_DIVERSE}) select source_id, raw_index, sample_idx, target from b",
    "sft_variants": f"with {CLASSIFIED_SQL}, b as ({_BEST}), v as ({_DIVERSE}) select source_id, raw_index, target, 'best_8' as sft_variant from b union all select source_id, raw_index, target, 'diverse_8' from v",
    "candidates_per_source": f"with {CLASSIFIED_SQL}, g as (select source_id, count(*) as n from usable group by 1) select count(*) as groups, min(n) as min_rows, max(n) as max_rows, round(avg(n), 6) as mean_rows from g",
    "sources_without_candidate": f"with {CLASSIFIED_SQL} select source_id from cl group by 1 having count(*) filter (reject_reason is null) = 0",
    "retention": f"with {CLASSIFIED_SQL} select count(*) as total, count(*) filter (reject_reason is null) as kept, round(count(*) filter (reject_reason is null) / cast(count(*) as double), 6) as retention from cl",
    "finish_reason_filter": f"with {TRAJ_SQL} select raw_index, coalesce(finish_reason = 'stop', false) as strict_ok, finish_reason is null or lower(finish_reason) in ('stop', 'eos', 'eos_token') as lenient_ok from traj",
    "judge_pool": f"with {CLASSIFIED_SQL} select 'train:' || source_id || ':' || sample_idx as judge_id, source_id, gold, prediction as pred, prediction = gold as prediction_correct, text_evidence, integration from cl where reject_reason is null or reject_reason = 'wrong_prediction'",
    "ordinal_ids": f"with {CLASSIFIED_SQL} select raw_index, source_id, row_number() over (order by raw_index) - 1 as judge_id from usable",
    "left_join_reject": "select l.doc_id is not null as found, count(*) as n from documents d left join labels l using (doc_id) group by 1",
    "coverage_missing": "select cast(doc_id as varchar) as doc_id, 'missing' as side from documents where doc_id not in (select doc_id from labels) union all select cast(doc_id as varchar), 'extra' from labels where doc_id not in (select doc_id from documents)",
    "resume_anti": "select doc_id, lang from documents where doc_id not in (select doc_id from labels)",
    "last_wins": "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by event_id desc) = 1",
    "align_positional": f"with {TRAJ_SQL} select raw_index as row_index, gold, sample_idx, 'position' as paired_by from traj",
    "align_by_key": "select cast(doc_id as varchar) as source_id, quality, toxic, 'key' as paired_by from labels",
    "paired_join": f"with {TRAJ_SQL} select a.source_id, a.gold, a.score as a_score, b.score as b_score from traj a join traj b on a.source_id = b.source_id and a.sample_idx = 0 and b.sample_idx = 1",
    "listed_rows": "select doc_id, lang, cast(list_position([17, 3, 11, 5, 0], doc_id) - 1 as integer) as ord from documents where doc_id in (17, 3, 11, 5, 0)",
    "dereference": f"with {TRAJ_SQL} select raw_index, source_id, score from traj where raw_index % 50 = 0",
    "fixed_groups": f"with {TRAJ_SQL} select cast(floor(raw_index / 8) as bigint) as group_id, count(*) as n, min(gold) as gold from traj group by 1",
    "first_seen": "select doc_id, source, min(doc_id) over (partition by source) as group_order from documents",
    "packed_batches": """
with recursive g as (select source, count(*) as n, row_number() over (order by min(doc_id)) as no from documents group by 1),
r as (select source, n, no, cast(0 as bigint) as batch, n as used from g where no = 1
 union all select g.source, g.n, g.no, case when r.used + g.n > 64 then r.batch + 1 else r.batch end, case when r.used + g.n > 64 then g.n else r.used + g.n end from r join g on g.no = r.no + 1)
select source, batch from r""",
    "packed_conversations": """
with recursive g as (select conv_id, count(*) as n, row_number() over (order by min(conv_id * 10000 + turn), conv_id) as no from conversations group by 1),
r as (select conv_id, no, cast(0 as bigint) as batch, n as used from g where no = 1
 union all select g.conv_id, g.no, case when r.used + g.n > 24 then r.batch + 1 else r.batch end, case when r.used + g.n > 24 then g.n else r.used + g.n end from r join g on g.no = r.no + 1)
select conv_id, turn, batch from conversations join r using (conv_id)""",
    "balanced_sample": f"with {TRAJ_SQL} select raw_index, gold from traj qualify row_number() over (partition by gold order by md5(raw_index || ':42'), raw_index) <= 20",
    "cluster_sample": f"with {TRAJ_SQL}, c as (select distinct source_id from traj order by md5(source_id || ':42'), source_id limit 10) select raw_index, source_id from traj where source_id in (select source_id from c) qualify row_number() over (partition by source_id order by md5(raw_index || ':42'), raw_index) <= 2",
    "disjoint_sample": f"""with {CLASSIFIED_SQL}, k as (select raw_index, source_id, prediction = gold as ok from cl where prediction is not null),
o as (select * from k where ok qualify row_number() over (partition by source_id order by md5(raw_index || ':42'), raw_index) = 1),
f as (select raw_index, source_id from o order by md5(source_id || ':42'), source_id limit 5),
w as (select * from k where not ok and source_id not in (select source_id from f) qualify row_number() over (partition by source_id order by md5(raw_index || ':42'), raw_index) = 1),
x as (select raw_index, source_id from w order by md5(source_id || ':42'), source_id limit 5)
select raw_index, source_id, 'correct' as stratum from f union all select raw_index, source_id, 'wrong' from x""",
    "first_rows": f"with {TRAJ_SQL} select raw_index, source_id from traj order by raw_index limit 25",
    "chunk_counts": f"with {TRAJ_SQL} select cast(floor(raw_index / 300) as bigint) as chunk_id, count(*) as n, min(raw_index) as first_index from traj group by 1",
    "norm_dedup": "select sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as digest, min(doc_id) as doc_id, count(*) as copies from documents group by 1",
}
