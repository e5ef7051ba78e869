"""Queries: tags, answers, transcripts, ids, messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import numeric
from tracewright.functions import text as tx
from tracewright.operators import validate
from tracewright.plans.traj import CLASSIFIED_SQL, PARSED_SQL, TRAJ_SQL, tables, trajectories

MODES = ("spaced", "lenient", "words", "exact")


def answer_modes(spark, sf_dir):
    t = validate.parse_trajectories(trajectories(spark, sf_dir))
    answer = F.col("parsed.answer")
    return t.select("raw_index", *[tx.answer_label(answer, m).cast("int").alias(m) for m in MODES], tx.answer_label(F.col("response"), "tagged").alias("tagged"))


def strict_tag_errors(spark, sf_dir):
    t = trajectories(spark, sf_dir).select(tx.strict_tag_error(F.col("response"), tx.REASONING).alias("reason"))
    return t.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def tag_extract_title(spark, sf_dir):
    tables(spark, sf_dir, "pages")
    return spark.table("pages").select("page_id", tx.tag(F.col("html"), "title").alias("title"))


def answer_errors(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    reason = F.coalesce(tx.answer_error(F.col("response")), F.lit("ok"))
    return t.groupBy(reason.alias("parse_error")).agg(F.count("*").alias("n"), F.count_if(tx.parsed_answer(F.col("response")) == 1).alias("positive"))


def format_valid(spark, sf_dir):
    t = validate.parse_trajectories(trajectories(spark, sf_dir))
    return t.select("raw_index", F.coalesce(tx.format_valid(F.col("parsed")), F.lit(False)).alias("valid"))


def reasoning_rebuild(spark, sf_dir):
    t = validate.parse_trajectories(trajectories(spark, sf_dir))
    return t.select("raw_index", tx.reasoning(F.col("parsed")).alias("reasoning"))


def canonical_target(spark, sf_dir):
    return validate.classify(trajectories(spark, sf_dir)).where("target is not null").select("raw_index", "target")


def completeness(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    return t.select("raw_index", tx.is_complete(F.col("response")).alias("complete"))


def path_stem(spark, sf_dir):
    tables(spark, sf_dir, "pages")
    return spark.table("pages").select("page_id", tx.path_stem(F.split("url", r"[?#]", 2)[0]).alias("stem"))


def source_id_recover(spark, sf_dir):
    tables(spark, sf_dir, "documents")
    d = spark.table("documents")
    own = F.when(F.col("doc_id") % 3 == 0, F.md5(F.col("doc_id").cast("string"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("id"), F.col("doc_id").cast("string")))
    video = F.concat(F.lit("/m/video/v"), F.col("doc_id").cast("string"), F.lit(".x.mp4"))
    none = F.lit(None).cast("string")
    return d.select("doc_id", tx.source_id(none, own, video, none).alias("plain"), tx.source_id(none, own, video, none, skip_hashes=True).alias("no_hashes"))


def last_assistant(spark, sf_dir):
    tables(spark, sf_dir, "conversations")
    messages = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    c = spark.table("conversations").groupBy("conv_id").agg(messages.alias("messages"))
    return c.select("conv_id", tx.last_of_role(F.col("messages"), "assistant").alias("assistant"), tx.last_of_role(F.col("messages"), "user").alias("user"))


def sft_chat(spark, sf_dir):
    tables(spark, sf_dir, "conversations")
    messages = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    c = spark.table("conversations").groupBy("conv_id").agg(messages.alias("m"))
    out = c.select("conv_id", validate.sft_row(F.col("m"), F.lit("TARGET")).alias("m"))
    whole = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit("="), x["content"])), ";")
    return out.select("conv_id", F.size("m").cast("long").alias("turns"), F.sha2(whole, 256).alias("digest"))


def preview(spark, sf_dir):
    tables(spark, sf_dir, "documents")
    return spark.table("documents").select("doc_id", tx.preview(F.col("text")).alias("preview"))


def method_family(spark, sf_dir):
    tables(spark, sf_dir, "documents")
    name = F.concat(F.element_at(F.array(F.lit("sft_"), F.lit("grpo_"), F.lit("grporm_"), F.lit("base_")), (F.col("doc_id") % 4 + 1).cast("int")), F.col("lang"))
    d = spark.table("documents").select("doc_id", tx.method_family(name).alias("f"))
    return d.select("doc_id", F.col("f.family").alias("family"), F.col("f.method").alias("method"))


def frame_indices(spark, sf_dir):
    tables(spark, sf_dir, "documents")
    d = spark.table("documents").select("doc_id", (F.col("n_chars") % 200 + 1).cast("int").alias("total"), (F.col("doc_id") % 40 / 4.0).alias("duration"))
    at = numeric.frame_indices(F.col("total"), F.col("duration"), 4.0, 64)
    return d.select("doc_id", F.size(at).cast("long").alias("frames"), F.array_join(F.transform(at, lambda x: x.cast("string")), ",").alias("indices"))


def token_logprob(spark, sf_dir):
    tables(spark, sf_dir, "embeddings")
    values = F.transform("embedding", lambda x: x.cast("double"))
    e = spark.table("embeddings").select("vec_id", numeric.mean_logprob(values).alias("m"))
    return e.select("vec_id", F.round("m.mean", 6).alias("mean_logprob"), F.col("m.tokens").cast("long").alias("n_tokens"))


def json_props(spark, sf_dir):
    tables(spark, sf_dir, "events")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return spark.table("events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        answer_modes, strict_tag_errors, tag_extract_title, answer_errors, format_valid, reasoning_rebuild, canonical_target, completeness,
        path_stem, source_id_recover, last_assistant, sft_chat, preview, method_family, frame_indices, token_logprob, json_props,
    )
}

_T = "regexp_replace(lower(answer), '[_-]', ' ', 'g')"
_ONE = lambda yes, no, x: f"cast(case when {x} in ({yes}) then 1 when {x} in ({no}) then 0 end as integer)"
_STRICT = " ".join(
    f"when o_{s} <> 1 then '{s}_open_count_' || o_{s} when c_{s} <> 1 then '{s}_close_count_' || c_{s}"
    f" when not regexp_matches(response, '(?s)<{s}>.*?</{s}>') then '{s}_not_parseable' when trim(regexp_extract(response, '(?s)<{s}>(.*?)</{s}>', 1)) = '' then '{s}_empty'"
    for s in tx.REASONING
)
_COUNTS = ", ".join(
    f"(length(response) - length(replace(response, '<{s}>', ''))) // {len(s) + 2} as o_{s}, (length(response) - length(replace(response, '</{s}>', ''))) // {len(s) + 3} as c_{s}" for s in tx.REASONING
)
ORACLES = {
    "answer_modes": f"""with {PARSED_SQL} select raw_index,
 {_ONE("'sarcasm'", "'non-sarcasm', 'non sarcasm'", "trim(regexp_replace(lower(answer), chr(92) || 's+', ' ', 'g'))")} as spaced, prediction as lenient,
 {_ONE("'sarcasm'", "'non sarcasm', 'nonsarcasm'", f"trim({_T})")} as words, {_ONE("'sarcasm'", "'non-sarcasm'", "lower(answer)")} as exact,
 case lower(regexp_extract(response, '(?i)<answer>\\s*(Sarcasm|Non-Sarcasm)\\s*</answer>', 1)) when 'sarcasm' then 1 when 'non-sarcasm' then 0 end as tagged from parsed""",
    "strict_tag_errors": f"with {TRAJ_SQL}, c as (select response, {_COUNTS} from traj) select case {_STRICT} else 'ok' end as reason, count(*) as n from c group by 1",
    "tag_extract_title": "select page_id, case when len(regexp_extract_all(html, '(?is)<title>(.*?)</title>', 1)) = 1 then nullif(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '') end as title from pages",
    "answer_errors": f"""with {TRAJ_SQL}, a as (select regexp_extract_all(response, '(?is)<answer>(.*?)</answer>', 1) as f from traj),
 b as (select f, regexp_replace(lower(f[1]), '[\\s_-]+', '', 'g') as x from a),
 e as (select x, case when len(f) = 0 then 'missing_answer_tag' when len(f) > 1 then 'multiple_answer_tags' when x not in ('sarcasm', 'sarcastic', 'nonsarcasm', 'nonsarcastic') then 'invalid_answer' else 'ok' end as parse_error from b)
 select parse_error, count(*) as n, count(*) filter (parse_error = 'ok' and x in ('sarcasm', 'sarcastic')) as positive from e group by 1""",
    "format_valid": f"with {PARSED_SQL} select raw_index, text_evidence is not null and audio_evidence is not null and visual_evidence is not null and integration is not null and coalesce(lower(answer) in ('sarcasm', 'non-sarcasm'), false) as valid from parsed",
    "reasoning_rebuild": f"with {CLASSIFIED_SQL} select raw_index, reasoning from cl",
    "canonical_target": f"with {CLASSIFIED_SQL} select raw_index, target from usable",
    "completeness": f"with {TRAJ_SQL} select raw_index, contains(response, '</text_evidence>') and contains(response, '</audio_evidence>') and contains(response, '</visual_evidence>') and contains(response, '</integration>') and contains(response, '</answer>') as complete from traj",
    "path_stem": "select page_id, regexp_extract(regexp_extract(url, '^[^?#]*'), '([^/]+?)(\\.[^./]+)?/*$', 1) as stem from pages",
    "source_id_recover": """select doc_id, case doc_id % 3 when 0 then md5(cast(doc_id as varchar)) when 1 then 'id' || doc_id else 'v' || doc_id || '.x' end as plain,
 case doc_id % 3 when 1 then 'id' || doc_id else 'v' || doc_id || '.x' end as no_hashes from documents""",
    "last_assistant": "select conv_id, arg_max(text, turn) filter (role = 'assistant') as assistant, arg_max(text, turn) filter (role = 'user') as \"user\" from conversations group by 1",
    "sft_chat": """with r as (select *, turn = max(turn) over (partition by conv_id) as last from conversations),
 x as (select conv_id, turn, case when last and role = 'assistant' then 'assistant=TARGET' else role || '=' || text || case when last then ';assistant=TARGET' else '' end end as s, case when last and role <> 'assistant' then 2 else 1 end as k from r)
 select conv_id, cast(sum(k) as bigint) as turns, sha256(string_agg(s, ';' order by turn)) as digest from x group by 1""",
    "preview": "select doc_id, case when length(text) > 70 then substr(replace(text, chr(10), ' '), 1, 67) || '...' else replace(text, chr(10), ' ') end as preview from documents",
    "method_family": "select doc_id, case doc_id % 4 when 0 then 'sft' when 1 then 'grpo' when 2 then 'grporm' end as family, case when doc_id % 4 < 3 then lang end as method from documents",
    "frame_indices": """with d as (select doc_id, cast(n_chars % 200 + 1 as integer) as total, doc_id % 40 / 4.0::double as duration from documents),
 n as (select doc_id, total, greatest(1, least(64, total, cast(floor(duration * 4.0) as integer))) as n from d),
 i as (select distinct doc_id, cast(round_even(k * (total - 1) / cast(greatest(n - 1, 1) as double), 0) as integer) as idx from (select doc_id, total, n, unnest(range(0, n)) as k from n))
 select doc_id, count(*) as frames, string_agg(cast(idx as varchar), ',' order by idx) as indices from i group by 1""",
    "token_logprob": "select vec_id, round(list_avg(list_transform(embedding, lambda x: cast(x as double))), 6) as mean_logprob, cast(len(embedding) as bigint) as n_tokens from embeddings",
    "json_props": "select cast(json_extract(props, '$.k') as integer) as k, count(*) as n from events group by 1",
}
