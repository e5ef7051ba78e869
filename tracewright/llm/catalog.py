"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import conversation_repair, decontaminate, exact_dedup, line_dedup, lm_score, mixing, near_dedup, periodic_runs, pii, quality, substring_dedup, token_counts, url_filter
from tracewright.llm.shared import table


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_exact(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_private(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.span_text(pii.KINDS), 256).alias("base_sha256"),
        pii.span_text((*pii.KINDS, "term")).alias("spans"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def linked_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of ``op5`` on pages that link to each other's hosts, eight steps: here the walks decide."""
    table(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    return url_filter.judge_urls(spark.sql(url_filter.LINKED), steps=8).select("page_id", "host", "path", "rule", "verdict")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find_near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit", "within")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audit_conversations(table(spark, sf_dir, "conversations"), damage=True)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest_runs(table(spark, sf_dir, "documents"), plant=True).withColumnRenamed("key", "doc_id")


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_pii": op4_pii,
    "op5_url_filter": op5_url_filter,
    "op6_mixing": op6_mixing,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality": op10_quality,
    "op11_token_counts": op11_token_counts,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_periodic_runs": op13_periodic_runs,
    "linked_urls": linked_urls,
}
ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op4_pii": pii.ORACLE,
    "op5_url_filter": url_filter.ORACLE,
    "linked_urls": url_filter.ORACLE_LINKED,
    "op6_mixing": mixing.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op8_decontamination": decontaminate.ORACLE,
    "op9_near_dedup": near_dedup.ORACLE,
    "op12_conversation_repair": conversation_repair.ORACLE,
    "op13_periodic_runs": periodic_runs.ORACLE,
}
