"""The engine from SQL: queries as views, judge parsers as functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tracewright.functions import judge_json
from tracewright.plans import catalog


def register_functions(spark: SparkSession) -> None:
    """``parse_judge_labels``, ``parse_judge_scores``, ``parse_judge_verdict``: a string to a struct."""
    spark.udf.register("parse_judge_labels", judge_json.labels_udf())
    spark.udf.register("parse_judge_scores", judge_json.scores_udf())
    spark.udf.register("parse_judge_verdict", judge_json.verdict_udf(drift=True, unescape=True))


def register_views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """The named queries (all) as temporary views ``q_<name>``."""
    for name in names or catalog.QUERIES:
        catalog.QUERIES[name](spark, sf_dir).createOrReplaceTempView(f"q_{name}")
