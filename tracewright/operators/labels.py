"""Merging component labels, and training rows for a reward model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.judge_json import COMPONENTS, label_json
from tracewright.functions.text import fill


def wide_labels(long: DataFrame, key: str = "judge_id") -> DataFrame:
    """One row a key from ``(key, component, grounded)`` rows: one shuffle, no join a component.

    Raises on reading where a key has two labels of one component.
    """
    once = [F.count_if(F.col("component") == c) for c in COMPONENTS]
    label = [F.max(F.when(F.col("component") == c, F.col("grounded"))).alias(c) for c in COMPONENTS]
    wide = long.groupBy(key).agg(*label, F.greatest(*once).alias("_most"))
    twice = F.raise_error(F.concat(F.lit("repeated label of "), F.col(key).cast("string"))).cast("boolean")
    return wide.where(F.when(F.col("_most") <= 1, True).otherwise(twice)).drop("_most")


def label_problems(pool: DataFrame, long: DataFrame, key: str = "judge_id") -> DataFrame:
    """``(key, component, problem)``: labels that are ``missing``, ``extra`` (of no row of the pool) or ``repeated``."""
    have = long.groupBy(F.col(key).cast("string").alias(key), "component").agg(F.count("*").alias("_n"))
    want = pool.select(F.col(key).cast("string").alias(key)).distinct().select(key, F.explode(F.array(*[F.lit(c) for c in COMPONENTS])).alias("component"), F.lit(True).alias("_want"))
    both = want.join(have, [key, "component"], "full")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_want").isNull(), "extra").when(F.col("_n") > 1, "repeated")
    return both.select(key, "component", problem.alias("problem")).where("problem is not null")


def merge_labels(pool: DataFrame, long: DataFrame, key: str = "judge_id", strict: bool = True) -> DataFrame:
    """The pool with its four labels, ``grounding_sum`` and ``all_grounded``.

    Keys of the pool must be unique. A label that is missing, that no row of the pool has, or that is repeated raises on
    reading; without ``strict``, rows without all labels are left out, and labels of other rows do not
    count. :func:`label_problems` names them.
    """
    wide = wide_labels(long, key)
    known = F.lit(True)
    total = F.lit(0)
    for c in COMPONENTS:
        known, total = known & F.col(c).isNotNull(), total + F.col(c)
    if strict:
        fail = F.raise_error(F.concat(F.lit("pool and labels differ at "), F.col(key).cast("string"))).cast("boolean")
        both = pool.withColumn("_pool", F.lit(True)).join(wide, key, "full")
        out = both.where(F.when(F.col("_pool") & known, True).otherwise(fail)).drop("_pool")
    else:
        out = pool.join(wide.where(known), key)
    return out.withColumn("grounding_sum", total.cast("int")).withColumn("all_grounded", F.col("grounding_sum") == 4)


def chat_row(system: Column, user_template: Column, fields: dict[str, Column], labels: dict[str, Column]) -> Column:
    """System, filled user and label messages of a reward-model training row."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", system), message("user", fill(user_template, fields, required=True)), message("assistant", label_json(labels)))
