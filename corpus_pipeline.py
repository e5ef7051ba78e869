"""A document corpus, filtered and mixed: five stages over ``documents``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run` writes
it as Parquet, into the shared folder that the cluster names for checkpoints, and
reads it again as the next stage's documents. All but the last return the columns of
``documents``.

Null and empty texts are judged by their statistics as all others, and are otherwise passed on; the
mix takes none without words. Equal rows are treated alike: near dedup keeps rows with one ``doc_id`` together,
and the mix counts each of its own. Rows with a null ``doc_id`` go in the last stage. An empty table
gives an empty result, after every stage. Other columns are passed on, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from tracewright.llm.shared import ensure_checkpoint_dir, table

#: SQL cannot fit the classifier; tests hold the stages against plain Python.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; those that consisted of nothing else go."""
    cut = line_dedup.dedup_lines(docs)
    dropped = F.col(cut.columns[-1]) > 0
    emptied = dropped & ~F.regexp_like(F.col("text"), F.lit(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(dropped, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.where(~emptied | F.col("text").isNull()).withColumn("n_chars", n_chars).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return near_dedup.dedup_near(docs, shingle=5, percent=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with ``size``, ``target`` (of the source), ``copies`` and ``taken``."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result is the mix.

    What a stage has written goes when the next one has, and all of it where a stage fails; the mix stays.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    try:
        for number, (name, stage) in enumerate(STAGES):
            path = f"{folder}/{number}-{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                _delete(spark, before)
            before = path
    except BaseException:
        _delete(spark, folder)
        raise
    return docs


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
