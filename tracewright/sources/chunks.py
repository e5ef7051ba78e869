"""Work in chunks of consecutive rows: a chunk is done as a whole, and what is done is not done again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.sources.io import _fs


def chunk_ids(rows: DataFrame, index: str = "row_index", size: int = 300) -> DataFrame:
    """Rows with ``chunk_id``: ``size`` consecutive positions each."""
    return rows.withColumn("chunk_id", F.floor(F.col(index) / size))


def missing_chunks(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks that are absent or incomplete in ``done``: ``(chunk_id, expected, have)``."""
    want = rows.groupBy("chunk_id").agg(F.count("*").alias("expected"))
    have = done.groupBy("chunk_id").agg(F.count("*").alias("have"))
    return want.join(have, "chunk_id", "left").select("chunk_id", "expected", F.coalesce("have", F.lit(0)).alias("have")).where("have <> expected")


def merge_chunks(rows: DataFrame, done: DataFrame) -> DataFrame:
    """All chunks in order; raises if one is incomplete."""
    if bad := missing_chunks(rows, done).limit(5).collect():
        raise ValueError(f"incomplete chunks: {[tuple(r) for r in bad]}")
    return done.orderBy("chunk_id", "row_index")


def read_chunks(spark: SparkSession, path: str) -> DataFrame | None:
    """What :func:`run_chunks` has written; null if nothing. Counting rows by chunk reads footers only."""
    fs, at = _fs(spark, path)
    return spark.read.parquet(path) if fs.globStatus(at(f"{path}/chunk_id=*")) else None


def open_chunks(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """``(chunk_id, expected, have)`` of the chunks of ``rows`` that are absent from the folder, short or too long."""
    done = read_chunks(spark, path)
    return missing_chunks(rows, done if done is not None else rows.limit(0))


def run_chunks(spark: SparkSession, rows: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], index: str = "row_index", size: int = 300, chunks_per_job: int = 100) -> list[int]:
    """Do ``work`` on all rows and write what it returns to a folder by chunk; returns the chunks that were written.

    ``work`` gets some chunks' rows, with ``chunk_id``, and returns as many, with ``chunk_id`` and the index. Chunks that the folder has
    with as many rows as the input are left alone. The others are worked on ``chunks_per_job`` at a time, and replace what the folder has of
    them: each job overwrites its own partitions only, and Spark moves a partition there when it is complete. So a run that fails or is
    killed keeps what earlier jobs have done, and the next one goes on from there. Raises if a chunk is not complete after its job.
    """
    chunked = chunk_ids(rows, index, size).withColumn("chunk_id", F.col("chunk_id").cast("int"))
    written: list[int] = []
    # Jobs by range of chunks: the driver sees one row a job.
    jobs = open_chunks(spark, chunked, path).select(F.floor(F.col("chunk_id") / chunks_per_job).alias("job")).distinct().orderBy("job").collect()
    for (job,) in jobs:
        lo, hi = job * chunks_per_job, (job + 1) * chunks_per_job
        mine = chunked.where(F.col(index).between(lo * size, hi * size - 1))  # on the column itself, so that it reaches the scan
        wanted = [r.chunk_id for r in open_chunks(spark, mine, path).where(F.col("chunk_id").between(lo, hi - 1)).collect()]
        out = work(mine.where(F.col("chunk_id").isin(wanted)))
        out.repartition("chunk_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk_id").parquet(path)
        left = [tuple(r) for r in open_chunks(spark, mine, path).where(F.col("chunk_id").isin(wanted)).limit(5).collect()]
        if left:
            raise ValueError(f"incomplete chunks: {left}")
        written += wanted
    return sorted(written)


def merged(spark: SparkSession, rows: DataFrame, path: str, index: str = "row_index", size: int = 300) -> DataFrame:
    """All rows of the folder in order; raises if a chunk of the input is not complete."""
    chunked = chunk_ids(rows, index, size).withColumn("chunk_id", F.col("chunk_id").cast("int"))
    done = read_chunks(spark, path)
    return merge_chunks(chunked, done if done is not None else chunked.limit(0))
