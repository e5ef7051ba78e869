"""What several operators use: durable lineage cuts and tolerant input columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.session import durable, ensure_checkpoint_dir, ship_package  # noqa: F401 - for the operators

#: The whitespace that all word and text contracts share.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def free_name(name: str, columns: list[str]) -> str:
    """The name, with underscores behind it while a column has it (in any case)."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name += "_"
    return name


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)

