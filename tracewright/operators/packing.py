"""Packing whole groups into batches in order: next-fit, with jump pointers instead of a loop.

A batch takes groups as long as they fit; a group beyond the limit is a batch of its own. Where a batch that begins at group
*i* ends does not depend on what came before, so every group gets a pointer to the beginning of the next batch. Pointers over
1, 2, 4, ... batches come from joining the pointers with themselves, and with them the beginnings that are reached
from the first group are marked, with their numbers, in as many joins as there are levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.validate import require, with_ordinal
from tracewright.session import durable


def next_beginnings(groups: DataFrame, most: int) -> DataFrame:
    """``(i, j)``: a batch that begins at group i (numbered from 1, with ``upto``, the sum of sizes to its end) is followed by one that begins at j.

    The last group that fits is the last with ``upto`` of at most the sum before i and ``most``. Sums are dealt into ranges of
    the width ``most``: that group is in the range of this bound, or is the last of the range before, in which i itself begins.
    As sizes are 1 at least, a range has ``most`` groups at most.
    """
    bound = F.col("upto") - F.col("size") + most
    ends = groups.select(F.floor(F.col("upto") / most).alias("range"), F.col("upto").alias("at"), F.lit(0).alias("asks"), F.col("i"))
    asks = groups.select(F.floor(bound / most).alias("range"), bound.alias("at"), F.lit(1).alias("asks"), F.col("i"))
    so_far = Window.partitionBy("range").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ends.unionByName(asks).withColumn("last", F.max(F.when(F.col("asks") == 0, F.col("i"))).over(so_far)).where("asks = 1")
    before = ends.groupBy((F.col("range") + 1).alias("range")).agg(F.max("i").alias("before"))
    last = F.coalesce("last", "before", F.lit(0))
    return inside.join(before, "range", "left").select("i", F.greatest(last, F.col("i")).alias("end")).select("i", (F.col("end") + 1).alias("j"))


def marked_beginnings(pointers: DataFrame, n: int) -> DataFrame:
    """``(i, batch)`` of the groups at which batches begin, reached from group 1 by following pointers; those beyond n lead nowhere."""
    levels = [durable(pointers.where(F.col("j") <= n).select("i", "j"))]
    while not levels[-1].where("i = 1").isEmpty():
        further = levels[-1].select(F.col("i").alias("j"), F.col("j").alias("k"))
        levels.append(durable(levels[-1].join(further, "j").select("i", F.col("k").alias("j"))))
    marked = pointers.sparkSession.range(1).select(F.lit(1).cast("long").alias("i"), F.lit(0).cast("long").alias("batch"))
    for k in range(len(levels) - 2, -1, -1):
        both = F.array(F.struct("i", "batch"), F.struct(F.col("j").alias("i"), (F.col("batch") + (1 << k)).alias("batch")))
        marked = marked.join(levels[k], "i", "left").select(F.explode(both).alias("b")).select("b.*").where(F.col("i").isNotNull())
    return marked


def pack_groups(groups: DataFrame, order: list[str], size: str, most: int) -> DataFrame:
    """The groups with ``batch``, from 0: whole groups in order, a new batch where the next one would not fit into ``most``.

    Sizes of 0 or less, or null, raise. ``order`` has to be total. An empty table gives none.
    """
    if most < 1:
        raise ValueError(most)
    counted = require(groups, {"size": F.col(size) >= 1}).withColumn("_size", F.col(size).cast("long"))
    numbered = durable(with_ordinal(counted, order, "_i", {"_upto": "_size"}).withColumn("_i", F.col("_i") + 1))
    n = numbered.count()
    if not n:
        return groups.withColumn("batch", F.lit(None).cast("long"))
    pointers = durable(next_beginnings(numbered.select(F.col("_i").cast("long").alias("i"), F.col("_size").alias("size"), F.col("_upto").alias("upto")), most))
    starts = marked_beginnings(pointers, n).join(pointers, "i")
    members = starts.select("batch", F.explode(F.sequence(F.col("i"), F.col("j") - 1)).alias("_i"))
    return numbered.join(members, "_i").drop("_i", "_size", "_upto")


def pack_rows(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The rows with ``batch``: groups in the order of their first row, each as a whole in one batch."""
    groups = rows.groupBy(group).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    packed = pack_groups(groups, ["_first", group], "_n", most).select(F.col(group).alias("_group"), "batch")
    return rows.join(packed, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
