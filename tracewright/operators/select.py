"""Choosing rows of groups: best, diverse, sampled; grouping by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text as tx


def best_of_n(rows: DataFrame, group: str = "source_id", score: str = "score", order: str = "raw_index", strict: bool = True) -> DataFrame:
    """The row with the highest score of each group, the first one on ties; rows without a score never win.

    A group whose rows all lack scores raises on reading; without ``strict`` it has no best row, and
    :func:`groups_without_score` names it.
    """
    usable = F.col(score).isNotNull() & ~F.isnan(score)
    w = Window.partitionBy(group).orderBy(F.when(usable, F.col(score)).desc_nulls_last(), F.col(order))
    best = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    if not strict:
        return best.where(usable)
    none = F.raise_error(F.concat(F.lit("no row with a score in "), F.col(group).cast("string"))).cast("boolean")
    return best.where(F.when(usable, True).otherwise(none))


def groups_without_score(rows: DataFrame, group: str = "source_id", score: str = "score") -> DataFrame:
    usable = F.col(score).isNotNull() & ~F.isnan(score)
    return rows.groupBy(group).agg(F.count_if(usable).alias("_n")).where("_n = 0").select(group)


def diverse_n(rows: DataFrame, group: str = "source_id", target: str = "target", order: tuple[str, ...] = ("sample_idx", "raw_index")) -> DataFrame:
    """The first row, by ``order``, of each different target of a group, blanks collapsed."""
    w = Window.partitionBy(group, "_norm").orderBy(*order)
    out = rows.withColumn("_norm", tx.collapse(F.col(target))).withColumn("_n", F.row_number().over(w))
    return out.where("_n = 1").drop("_n", "_norm")


def draw(key: Column, seed: int) -> Column:
    """A reproducible random order: by the MD5 of key and seed."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def top_k(rows: DataFrame, groups: list[str], k: int, order: list) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def balanced_sample(rows: DataFrame, label: str, key: str, n: int, seed: int = 42, strict: bool = True) -> DataFrame:
    """Exactly ``n`` rows of each label, in random order; raises if a label is short."""
    if strict:
        short = rows.groupBy(label).count().where(F.col("count") < n).collect()
        if short:
            raise ValueError(f"too few rows: {[tuple(r) for r in short]}")
    return top_k(rows, [label], n, [draw(F.col(key), seed), F.col(key)])


def cluster_sample(rows: DataFrame, group: str | list[str], key: str, groups: int, per_group: int, seed: int = 42) -> DataFrame:
    """``per_group`` rows of each of ``groups`` groups drawn at random; 0 is all. A group may be several columns, such as split and source."""
    by = [group] if isinstance(group, str) else group
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by])
    if groups:
        chosen = rows.select(*by).distinct().orderBy(draw(name, seed), *by).limit(groups)
        rows = rows.join(chosen, by, "left_semi")
    return top_k(rows, by, per_group, [draw(F.col(key), seed), F.col(key)]) if per_group else rows


def disjoint_sample(rows: DataFrame, group: str, key: str, correct: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` correct rows of different groups, then ``n`` wrong ones of other groups, one row each; raises if there are fewer."""

    def one_each(some: DataFrame, stratum: str) -> DataFrame:
        one = top_k(some, [group], 1, [draw(F.col(key), seed), F.col(key)])
        taken = one.orderBy(draw(F.col(group), seed), group).limit(n).withColumn("stratum", F.lit(stratum))
        if (have := taken.count()) < n:
            raise ValueError(f"{n} groups with {stratum} rows are needed, {have} are left")
        return taken

    first = one_each(rows.where(F.col(correct)), "correct")
    others = rows.where(~F.col(correct)).join(first.select(group), group, "left_anti")
    return first.unionByName(one_each(others, "wrong"))


def fixed_groups(rows: DataFrame, index: str, size: int, signature: list[str], strict: bool = True) -> DataFrame:
    """Rows with ``group_id``, ``size`` contiguous rows each; raises on reading where a group is short or mixed.

    Without ``strict`` such groups stay, and ``whole`` tells them apart. Rows without an index are a group of their own.
    """
    out = rows.withColumn("group_id", F.floor(F.col(index) / size))
    facts = out.groupBy(F.col("group_id").alias("_id")).agg(F.count("*").alias("_n"), F.count_distinct(F.struct(*signature)).alias("_k"))
    whole = (F.col("_n") == size) & (F.col("_k") == 1)
    if strict:
        facts = facts.where(F.when(whole, True).otherwise(F.raise_error(F.lit("incomplete or mixed group")).cast("boolean")))
        return out.join(facts.select("_id"), F.col("group_id").eqNullSafe(F.col("_id"))).drop("_id")
    return out.join(facts.select("_id", whole.alias("whole")), F.col("group_id").eqNullSafe(F.col("_id"))).drop("_id")


def first_seen(rows: DataFrame, group: str, order: str, name: str = "group_order") -> DataFrame:
    """Each row with the position of its group's first row, which orders groups by first appearance."""
    return rows.join(rows.groupBy(group).agg(F.min(order).alias(name)), group)


def first_rows(rows: DataFrame, order: str, n: int) -> DataFrame:
    return rows.orderBy(order).limit(n)
