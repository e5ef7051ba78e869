"""Joins by string keys, with the misses counted rather than lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the last by ``order``: what building a dictionary in order leaves."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("*"), F.col(order)).alias("_last"))  # combines before it shuffles
    return last.select(*[F.col("_last")[c].alias(c) for c in rows.columns])


def lookup(left: DataFrame, right: DataFrame, key: str, found: str = "found", required: bool = False) -> DataFrame:
    """All left rows with the right's columns and whether there was a match; ``right`` has each key once.

    Keys are compared as strings. With ``required`` a miss raises on reading.
    """
    r = right.withColumn("_key", F.col(key).cast("string")).drop(key).withColumn(found, F.lit(True))
    out = left.withColumn("_key", F.col(key).cast("string")).join(r, "_key", "left").drop("_key")
    out = out.withColumn(found, F.coalesce(found, F.lit(False)))
    if required:
        miss = F.raise_error(F.concat(F.lit(f"no match for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
        out = out.where(F.when(F.col(found), True).otherwise(miss))
    return out


def coverage(pool: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``(key, side)`` of the keys that only one side has: ``missing`` from the labels, or ``extra`` there."""
    a = pool.select(F.col(key).cast("string").alias(key)).distinct()
    b = labels.select(F.col(key).cast("string").alias(key)).distinct()
    missing = a.join(b, key, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def require_coverage(pool: DataFrame, labels: DataFrame, key: str) -> None:
    bad = coverage(pool, labels, key).limit(5).collect()
    if bad:
        raise ValueError(f"keys on one side only, among them {[tuple(r) for r in bad]}")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


#: So many keys are sent to a larger side: a few MB.
SENT_KEYS = 200_000


def pending_from(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The same, where much more is done than there are rows to look at.

    The number of keys is counted first. A bounded number is sent to the done side, which then moves only what it has of
    them; beyond that both sides are shuffled.
    """
    keys = rows.select(key).distinct()
    if keys.limit(SENT_KEYS + 1).count() <= SENT_KEYS:
        done = done.select(key).join(F.broadcast(keys), key, "left_semi")
    return pending(rows, done, key)


def align(gold: DataFrame, predictions: DataFrame, key: str = "source_id", index: str = "row_index") -> tuple[DataFrame, str]:
    """Pairs of rows, and how they were paired: by key, or by position.

    By key if on both sides every key is set, unique and the sets are equal;
    by position otherwise, which requires equal lengths. Positions are given in ``index``, so no
    order of files matters. The columns of the predictions get the prefix ``p_``.
    """
    g, p = gold.withColumn(key, F.col(key).cast("string")), predictions.withColumn(key, F.col(key).cast("string"))
    facts = [d.agg(F.count("*").alias("n"), F.count(key).alias("known"), F.count_distinct(key).alias("different")).first() for d in (g, p)]
    by_key = all(f["n"] == f["known"] == f["different"] for f in facts) and facts[0]["n"] == facts[1]["n"]
    by_key = by_key and not g.join(p.select(key), key, "left_anti").take(1)
    if not by_key and facts[0]["n"] != facts[1]["n"]:
        raise ValueError(f"{facts[0]['n']} gold rows and {facts[1]['n']} predictions")
    on = key if by_key else index
    right = p.select(*[F.col(c).alias(f"p_{c}") for c in p.columns])
    return g.join(right, F.col(on) == F.col(f"p_{on}")), ("key" if by_key else "position")


def listed(rows: DataFrame, key: str, wanted: list) -> DataFrame:
    """The rows of a literal list of keys, with their place ``ord`` in it; raises if one is missing."""
    spark = rows.sparkSession
    ids = spark.createDataFrame([(str(k), i) for i, k in enumerate(wanted)], "_key string, ord int")  # as long as the list in the code
    out = rows.join(F.broadcast(ids), F.col(key).cast("string") == F.col("_key")).drop("_key")
    have = {r[0] for r in out.select(F.col(key).cast("string")).distinct().collect()}
    if lost := [k for k in wanted if str(k) not in have]:
        raise KeyError(f"not found: {lost}")
    return out


def dereference(refs: DataFrame, raw: DataFrame, index: str = "raw_index", check: tuple[str, ...] = ("source_id", "sample_idx")) -> DataFrame:
    """Rows of ``raw`` that ``refs`` point to by position; raises on reading where the checked columns disagree."""
    r = raw.select(*[F.col(c).alias(f"raw_{c}") for c in raw.columns])
    out = refs.join(r, F.col(index) == F.col(f"raw_{index}"))
    for c in check:
        same = F.col(c).cast("string").eqNullSafe(F.col(f"raw_{c}").cast("string"))
        out = out.where(F.when(same, True).otherwise(F.raise_error(F.lit(f"{c} disagrees with the raw row")).cast("boolean")))
    return out


def excluded(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Rows of other sources than the chosen ones."""
    return rows.join(chosen.select(key).distinct(), key, "left_anti")
