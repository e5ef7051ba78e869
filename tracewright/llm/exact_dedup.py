"""Exact dedup by skew-safe combining.

Three stages, all in DataFrame operations:

1. *local*: every task merges its own rows of equal text (the map side of the
   first aggregation);
2. *salted*: what is left is merged per (digest, salt, whole text), where the
   salt comes from the row id, so a text that a third of the rows share is
   dealt to ``salts`` groups;
3. *global*: the winners of the salts, at most ``salts`` rows a text, are
   merged per (digest, whole text).

The digest only places rows; whole normalised texts are grouped at every stage,
so rows are merged because their content is equal. Rows then find their winner by digest and salt,
but only after a look at all winners that no two texts have one digest; otherwise they find
it by whole text as well. The keeper is packed
into one decimal (longest first, then smallest id), which keeps the
aggregations on fixed-width hash buffers with no sort of the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.shared import BLANK, durable

_WIDE = T.DecimalType(38, 0)
_SHIFT = 1 << 63
_LONGEST = 1 << 31


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK + "+", "")


def _digest(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _wide(n: int) -> Column:
    return F.lit(str(n)).cast(_WIDE)


def _rank(text: Column, key: Column) -> Column:
    """One number, smallest for the row that stays."""
    shorter = F.lit(_LONGEST) - F.length(F.coalesce(text, F.lit(""))).cast("long")
    return shorter.cast(_WIDE) * _wide(2 * _SHIFT) + (key.cast(_WIDE) + _wide(_SHIFT))


def _key_of(rank: Column) -> Column:
    return (rank % _wide(2 * _SHIFT) - _wide(_SHIFT)).cast("long")


def dedup_exact(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = 48) -> DataFrame:
    """Every row's group: ``(key, keep_id, group_size, kept, text_sha256)``.

    Rows with equal normalised text form a group; the one with the most code
    points in its original text stays, then the smallest key. Null and blank
    texts are one group (the empty text). Rows with a null key are ignored, as
    nothing could name them; a key that occurs on several rows gives one
    result row each time. Empty input gives an empty result; other columns are
    not looked at. ``salts`` is at most 62.
    """
    if not 1 <= salts <= 62:
        raise ValueError("salts must be between 1 and 62")
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_key").isNotNull())
    tagged = rows.select(
        "_key",
        normalised(F.col("_text")).alias("_norm"),
        _rank(F.col("_text"), F.col("_key")).alias("_rank"),
        F.pmod(F.xxhash64("_key"), F.lit(salts)).cast("int").alias("_salt"),
    ).withColumn("_digest", _digest(F.col("_norm")))
    salted = tagged.groupBy("_digest", "_salt", "_norm").agg(F.min("_rank").alias("_rank"), F.count("*").alias("_n"))
    merged = salted.groupBy("_digest", "_norm").agg(F.min("_rank").alias("_rank"), F.sum("_n").alias("group_size"), F.expr("bit_or(shiftleft(1L, _salt))").alias("_mask"))
    won = ["_digest", _key_of(F.col("_rank")).alias("keep_id"), "group_size", "_mask"]
    winners, on = durable(merged.select(*won)), ["_digest", "_salt"]
    if winners.groupBy("_digest").count().where("count > 1").take(1):
        winners, on = merged.select(*won, "_norm"), ["_digest", "_salt", "_norm"]
    # A winner goes back to the salts that its text had, so no join key is hot.
    back = winners.select(
        *[c for c in on if c != "_salt"], "keep_id", "group_size", F.explode(F.expr(f"filter(sequence(0, {salts - 1}), s -> shiftright(_mask, s) % 2 <> 0)")).alias("_salt")
    )
    return tagged.select("_key", *on).join(back, on).select(
        F.col("_key").alias(key),
        "keep_id",
        "group_size",
        (F.col("_key") == F.col("keep_id")).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


ORACLE = r"""
with d as (
  select doc_id, coalesce(text, '') as t from documents where doc_id is not null
), n as (
  select doc_id, length(t) as len, regexp_replace(t, '[\x20\x09-\x0D]', '', 'g') as norm from d
), g as (
  select doc_id, sha256(norm) as text_sha256,
         first_value(doc_id) over (partition by norm order by len desc, doc_id) as keep_id,
         count(*) over (partition by norm) as group_size
  from n
)
select cast(doc_id as bigint) as doc_id, cast(keep_id as bigint) as keep_id, cast(group_size as bigint) as group_size,
       doc_id = keep_id as kept, text_sha256
from g
"""
