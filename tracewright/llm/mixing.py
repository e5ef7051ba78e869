"""Mixing sources to target weights by weighted fair queueing.

Each source is a stream of its shuffled documents, gone through at most
``max_repeats`` times. A document copy gets a *virtual finish time*: the words of its
source up to and including it, divided by the source's target. All copies are
range-sorted by finish time and the sequence is cut where its words reach the
budget; since the targets add up to the budget, every source is then near its
target.

Running totals are taken in two levels, over buckets and then within a bucket,
so a source or a moment that holds a large share of the rows is never one
task: shuffle order and finish time are both cut into ``buckets`` ranges, whose number
follows that of the rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.shared import WORD, durable, free_name

#: Weights dealt to the sources in code point order, over and over.
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """``(source, source_size, weight, target)`` for a table of ``(source, source_size)``.

    Water-filling: targets are ``level * weight``, at most ``max_repeats`` times the
    source's size. With the sources ordered by size over weight, those that
    hit their ceiling come first, so the level follows from running totals.
    The windows have one row a source.
    """
    dealt = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("_no") - 1, F.lit(len(weights))).cast("int") + 1)
    everything = Window.partitionBy(F.lit(0))
    by_ratio = everything.orderBy(F.col("_ratio"), F.col("_no"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("_no", F.row_number().over(everything.orderBy(F.asc_nulls_last("source"))))
        .withColumn("weight", dealt.cast("double"))
        .withColumn("_ceiling", F.col("source_size") * F.lit(float(max_repeats)))
        .withColumn("_ratio", F.col("_ceiling") / F.col("weight"))
        .withColumn("_budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("_spent", F.coalesce(F.sum("_ceiling").over(before), F.lit(0.0)))
        .withColumn("_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_at", F.row_number().over(by_ratio))
        .withColumn("_level", (F.col("_budget") - F.col("_spent")) / F.col("_left"))
    )
    # The level is that of the first source that stays below its ceiling.
    first = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_at", "_level"))).over(everything)
    target = F.when(F.col("_common").isNull(), F.col("_ceiling")).otherwise(F.least("_ceiling", F.col("_common") * F.col("weight")))
    return ranked.withColumn("_common", first["_level"]).select("source", "source_size", "weight", target.alias("target"))


def _totals(df: DataFrame, stream: list[str], bucket: str) -> DataFrame:
    """The words before each bucket of each stream: ``(*stream, bucket, _ahead)``."""
    totals = df.groupBy(*stream, bucket).agg(F.sum("size").alias("_t"))
    ahead = Window.partitionBy(*(stream or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("_ahead", F.coalesce(F.sum("_t").over(ahead), F.lit(0).cast("long"))).drop("_t")


def _running(df: DataFrame, totals: DataFrame, stream: list[str], bucket: str, order: list, out: str) -> DataFrame:
    """``out``: the words up to each row, by ``order`` within ``stream``; ``bucket`` follows ``order``.

    With the totals of buckets at hand each row only needs the rows of its own bucket.
    """
    on = reduce(and_, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*stream, bucket]])
    more = [F.col(f"r.{c}") for c in totals.columns if c not in (*stream, bucket)]
    joined = df.alias("l").join(totals.alias("r"), on).select("l.*", *more)
    within = Window.partitionBy(*stream, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.col("_ahead") + F.sum("size").over(within)).drop("_ahead")


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights=WEIGHTS,
    share: float = 1.5,
    max_repeats: int = 2,
    seed: str = "mix",
    buckets: int | None = None,
) -> DataFrame:
    """How often the mix takes each document.

    Returns ``(key, source, size, source_size, target, copies, taken)``, one row
    a document: ``copies`` between 0 and ``max_repeats``, ``taken = copies * size``. The
    shuffle is by MD5 of key and seed, so reruns agree. ``buckets`` (some 20,000 rows each,
    at least 512) has no influence on the result.
    Rows with equal keys are shuffled next to each other and counted
    separately. Null texts have size 0 and are never taken; null source is a source of
    its own, last in order; rows with a null key are ignored. An empty table gives
    an empty result; other columns are not looked at.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")).where(F.col("doc_id").isNotNull())
    rows = durable(rows)  # the texts are read once
    return _mixed(rows, key, weights, share, max_repeats, seed, buckets)


def _mixed(rows: DataFrame, key: str, weights, share: float, max_repeats: int, seed: str, buckets: int | None, *more: str) -> DataFrame:
    """:func:`mix_sources` for ``(doc_id, source, size)``, and the columns ``more`` of ``rows``."""
    buckets = buckets or max(512, rows.count() // 20_000)
    rows = rows.withColumn("_mix", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(seed))))
    rows = rows.withColumn("_slot", (F.conv(F.substring("_mix", 1, 7), 16, 10).cast("long") * F.lit(buckets / (1 << 28))).cast("int"))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeats)
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    slots = _totals(rows, ["source"], "_slot")
    slots = slots.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = _running(rows, slots, ["source"], "_slot", [F.col("_mix"), F.col("doc_id")], "_upto")

    def finish(k: int | Column) -> Column:
        done = (F.col("_upto") + F.lit(k) * F.col("source_size")).cast("double") / F.when(F.col("target") > 0, F.col("target"))
        return F.when(F.col("size") > 0, done)

    place = lambda f: F.struct(f.alias("_finish"), F.col("_mix"), F.col("doc_id"))
    copies = placed.select("doc_id", "_mix", "size", F.explode(F.array(*[finish(k) for k in range(max_repeats)])).alias("_finish")).where(F.col("_finish").isNotNull())
    # Twice the time at which all targets are met leaves little to take; what finishes later lies in ever wider ranges.
    late = 2 * buckets + F.floor(F.log2(F.col("_finish") / 2) * (buckets / 8))
    timed = copies.withColumn("_moment", F.when(F.col("_finish") <= 2, F.floor(F.col("_finish") * buckets)).otherwise(late).cast("int"))
    queue = _running(timed, _totals(timed, [], "_moment"), [], "_moment", [F.col("_finish"), F.col("_mix"), F.col("doc_id")], "_total")
    budget = targets.agg(F.sum("target")).first()[0]
    last = queue.where(F.col("_total") <= F.lit(budget or 0.0)).agg(F.max(place(F.col("_finish"))).alias("last")).first()["last"]
    if last is None:
        count = F.lit(0).cast("long")
    else:
        cut = F.struct(F.lit(last["_finish"]).alias("_finish"), F.lit(last["_mix"]).alias("_mix"), F.lit(last["doc_id"]).cast(rows.schema["doc_id"].dataType).alias("doc_id"))
        count = sum((F.when(finish(k).isNotNull() & (place(finish(k)) <= cut), 1).otherwise(0) for k in range(max_repeats)), F.lit(0)).cast("long")
    out = placed.select("*", count.alias("copies"))
    return out.select(F.col("doc_id").alias(key), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *more)


def mixed_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = 1.5, max_repeats: int = 2, seed: str = "mix", buckets: int | None = None
) -> DataFrame:
    """The documents that the mix takes, all columns, with ``size``, ``target`` (of the source), ``copies`` and ``taken``.

    Where the documents have a column of such a name, underscores are added to the new one's.
    Every row gets the copies of its own, also where keys repeat; otherwise rows are treated as
    in :func:`mix_sources`.
    """
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(source))  # tells apart rows under one key
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), mark.alias("_mark")).where(F.col("doc_id").isNotNull())
    mix = _mixed(durable(rows), "doc_id", weights, share, max_repeats, seed, buckets, "_mark")
    names = [f"_k{i}" for i in range(len(docs.columns))]
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], F.col(key).alias("doc_id"), mark.alias("_mark"))
    equal = Window.partitionBy("doc_id", "_mark")
    number = lambda df, order: df.withColumn("_no", F.row_number().over(equal.orderBy(order)))
    joined = number(inner, F.lit(0)).join(number(mix, F.desc("copies")), ["doc_id", "_mark", "_no"]).where(F.col("copies") > 0)
    more = {c: free_name(c, docs.columns) for c in ("size", "target", "copies", "taken")}
    return joined.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)], *[F.col(c).alias(n) for c, n in more.items()])


ORACLE = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         md5(cast(doc_id as varchar) || ':mix') as mix
  from documents where doc_id is not null
), s as (
  select source, cast(sum(size) as bigint) as source_size from d group by source
), n as (
  select *, row_number() over (order by source nulls last) as no, 2.0::double * source_size as ceiling from s
), w as (
  select *, case (no - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from n
), r as (
  select *, ceiling / weight as ratio, cast(sum(source_size) over () as double) * 1.5::double as budget from w
), l as (
  select *, row_number() over (order by ratio, no) as place,
         (budget - coalesce(sum(ceiling) over b, 0)) / (sum(weight) over () - coalesce(sum(weight) over b, 0)) as level
  from r window b as (order by ratio, no rows between unbounded preceding and 1 preceding)
), t as (
  select source, source_size, case when c is null then ceiling else least(ceiling, c * weight) end as target
  from (select *, arg_min(level, place) filter (level <= ratio) over () as c from l)
), p as (
  select d.doc_id, d.mix, d.source, d.size, t.source_size, t.target,
         cast(sum(d.size) over (partition by d.source order by d.mix, d.doc_id rows unbounded preceding) as bigint) as upto
  from d join t on d.source is not distinct from t.source
), c as (
  select *, cast(upto + k * source_size as double) / target as finish
  from p, (values (0), (1)) v(k) where size > 0 and target > 0
), q as (
  select *, sum(size) over (order by finish, mix, doc_id rows unbounded preceding) as total from c
), g as (
  select doc_id, count(*) as copies from q where total <= (select sum(target) from t) group by doc_id
)
select cast(p.doc_id as bigint) as doc_id, p.size, p.source_size, p.target,
       cast(coalesce(g.copies, 0) * p.size as bigint) as taken
from p left join g using (doc_id)
"""
