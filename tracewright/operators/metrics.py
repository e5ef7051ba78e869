"""Counts, class metrics, agreement and paired summaries, each in one pre-aggregated pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.numeric import ratio


def counts(rows: DataFrame, by: str, name: str = "n") -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias(name))


def group_size_stats(rows: DataFrame, group: str) -> DataFrame:
    """One row: groups, and the least, most and mean number of rows in a group."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("groups"), F.min("n").alias("min_rows"), F.max("n").alias("max_rows"), F.avg("n").alias("mean_rows"))


def without_survivor(rows: DataFrame, group: str, kept: Column) -> DataFrame:
    return rows.groupBy(group).agg(F.count_if(kept).alias("_n")).where("_n = 0").select(group)


def _class_counts(gold: Column, pred: Column, value: int, name: str) -> list[Column]:
    hit, mine, said = gold.eqNullSafe(F.lit(value)) & pred.eqNullSafe(F.lit(value)), gold.eqNullSafe(F.lit(value)), pred.eqNullSafe(F.lit(value))
    return [
        F.count_if(hit).alias(f"tp_{name}"),
        F.count_if(said & ~mine).alias(f"fp_{name}"),
        F.count_if(mine & ~hit).alias(f"fn_{name}"),
        F.count_if(mine).alias(f"support_{name}"),
    ]


def _prf(name: str) -> dict[str, Column]:
    tp, fp, fn = (F.col(f"{k}_{name}") for k in ("tp", "fp", "fn"))
    return {f"precision_{name}": ratio(tp, tp + fp), f"recall_{name}": ratio(tp, tp + fn), f"f1_{name}": ratio(2 * tp, 2 * tp + fp + fn)}


def binary_metrics(rows: DataFrame, gold: str = "gold", pred: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """Class counts, precision, recall, F1, the confusion with invalid cells, macro means, accuracy and parse rate.

    A missing prediction counts as a miss of its gold class; accuracy is over all rows.
    """
    g, p = F.col(gold), F.col(pred)
    cell = lambda a, b: F.count_if(g.eqNullSafe(F.lit(a)) & (p.isNull() if b is None else p.eqNullSafe(F.lit(b))))
    out = rows.groupBy(*(by or [])).agg(
        F.count("*").alias("total"),
        F.count(p).alias("parsed"),
        *_class_counts(g, p, 0, "neg"),
        *_class_counts(g, p, 1, "pos"),
        cell(0, 0).alias("tn"),
        cell(0, 1).alias("fp"),
        cell(1, 0).alias("fn"),
        cell(1, 1).alias("tp"),
        cell(0, None).alias("invalid_neg"),
        cell(1, None).alias("invalid_pos"),
    )
    out = out.withColumns(_prf("neg") | _prf("pos"))
    macro = {f"macro_{k}": (F.col(f"{k}_neg") + F.col(f"{k}_pos")) / 2.0 for k in ("precision", "recall", "f1")}
    return out.withColumns(macro | {"accuracy": ratio(F.col("tn") + F.col("tp"), F.col("total")), "parse_rate": ratio(F.col("parsed"), F.col("total"))})


def teacher_metrics(rows: DataFrame, gold: str = "gold", pred: str = "prediction", complete: str = "complete") -> DataFrame:
    """As :func:`binary_metrics`, but rows without a prediction are dropped, and the macro mean is over the classes that occur."""
    g, p = F.col(gold), F.col(pred)
    read = p.isNotNull()
    kept = lambda c: F.when(read, c)
    out = rows.agg(
        F.count("*").alias("total"),
        F.count(p).alias("parsed"),
        F.count_if(p.isNull()).alias("parse_errors"),
        F.count_if(~F.col(complete)).alias("incomplete"),
        F.count_if(read & g.eqNullSafe(p)).alias("hits"),
        *_class_counts(kept(g), p, 0, "neg"),
        *_class_counts(kept(g), p, 1, "pos"),
    ).withColumns(_prf("neg") | _prf("pos"))
    there = {n: ((F.col(f"tp_{n}") + F.col(f"fp_{n}") + F.col(f"fn_{n}")) > 0).cast("int") for n in ("neg", "pos")}
    macro = ratio(F.col("f1_neg") * there["neg"] + F.col("f1_pos") * there["pos"], there["neg"] + there["pos"])
    return out.withColumns({"accuracy": ratio(F.col("hits"), F.col("parsed")), "macro_f1": macro})


def component_metrics(rows: DataFrame, components: tuple[str, ...], gold: str = "gold_", pred: str = "pred_") -> DataFrame:
    """:func:`binary_metrics` for every component, one row each."""
    pairs = F.array(*[F.struct(F.lit(c).alias("component"), F.col(gold + c).alias("gold"), F.col(pred + c).alias("prediction")) for c in components])
    long = rows.select(F.explode(pairs).alias("x")).select("x.*")
    return binary_metrics(long, by=["component"])


def component_summary(rows: DataFrame, components: tuple[str, ...], excluded: str = "integration", gold: str = "gold_", pred: str = "pred_") -> DataFrame:
    """One row: exact-pattern accuracy, mean component accuracy and F1, and the macro F1 without ``excluded``."""
    same = F.lit(True)
    for c in components:
        same = same & F.coalesce(F.col(gold + c) == F.col(pred + c), F.lit(False))
    exact = rows.agg(F.count("*").alias("total"), F.count_if(same).alias("exact")).withColumn("pattern_accuracy", ratio(F.col("exact"), F.col("total")))
    each = component_metrics(rows, components, gold, pred).agg(
        F.avg("accuracy").alias("mean_accuracy"), F.avg("macro_f1").alias("mean_f1"), F.avg(F.when(F.col("component") != excluded, F.col("macro_f1"))).alias("evidence_macro_f1")
    )
    return exact.withColumn("_k", F.lit(1)).join(each.withColumn("_k", F.lit(1)), "_k").drop("_k")


def agreement(rows: DataFrame, human: str = "human", pred: str = "pred") -> DataFrame:
    """Agreement, macro F1 and Cohen's kappa over the rows with a prediction; kappa is null where chance agreement is 1."""
    m = teacher_metrics(rows.withColumn("_c", F.lit(True)), human, pred, "_c")
    n = F.col("parsed").cast("double")
    said = {k: F.col(f"tp_{k}") + F.col(f"fp_{k}") for k in ("neg", "pos")}
    chance = (F.col("support_neg") * said["neg"] + F.col("support_pos") * said["pos"]) / F.when(n > 0, n * n)
    kappa = F.when(chance < 1, (F.col("accuracy") - chance) / F.when(chance < 1, 1 - chance))
    return m.select("total", "parsed", F.col("accuracy").alias("agreement"), "macro_f1", kappa.alias("kappa"))


def hard_negative_summary(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    g, p = F.col(gold), F.col(pred)
    return rows.agg(
        F.count("*").alias("total"),
        F.count(p).alias("parse_ok"),
        F.count_if(F.coalesce(g == p, F.lit(False))).alias("correct"),
        F.count_if(g == 0).alias("negatives"),
        F.count_if((g == 0) & F.coalesce(p == 0, F.lit(False))).alias("detected"),
    )


def distinct_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, rows, known, different)``: all rows, those with a value, and different values, of each column, in one pass over long rows."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("column").agg(F.count("*").alias("rows"), F.count("v").alias("known"), F.count_distinct("v").alias("different"))


def patterns(rows: DataFrame, components: tuple[str, ...], prefix: str = "", seen: str | None = None) -> DataFrame:
    """``(pattern, n)``, e.g. ``1011``, most frequent first; ties by pattern, or by first appearance in the order of ``seen``."""
    p = F.concat(*[F.col(prefix + c).cast("string") for c in components])
    if seen:
        out = rows.groupBy(p.alias("pattern")).agg(F.count("*").alias("n"), F.min(seen).alias("_first"))
        return out.orderBy(F.col("n").desc(), "_first").drop("_first")
    return rows.groupBy(p.alias("pattern")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "pattern")


def component_rates(rows: DataFrame, components: tuple[str, ...], prefix: str = "") -> DataFrame:
    """``(component, supported, unsupported, rate)``, the rate rounded to six places."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(prefix + c).alias("v")) for c in components])).alias("x")).select("x.*")
    out = long.groupBy("component").agg(F.count_if(F.col("v") == 1).alias("supported"), F.count_if(F.col("v") == 0).alias("unsupported"))
    return out.withColumn("rate", F.round(ratio(F.col("supported"), F.col("supported") + F.col("unsupported")), 6))


def histogram(rows: DataFrame, value: str, lo: int, hi: int) -> DataFrame:
    """``(value, n)`` for every value from ``lo`` to ``hi``, 0 where absent."""
    every = rows.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias(value))
    have = rows.groupBy(F.col(value).cast("int").alias(value)).agg(F.count("*").alias("n"))
    return every.join(have, value, "left").select(value, F.coalesce("n", F.lit(0)).alias("n"))


SUBSETS = ("all", "both_right", "fixed", "broken", "both_wrong")


def paired_summary(rows: DataFrame, components: tuple[str, ...] = ("text", "audio", "visual", "integration"), a: str = "a_", b: str = "b_") -> DataFrame:
    """Two models on the same rows, by subset of who is right: support rates, evidence mean, their differences, wins.

    Needs ``a_right, b_right`` and, for each component, ``a_<c>, b_<c>``; only rows where all of
    these are known count as valid. Means of nothing are null.
    """
    ar, br = F.col(f"{a}right"), F.col(f"{b}right")
    member = F.array(F.lit("all"), F.when(ar & br, "both_right").when(~ar & br, "fixed").when(ar & ~br, "broken").otherwise("both_wrong"))
    known = F.lit(True)
    for c in components:
        known = known & F.col(a + c).isNotNull() & F.col(b + c).isNotNull()
    long = rows.withColumn("valid", known).withColumn("subset", F.explode(member))
    v = lambda c: F.when(F.col("valid"), c)
    tav = {m: F.col(m + "text") + F.col(m + "audio") + F.col(m + "visual") for m in (a, b)}
    rates = [F.avg(v(F.col(m + c))).alias(f"{m}{c}_support") for m in (a, b) for c in components]
    out = long.groupBy("subset").agg(
        F.count("*").alias("selected"),
        F.count_if("valid").alias("valid_pairs"),
        *rates,
        *[F.avg(v(tav[m] / 3.0)).alias(f"{m}evidence") for m in (a, b)],
        *[F.avg(v((tav[m] == 3).cast("int"))).alias(f"{m}all_three") for m in (a, b)],
        F.count_if(F.col("valid") & (tav[b] > tav[a])).alias("wins"),
        F.count_if(F.col("valid") & (tav[b] == tav[a])).alias("ties"),
        F.count_if(F.col("valid") & (tav[b] < tav[a])).alias("losses"),
    )
    deltas = {f"delta_{c}": F.col(f"{b}{c}") - F.col(f"{a}{c}") for c in (*[f"{c}_support" for c in components], "evidence", "all_three")}
    return out.withColumns(deltas)


def score_stats(rows: DataFrame, scores: tuple[str, ...]) -> DataFrame:
    """``(modality, n_1, n_2, n_3, mean, std, mean_reward)``, with the population deviation."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(s).alias("modality"), F.col(s).alias("v")) for s in scores])).alias("x")).select("x.*")
    return long.groupBy("modality").agg(
        *[F.count_if(F.col("v") == k).alias(f"n_{k}") for k in (1, 2, 3)],
        F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("std"),
        F.avg((F.col("v") - 1) / 2.0).alias("mean_reward"),
    )


def diagnostics(rows: DataFrame, fields: tuple[str, ...], scores: tuple[str, ...]) -> DataFrame:
    """``(field, value, n, mean_<score>...)`` for each value of each outcome field; rows without the field are skipped."""
    have = [f for f in fields if f in rows.columns]
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in have])
    long = rows.select(*scores, F.explode(pairs).alias("x")).where(F.col("x.value").isNotNull())
    return long.groupBy(F.col("x.field").alias("field"), F.col("x.value").alias("value")).agg(F.count("*").alias("n"), *[F.avg(s).alias(f"mean_{s}") for s in scores])


def journal_summary(rows: DataFrame, total: int, key: str = "judge_id", order: str = "seq", ok: str = "ok", attempts: str = "attempts") -> DataFrame:
    """One row: ids that succeeded, failed at last (and never succeeded), are pending, and needed several attempts."""
    per_id = rows.groupBy(key).agg(F.max(F.col(ok).cast("int")).alias("done"), F.max(F.when(F.col(ok), F.col(attempts))).alias("tries"))
    out = per_id.agg(F.count_if(F.col("done") == 1).alias("succeeded"), F.count_if(F.col("done") == 0).alias("failed"), F.count_if((F.col("done") == 1) & (F.col("tries") > 1)).alias("retry_recovered"))
    return out.withColumn("pending", F.lit(total) - F.col("succeeded") - F.col("failed"))


def latest(rows: DataFrame, key: str, order: str, ok: str) -> DataFrame:
    """The journal row of each id that counts: the last success, else the last failure."""
    best = rows.groupBy(key).agg(F.max(F.struct(F.col(ok).cast("int").alias("o"), F.col(order).alias("s"))).alias("_b"))
    return rows.join(best.select(F.col(key), F.col("_b.s").alias(order)), [key, order])


def id_lists(rows: DataFrame, group: str, key: str, order: str, reason: str = "reject_reason") -> DataFrame:
    """For each group, its kept ids in order and its rejected ids with their last reason.

    Lists are as long as a group (a source's samples), never as the table.
    """
    kept = F.collect_list(F.when(F.col(reason).isNull(), F.struct(F.col(order).alias("o"), F.col(key).alias("k"))))
    last = rows.groupBy(group, key).agg(F.max(F.struct(F.col(order).alias("o"), F.col(reason).alias("r"))).alias("_l"))
    lost = last.where(F.col("_l.r").isNotNull()).groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, F.col("_l.r"))))).alias("rejected"))
    out = rows.groupBy(group).agg(F.transform(F.array_sort(kept), lambda x: x["k"]).alias("kept"))
    return out.join(lost, group, "left")
