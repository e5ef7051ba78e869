"""Rewards of completions: accuracy, format, grounding (gated, scheduled, by group trust) and their sum.

Rewards are columns over parsed trajectories (:func:`tracewright.operators.validate.parse_trajectories`)
and raw grounding scores that a judge has given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text as tx
from tracewright.functions.numeric import linear_factor
from tracewright.session import ship_package

WEIGHTS = {"accuracy": 1.0, "format": 0.2, "grounding": 0.2}


def accuracy_reward(parsed: Column, gold: Column) -> Column:
    """1.0 if the answer, strictly spelled, is the gold label."""
    return F.coalesce((tx.answer_label(parsed["answer"], "exact") == gold).cast("double"), F.lit(0.0))


def format_reward(parsed: Column) -> Column:
    return F.coalesce(tx.format_valid(parsed), F.lit(False)).cast("double")


def needs_judge(parsed: Column, gold: Column) -> Column:
    """Only correct completions with all reasoning sections are worth a judge's call; filter before judging."""
    return (accuracy_reward(parsed, gold) == 1.0) & tx.reasoning(parsed).isNotNull()


def input_error(transcript: Column, audio: Column, video: Column) -> Column:
    """What a completion's input lacks for a judge, null if nothing: a transcript that is not blank, and names of an audio and a video file (lists)."""
    first = lambda files: F.nullif(tx.strip(F.get(files, F.lit(0))), F.lit(""))
    return (
        F.when(F.coalesce(tx.strip(transcript), F.lit("")) == "", "missing_transcript")
        .when(first(audio).isNull(), "missing_audio")
        .when(first(video).isNull(), "missing_video")
    )


def require_inputs(rows: DataFrame, transcript: str = "transcript", audio: str = "audios", video: str = "videos") -> DataFrame:
    """The rows, unchanged; one whose input is not complete raises when it is read, whether its reward needs a judge or not."""
    error = input_error(F.col(transcript), F.col(audio), F.col(video))
    return rows.where(F.when(error.isNull(), True).otherwise(F.raise_error(F.concat(F.lit("input of a completion: "), error)).cast("boolean")))


def gated_reward(parsed: Column, gold: Column, raw: Column) -> Column:
    """The raw grounding score of correct, complete completions, 0 for others; raises where a needed score is missing."""
    score = F.when(raw.isNull(), F.raise_error(F.lit("no judgement for a completion that needs one")).cast("double")).otherwise(raw)
    return F.when(needs_judge(parsed, gold), score).otherwise(F.lit(0.0))


def scheduled_reward(reward: Column, step: int, total: int, zero: float = 0.1, full: float = 0.4) -> Column:
    """The reward times the schedule's factor; at factor 0 the reward is not even computed."""
    factor = linear_factor(step, total, zero, full)
    return F.lit(0.0) if factor == 0.0 else reward * F.lit(factor)


def trust_groups(rows: DataFrame, group: str = "group_id", correct: str = "correct", raw: str = "raw", margin: float = 0.0) -> DataFrame:
    """One row a group: its type, the mean raw score of correct and wrong rows, their difference and whether it is trusted.

    Types: ``all_wrong``, ``all_correct``, ``trusted``, ``untrusted``, ``unscorable``.
    """
    c, r = F.col(correct), F.col(raw)
    g = rows.groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(c).alias("k"), F.avg(F.when(c, r)).alias("mean_correct"), F.avg(F.when(~c, r)).alias("mean_wrong")
    ).withColumn("delta", F.when((F.col("k") > 0) & (F.col("k") < F.col("n")), F.col("mean_correct") - F.col("mean_wrong")))
    kind = (
        F.when(F.col("k") == 0, "all_wrong")
        .when(F.col("k") == F.col("n"), "all_correct")
        .when(F.col("delta").isNull(), "unscorable")
        .when(F.col("delta") > margin, "trusted")
        .otherwise("untrusted")
    )
    return g.withColumn("group_type", kind)


def trust_reward(rows: DataFrame, factor: float, group: str = "group_id", correct: str = "correct", raw: str = "raw", margin: float = 0.0) -> DataFrame:
    """The rows with ``group_type`` and ``trust_reward``: factor times raw score for correct rows of trusted groups.

    Groups are small and many, so one window by group needs no more than their own rows together.
    """
    w = Window.partitionBy(group)
    c, r = F.col(correct), F.col(raw)
    out = rows.withColumns({"_n": F.count("*").over(w), "_k": F.count_if(c).over(w), "_c": F.avg(F.when(c, r)).over(w), "_w": F.avg(F.when(~c, r)).over(w)})
    delta = F.col("_c") - F.col("_w")
    kind = (
        F.when(F.col("_k") == 0, "all_wrong")
        .when(F.col("_k") == F.col("_n"), "all_correct")
        .when(delta.isNull(), "unscorable")
        .when(delta > margin, "trusted")
        .otherwise("untrusted")
    )
    paid = F.when((kind == "trusted") & c & r.isNotNull(), r * factor).otherwise(F.lit(0.0))
    return out.withColumn("group_type", kind).withColumn("trust_reward", paid).drop("_n", "_k", "_c", "_w")


def trust_stats(groups: DataFrame) -> DataFrame:
    """One row over :func:`trust_groups`: counts by type, shares, and least, mean and largest difference (null if none)."""
    kinds = ("all_wrong", "all_correct", "trusted", "untrusted", "unscorable")
    n = F.count("*")
    return groups.agg(
        n.alias("groups"),
        *[F.count_if(F.col("group_type") == k).alias(f"n_{k}") for k in kinds],
        (F.count_if(F.col("group_type") == "trusted") / F.when(n > 0, n)).alias("trusted_rate"),
        F.min("delta").alias("min_delta"),
        F.avg("delta").alias("mean_delta"),
        F.max("delta").alias("max_delta"),
    )


def total_reward(accuracy: Column, form: Column, grounding: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    return accuracy * weights["accuracy"] + form * weights["format"] + grounding * weights["grounding"]


def logged_steps(rows: DataFrame, every: int, run: str, step: str = "step", phase: str = "phase") -> DataFrame:
    """Snapshots worth keeping of each run: the first, each change of phase, and every ``every``-th step."""
    w = Window.partitionBy(run).orderBy(step)
    before = F.lag(phase).over(w)
    return rows.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col(phase)) | (F.col(step) % every == 0)).drop("_b")


@dataclass(frozen=True)
class Plugin:
    """A reward by name: a function of columns, or, for batches, of a pandas frame of ``inputs``, one number a row."""

    function: Callable
    inputs: tuple[str, ...]
    batch: bool = False


#: Registered rewards by name.
PLUGINS: dict[str, Plugin] = {}


def register(name: str, function: Callable, inputs: tuple[str, ...], batch: bool = False) -> None:
    """Register a reward; a name that is taken raises."""
    if name in PLUGINS:
        raise ValueError(f"there is a reward {name!r}")
    PLUGINS[name] = Plugin(function, tuple(inputs), batch)


def rewarded(rows: DataFrame, names: list[str]) -> DataFrame:
    """The rows with a column for each named reward. Those over columns stay in the JVM; batches go through Arrow."""
    for name in names:
        if name not in PLUGINS:
            raise KeyError(f"no reward {name!r}; there are {sorted(PLUGINS)}")
        p = PLUGINS[name]
        if not p.batch:
            rows = rows.withColumn(name, p.function(*[F.col(c) for c in p.inputs]).cast("double"))
            continue

        ship_package(rows.sparkSession)
        rows = rows.withColumn(name, F.pandas_udf(_batched(p), "double")(F.struct(*[F.col(c) for c in p.inputs])))
    return rows


def _batched(p: Plugin) -> Callable:
    def run(frame: pd.DataFrame) -> pd.Series:
        out = p.function(frame)
        if len(out) != len(frame):
            raise ValueError(f"{len(out)} rewards for {len(frame)} rows")
        return pd.Series(list(out), dtype="float64")

    return run


register("accuracy", accuracy_reward, ("parsed", "gold"))
register("format", format_reward, ("parsed",))
register("gated", gated_reward, ("parsed", "gold", "raw"))
