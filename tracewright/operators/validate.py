"""Rejecting trajectories with a reason, and checking rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text as tx
from tracewright.session import durable


def parse_trajectories(rows: DataFrame, response: str = "response") -> DataFrame:
    """The rows with a struct ``parsed`` of their sections, read in one pass, and the label ``prediction``."""
    return tx.with_sections(rows, response).withColumn("prediction", tx.answer_label(F.col("parsed.answer"), "lenient"))


def finished(reason: Column, lenient: bool = False) -> Column:
    """Whether generation ended by itself; leniently also where nothing is recorded, and blanks and case do not count."""
    if not lenient:
        return F.coalesce(reason == "stop", F.lit(False))
    return reason.isNull() | F.lower(tx.strip(reason)).isin("stop", "eos", "eos_token")


#: What :func:`reject_reason` can say.
REASONS = ("finish_reason", "malformed_structure", "unparseable_answer", "invalid_gold", "wrong_prediction")


def reject_reason(gold: Column, finish: Column, parsed: Column, prediction: Column) -> Column:
    """The first failing check, null for usable trajectories."""
    complete = F.lit(True)
    for s in tx.SECTIONS:
        complete = complete & parsed[s].isNotNull()
    return (
        F.when(~finished(finish), "finish_reason")
        .when(~complete, "malformed_structure")
        .when(prediction.isNull(), "unparseable_answer")
        .when(gold.isNull(), "invalid_gold")
        .when(prediction != gold, "wrong_prediction")
    )


def pool_reason(finish: Column, response: Column) -> Column:
    """The first failing check of a candidate for judging, null if it passes; right and wrong answers both do.

    A structure that cannot be read is ``malformed::`` and what :func:`strict_tag_error` says.
    """
    error = tx.strict_tag_error(response)
    answer = tx.strip(F.regexp_extract(response, r"(?s)<answer>(.*?)</answer>", 1))
    return (
        F.when(~finished(finish, lenient=True), "finish_reason")
        .when(response.isNull() | (tx.strip(response) == ""), "missing_trajectory")
        .when(error.isNotNull(), F.concat(F.lit("malformed::"), error))
        .when(tx.answer_label(answer, "words").isNull(), "invalid_answer")
    )


def classify(rows: DataFrame) -> DataFrame:
    """Trajectories (``finish_reason, gold, response``) with ``parsed, prediction, reject_reason, target``."""
    out = parse_trajectories(rows)
    reason = reject_reason(F.col("gold"), F.col("finish_reason"), F.col("parsed"), F.col("prediction"))
    return out.withColumn("reject_reason", reason).withColumn("target", F.when(F.col("reject_reason").isNull(), tx.canonical_target(F.col("parsed"))))


def first_present(row: DataFrame, names: list[str], kind: str = "string") -> Column:
    """The first of the named columns that is there and not null."""
    have = [F.col(n).cast(kind) for n in names if n in row.columns]
    return F.coalesce(*have, F.lit(None).cast(kind))


def first_media(own: Column, fallback: Column) -> Column:
    """The first file of the source's list, else of the trajectory's; null without a non-empty name."""
    return F.nullif(F.get(F.when(F.size(own) > 0, own).otherwise(fallback), F.lit(0)), F.lit(""))


def filled(columns: list[str]) -> dict[str, Column]:
    """Rules for :func:`violations` and :func:`require`: the columns are set, and not blank as text."""
    return {f"has_{c}": F.col(c).isNotNull() & (tx.strip(F.col(c).cast("string")) != "") for c in columns}


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``(rule, rows)``: how many rows break each rule; a rule that is null is broken."""
    counts = rows.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(n) for n, ok in rules.items()])
    return counts.unpivot([], list(rules), "rule", "rows")


def require(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows, unchanged; any that breaks a rule raises when it is read."""
    checked = rows
    for name, ok in rules.items():
        checked = checked.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(f"row breaks {name}")).cast("boolean")))
    return checked


def expect_counts(rows: DataFrame, expected: dict[str, int], strict: bool = True) -> dict[str, int]:
    """Compare ``(name, n)`` rows with constants; raise, or return the differing ones."""
    have = {r["name"]: r["n"] for r in rows.where(F.col("name").isin(list(expected))).collect()}
    wrong = {k: have.get(k, 0) for k, v in expected.items() if have.get(k, 0) != v}
    if wrong and strict:
        raise ValueError(f"counts differ: {wrong}, expected {expected}")
    return wrong


def unique_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows, unchanged; raises on reading where keys repeat. One pre-aggregated count, no window."""
    twice = rows.groupBy(*keys).count().where(F.col("count") > 1).limit(1)
    guard = twice.select(F.raise_error(F.concat(F.lit("repeated key: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))).cast("int").alias("_g"))
    return rows.unionByName(guard.where(F.col("_g").isNotNull()).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]))


def with_ordinal(rows: DataFrame, order: list, name: str, totals: dict[str, str] | None = None) -> DataFrame:
    """Number rows 0, 1, ... in order; ``totals`` adds running sums, ``{name: column}``, of the rows so far and their own.

    Ranges are sorted apart and offset by the sizes of those before.
    Ranges are written before they are counted: were one computed again after an executor is lost,
    rows on its border could count in two.
    """
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = durable(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {"_start": F.count("*"), **{f"_start_{k}": F.sum(c) for k, c in (totals or {}).items()}}
    starts = ranged.groupBy("_part").agg(*[s.alias(k) for k, s in sums.items()])
    starts = starts.select("_part", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in sums])
    out = ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
    for k, c in (totals or {}).items():
        out = out.withColumn(k, F.col(f"_start_{k}") + F.sum(c).over(inside))
    return out.drop("_part", *sums)


def length_reason(tokens: Column, reserve: int, limit: int) -> Column:
    """``too_long`` where input and output reserve exceed the limit; nothing is ever cut."""
    return F.when(tokens + reserve > limit, "too_long")


def media_reason(duration: Column, frames: Column, audio: Column, pcm: Column, most_frames: int, tolerance: float, expected_pcm: str) -> Column:
    """Why a media record cannot be used: duration, frames, length difference or format."""
    finite = duration.isNotNull() & ~F.isnan(duration) & (F.abs(duration) < float("inf")) & (duration > 0)
    return (
        F.when(~finite, "bad_duration")
        .when(frames > most_frames, "too_many_frames")
        .when(F.abs(duration - audio) > tolerance, "durations_differ")
        .when(~pcm.eqNullSafe(F.lit(expected_pcm)), "bad_format")
    )


def sft_row(messages: Column, target: Column) -> Column:
    """The messages with the last assistant turn replaced, or one appended where the last turn is another's."""
    turn = F.array(F.struct(F.lit("assistant").alias("role"), target.alias("content")))
    ends = F.try_element_at(messages, F.lit(-1))["role"] == "assistant"
    return F.when(ends, F.concat(F.slice(messages, F.lit(1), F.size(messages) - 1), turn)).otherwise(F.concat(messages, turn))


#: What a training row keeps of a trajectory beside its messages and media.
AUDIT_COLUMNS = ("source_id", "label", "sample_idx", "mean_token_logprob")


def sft_rows(rows: DataFrame, variant: str, messages: str = "messages", target: str = "target") -> DataFrame:
    """Training rows: messages with the target, media lists that are not empty, audit columns, and the variant's name.

    Nothing else of the trajectory gets in. ``source_id`` and ``label`` must be set.
    """
    media = [F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("videos", "audios") if c in rows.columns]
    said = {"source_id": "string", "label": "int", "sample_idx": "int", "mean_token_logprob": "double"}
    names = {"sample_idx": "teacher_sample_idx", "mean_token_logprob": "teacher_mean_token_logprob"}
    audit = [(F.col(c) if c in rows.columns else F.lit(None)).cast(said[c]).alias(names.get(c, c)) for c in AUDIT_COLUMNS]
    checked = require(rows, {c: F.col(c).isNotNull() for c in ("source_id", "label")})
    return checked.select(sft_row(F.col(messages), F.col(target)).alias("messages"), *media, *audit, F.lit(variant).alias("sft_variant"))


#: Columns that a prompt may be built from; gold labels, predictions and integration are not among them.
PROMPT_COLUMNS = ("id", "source_id", "transcript", "text_evidence", "audio_evidence", "visual_evidence", "audios", "videos")


def prompt_columns(rows: DataFrame) -> DataFrame:
    """Only what a prompt may see."""
    return rows.select(*[c for c in rows.columns if c in PROMPT_COLUMNS])


def refuse_leaks(rows: DataFrame) -> DataFrame:
    """The rows, unchanged; raises if they have a column that a prompt must not see."""
    if leaks := [c for c in rows.columns if c not in PROMPT_COLUMNS]:
        raise ValueError(f"not for a prompt: {leaks}")
    return rows


def same_run(old: dict, new: dict) -> None:
    """Refuse to resume where the settings of a run have changed."""
    wrong = sorted(k for k in {*old, *new} if old.get(k) != new.get(k))
    if wrong:
        raise ValueError(f"settings differ from the run to resume: {wrong}")
