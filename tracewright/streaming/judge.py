"""Judging with a pluggable model: retries, isolation of failing rows, resume, and the streaming form.

A model is a function from a list of prompts to a list of responses. It runs inside
``mapInPandas``; the engine itself runs none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.numeric import progress
from tracewright.operators.joins import pending_from
from tracewright.session import ship_package
from tracewright.sources.io import _fs, read_jsonl, read_stats
from tracewright.streaming import journal as jn
from tracewright.streaming.journal import JOURNAL, writing  # noqa: F401 - part of this module's interface

Model = Callable[[list[str]], list[str]]
_COLUMNS = [c.split()[0] for c in JOURNAL.split(", ")]


def halving(model: Model, prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """``(response, failure)`` of each prompt; a batch that raises is split until the failing prompt is alone."""
    if not prompts:
        return []
    try:
        out = model(prompts)
        if len(out) != len(prompts):
            raise RuntimeError(f"{len(out)} responses to {len(prompts)} prompts")
        return [(x, None) for x in out]
    except Exception as e:  # noqa: BLE001 - recorded with the row
        if len(prompts) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        middle = len(prompts) // 2
        return halving(model, prompts[:middle]) + halving(model, prompts[middle:])


def calls(frames: Iterator[pd.DataFrame], most: int, together: str | None = None, whole: str | None = None) -> Iterator[pd.DataFrame]:
    """Frames cut into what one call of the model gets.

    By number: ``most`` rows each. With ``together``: rows of one value, which follow each other, stay in one call, and
    the next value begins a new call where it would not fit; a value with more rows is a call of its own. With
    ``whole``: the rows of one value are one call, as they have been packed before.
    """
    by = whole or together
    if by is None:
        for frame in frames:
            for lo in range(0, len(frame), most):
                yield frame.iloc[lo : lo + most]
        return
    call: list[pd.DataFrame] = []  # rows that wait, and those of the value that may go on in the next frame
    group: list[pd.DataFrame] = []
    last = None
    size = lambda parts: sum(map(len, parts))
    for frame in frames:
        keys = frame[by].astype(object).where(frame[by].notna(), None).tolist()
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if group and keys[lo] != last:
                if call and (whole or size(call) + size(group) > most):
                    yield pd.concat(call)
                    call = []
                call += group
                group = []
            group.append(frame.iloc[lo:hi])
            last = keys[lo]
    if call and group and (whole or size(call) + size(group) > most):
        yield pd.concat(call)
        call = []
    if call + group:
        yield pd.concat(call + group)


def judged(model: Model, valid: Callable[[str], bool], batch: int = 64, attempts: int = 3, together: str | None = None, whole: str | None = None, carried: tuple[str, ...] = ()):
    """A ``mapInPandas`` function over ``(judge_id, prompt)`` that gives :data:`JOURNAL` rows, and columns that it carries.

    Only invalid responses are asked again, up to ``attempts`` calls in all. :func:`calls` tells what one call gets.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in calls(frames, batch, together, whole):
            ids, prompts = some["judge_id"].tolist(), some["prompt"].tolist()
            result: list = [None] * len(ids)
            open_rows = list(range(len(ids)))
            for n in range(1, attempts + 1):
                for i, (text, failure) in zip(open_rows, halving(model, [prompts[i] for i in open_rows])):
                    result[i] = (ids[i], text, text is not None and bool(valid(text)), n, failure)
                open_rows = [i for i in open_rows if not result[i][2]]
                if not open_rows:
                    break
            out = pd.DataFrame(result, columns=_COLUMNS)
            for name in carried:
                out[name] = some[name].to_numpy()
            yield out

    return run


def by_source(rows: DataFrame, source: str = "source_id", order: str = "raw_index") -> DataFrame:
    """Rows of a source next to each other in one task, so that its media are decoded once."""
    return rows.repartition(source).sortWithinPartitions(source, order)


def judge(rows: DataFrame, model: Model, valid, batch: int = 64, attempts: int = 3, together: str | None = None, whole: str | None = None, carried: str = "") -> DataFrame:
    """Rows through the model. ``together`` and ``whole`` deal the rows by that column first, see :func:`calls`; ``carried`` declares columns to keep."""
    ship_package(rows.sparkSession)
    names = tuple(c.split()[0] for c in carried.split(", ") if c)
    by = whole or together
    wanted = rows.select(F.col("judge_id").cast("string").alias("judge_id"), "prompt", *dict.fromkeys([*([by] if by else []), *names]))
    if by:
        wanted = wanted.repartition(by).sortWithinPartitions(by, "judge_id")
    return wanted.mapInPandas(judged(model, valid, batch, attempts, together, whole, names), f"{JOURNAL}, {carried}" if carried else JOURNAL)


def resume(
    spark: SparkSession,
    rows: DataFrame,
    journal: str,
    model: Model,
    valid,
    settings: dict | None = None,
    retry_failures: bool = False,
    part_of_input: bool = False,
    together: str | None = None,
    buckets: int = 256,
    rows_per_commit: int = 10_000,
    **options,
) -> dict:
    """Judge what the journal does not have, ``rows_per_commit`` rows at a time, each time committed before the next; returns the journal's state.

    A run that is killed loses the rows of one commit, and the next run asks the model for no row that is committed.
    Failures count as had unless ``retry_failures``. The run's ``settings`` are kept beside the journal, and
    later runs must have the same. A journal with ids that are not among ``rows`` is refused, unless they are
    only a ``part_of_input``. Rows with one value of ``together`` (a source, whose media are decoded once) are judged in one call of
    the model, or in calls of their own. One writer at a time.
    """
    fs, at = _fs(spark, journal)
    journal = journal.rstrip("/")
    with writing(spark, journal):
        state = jn.open_journal(spark, journal, settings, buckets)
        key = F.col(together).cast("string") if together else F.col("judge_id").cast("string")
        rows = rows.withColumn("judge_id", F.col("judge_id").cast("string")).withColumn("bucket", jn.bucket_of(key, state["n"]))
        todo = _unjudged(spark, rows, journal, state, retry_failures, part_of_input)
        if todo is None:
            return state
        # The rows that wait are written once, by bucket; each commit reads its own.
        queue = f"{journal}.queue"
        todo.repartition("bucket").write.partitionBy("bucket").parquet(queue)
        waiting = spark.read.schema(todo.schema).parquet(queue)
        counts = {r["bucket"]: r["count"] for r in waiting.groupBy("bucket").count().collect()}
        for mine, part, parts in jn.units(counts, rows_per_commit):
            some = waiting.where(F.col("bucket").isin(mine))
            if parts > 1:
                some = some.where(jn.part_of(F.col(together).cast("string") if together else F.col("judge_id"), parts) == part)
            if not together:
                some = some.repartition(max(1, min(spark.sparkContext.defaultParallelism, rows_per_commit)))
            state = jn.commit(spark, journal, state, judge(some, model, valid, together=together, carried=jn.CARRIED, **options))
        fs.delete(at(queue), True)
        return state


def _unjudged(spark: SparkSession, rows: DataFrame, journal: str, state: dict, retry_failures: bool, part_of_input: bool) -> DataFrame | None:
    """The rows to judge, with ``again``; null if there are none. Of the journal only those buckets are read that the sums leave open."""
    want, had = jn.bucket_sums(rows), state["buckets"]
    same = {b for b, w in want.items() if b in had and had[b]["ids"] == w["ids"] and had[b]["sum"] == w["sum"]}
    strange = [int(b) for b in had if b not in want]
    if not part_of_input and strange:
        raise ValueError(f"the journal has ids outside the input, among them {_some(jn.rows_of(spark, journal, strange))}")
    again = {b for b in same if retry_failures and had[b]["failed"]}
    open_ = sorted(int(b) for b in want if b not in same or b in again)
    if not open_:
        return None
    todo = rows.where(F.col("bucket").isin(open_))
    known = [b for b in open_ if str(b) in had]
    if not known:
        return todo.withColumn("again", F.lit(False))
    there = jn.rows_of(spark, journal, known).where(F.col("judge_id").isNotNull())
    if not part_of_input and (some := _some(there.join(todo.select("judge_id"), "judge_id", "left_anti"))):
        raise ValueError(f"the journal has ids outside the input, among them {some}")
    if not retry_failures:
        return pending_from(todo, there, "judge_id").withColumn("again", F.lit(False))
    seen = there.groupBy("judge_id").agg(F.max("parse_ok").alias("_ok"))
    return todo.join(seen, "judge_id", "left").where(~F.coalesce("_ok", F.lit(False))).withColumn("again", F.col("_ok").isNotNull()).drop("_ok")


def _some(rows: DataFrame) -> list[str]:
    return [r[0] for r in rows.select("judge_id").limit(5).collect()]


def judge_stream(spark: SparkSession, source: str, schema: str, journal: str, checkpoint: str, model: Model, valid, settings: dict | None = None, buckets: int = 256, files_per_batch: int | None = None, **options):
    """The streaming form over new JSON files: each micro-batch is judged and becomes one commit of the journal.

    Ids that the stream has seen are known to its state store, by key; the journal is not read for them, so the cost of a
    batch does not follow the journal. Only what other writers have put there is compared, if there is any. A batch that
    is repeated after a crash finds its commit by its number. The checkpoint folder lets one query run at a
    time, and the journal's lock one writer of any kind.
    """
    writer = "stream-" + hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    journal = journal.rstrip("/")

    def batch(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        with writing(session, journal):
            state = jn.open_journal(session, journal, settings, buckets)
            if jn.has_batch(state, writer, number):
                return
            todo = rows.withColumn("bucket", jn.bucket_of(F.col("judge_id"), state["n"])).withColumn("again", F.lit(False))
            if any(n for w, n in state["writers"].items() if w != writer):
                todo = pending_from(todo, jn.rows_of(session, journal, but=writer), "judge_id")
            jn.commit(session, journal, state, judge(todo, model, valid, carried=jn.CARRIED, **options), writer, number)

    read = spark.readStream.schema(schema)
    if files_per_batch:
        read = read.option("maxFilesPerTrigger", files_per_batch)
    stream = read.json(source).withColumn("judge_id", F.col("judge_id").cast("string")).where(F.col("judge_id").isNotNull()).dropDuplicates(["judge_id"])
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_of(spark: SparkSession, journal: str, total: int, elapsed: float) -> dict:
    """How far a run is: rows done and failed, whole percent and seconds left (null before the first row).

    Read from the journal's state, a small file whatever the journal's size; a journal of another writer, without state, is read through.
    """
    state = read_stats(spark, f"{journal.rstrip('/')}.state.json")
    if state is not None:
        sums = spark.range(1).select(F.lit(state["done"]).alias("done"), F.lit(state["failed"]).alias("failed"))
    else:
        rows = read_jsonl(spark, journal, JOURNAL, "resume").where(F.col("judge_id").isNotNull())
        sums = rows.groupBy("judge_id").agg(F.max("parse_ok").alias("ok")).agg(F.count("*").alias("done"), F.count_if(~F.col("ok")).alias("failed"))
    return sums.select("*", progress(F.col("done"), F.lit(total), F.lit(elapsed)).alias("p")).select("done", "failed", "p.*").first().asDict()


def completeness(files: set[str], rows: int | None, expected: int) -> str:
    """``complete``, ``partial``, ``legacy`` (scores without predictions) or ``absent`` for a checkpoint's outputs."""
    if not files:
        return "absent"
    if {"predictions", "metrics", "scored"} <= files and rows == expected:
        return "complete"
    if "metrics" in files and "predictions" not in files:
        return "legacy"
    return "partial"
