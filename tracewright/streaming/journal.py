"""A journal of judged rows, written in commits: each is there as a whole or not at all, whenever a run is killed.

==========================================================  =============================================
``<journal>/writer=<w>/commit=<n>/bucket=<b>/part-*.json``  rows, see :data:`JOURNAL`
``<journal>/writer=<w>/commit=<n>/_facts.json``             what the commit adds, by bucket
``<journal>.state.json``                                    the sums of all commits, as large for many as for few
``<journal>.meta.json``                                     settings of the run, and the number of buckets
``<journal>.staging``, ``<journal>.queue``                  a commit that is being written; rows that wait for one
``<journal>.lock``                                          there while somebody writes
==========================================================  =============================================

A commit is written beside the journal, with its facts, and becomes part of it by one rename. The state follows; a run
that finds one more commit than the state knows of takes its facts in. A row's bucket comes from the hash of its id (or
of what it has to stay together with), and the state has the number of ids of each bucket and an order-free digest of
them. So a bucket of the input whose ids are all judged is told by comparing sums, and the journal is read for the others only.
"""

from __future__ import annotations

import os
import socket
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.validate import same_run
from tracewright.sources.io import _fs, key_sum, read_small, read_stats, write_stats

JOURNAL = "judge_id string, raw_output string, parse_ok boolean, attempts int, failure string"
#: What rows carry besides while they are judged: whether they were in the journal before, and their bucket.
CARRIED = "again boolean, bucket int"


# --- the lock ---------------------------------------------------------------------


@contextmanager
def writing(spark: SparkSession, journal: str) -> Iterator[None]:
    """Be the journal's only writer.

    The lock is a file beside it that names host and process. A lock whose process has ended on this host is taken
    over; one of another host has to be removed by hand after a crash.
    """
    fs, at = _fs(spark, journal)
    lock = at(f"{journal.rstrip('/')}.lock")
    me = f"{socket.gethostname()} {os.getpid()}"
    try:
        out = fs.create(lock, False)
    except Py4JJavaError as e:
        if not fs.exists(lock):
            raise
        if not _ended(read_small(spark, lock.toString()) or ""):
            raise RuntimeError(f"another process is writing this journal, or has left {lock.toString()}") from e
        fs.delete(lock, False)
        out = fs.create(lock, False)
    out.write(bytearray(me.encode()))
    out.close()
    try:
        yield
    finally:
        fs.delete(lock, False)


def _ended(owner: str) -> bool:
    host, _, pid = owner.partition(" ")
    if host != socket.gethostname() or not pid.isdigit() or int(pid) == os.getpid():
        return False
    try:
        os.kill(int(pid), 0)
    except ProcessLookupError:
        return True
    except OSError:
        return False
    return False


# --- settings and state -------------------------------------------------------------


def open_journal(spark: SparkSession, journal: str, settings: dict | None, buckets: int) -> dict:
    """The journal's state, after a check of the settings; a new journal gets settings and buckets.

    What a killed run has left half-written goes, and a commit that the state does not know of yet is taken in.
    """
    fs, at = _fs(spark, journal)
    meta = read_stats(spark, f"{journal}.meta.json")
    if meta is None:
        if fs.exists(at(journal)):
            raise ValueError("the journal was not begun by this engine")
        write_stats(spark, {"buckets": buckets, "settings": settings}, f"{journal}.meta.json")
        meta = {"buckets": buckets, "settings": settings}
    elif settings is not None:
        if meta["settings"] is None:
            raise ValueError("the journal was begun without settings")
        same_run(meta["settings"], settings)
    for left in (f"{journal}.staging", f"{journal}.queue"):
        fs.delete(at(left), True)
    state = read_stats(spark, f"{journal}.state.json") or {"commits": 0, "done": 0, "failed": 0, "writers": {}, "batches": {}, "buckets": {}}
    for found in fs.globStatus(at(f"{journal}/writer=*/commit={state['commits']}")) or []:
        writer = found.getPath().getParent().getName().partition("=")[2]
        state = _add(state, writer, read_stats(spark, f"{found.getPath().toString()}/_facts.json"))
        write_stats(spark, state, f"{journal}.state.json")
    return state | {"n": meta["buckets"]}


def _add(state: dict, writer: str, facts: dict) -> dict:
    """The state after a commit."""
    buckets = dict(state["buckets"])
    new = sum(b["new"] for b in facts["buckets"].values())
    failed = sum(b["failed"] - b["mended"] for b in facts["buckets"].values())
    for name, b in facts["buckets"].items():
        old = buckets.get(name, {"ids": 0, "sum": "0", "failed": 0})
        buckets[name] = {"ids": old["ids"] + b["new"], "sum": str(int(old["sum"]) + int(b["sum"])), "failed": old["failed"] + b["failed"] - b["mended"]}
    batches = state["batches"] | ({writer: facts["batch"]} if facts["batch"] is not None else {})
    writers = state["writers"] | {writer: state["writers"].get(writer, 0) + new}
    return state | {"commits": state["commits"] + 1, "done": state["done"] + new, "failed": state["failed"] + failed, "writers": writers, "batches": batches, "buckets": buckets}


def bucket_of(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def part_of(key: Column, parts: int) -> Column:
    """A second hash, that tells parts of a bucket apart."""
    return F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts)).cast("int")


def bucket_sums(rows: DataFrame) -> dict[str, dict]:
    """Number and digest of the ids of each bucket: as many rows as there are buckets. Rows without an id are refused."""
    sums = rows.groupBy("bucket").agg(F.count("*").alias("ids"), F.count_if(F.col("judge_id").isNull()).alias("unknown"), key_sum(F.col("judge_id")).alias("sum")).collect()
    if unknown := sum(r.unknown for r in sums):
        raise ValueError(f"{unknown} rows without judge_id")
    return {str(r.bucket): {"ids": r.ids, "sum": str(int(r.sum))} for r in sums}


def rows_of(spark: SparkSession, journal: str, buckets: list[int] | None = None, but: str | None = None) -> DataFrame:
    """Rows of a journal with ``writer, commit, bucket``; of some buckets only, or without those of one writer, which prunes files."""
    rows = spark.read.schema(f"{JOURNAL}, writer string, commit int, bucket int").json(journal)
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(buckets))
    return rows if but is None else rows.where(F.col("writer") != but)


# --- commits ----------------------------------------------------------------------------


def commit(spark: SparkSession, journal: str, state: dict, judged: DataFrame, writer: str = "batch", batch: int | None = None) -> dict:
    """Judged rows (:data:`JOURNAL` and :data:`CARRIED`) become part of the journal at once; returns the new state.

    ``batch`` numbers a stream's micro-batches; :func:`has_batch` tells those that are there already.
    """
    fs, at = _fs(spark, journal)
    staging = f"{journal}.staging/{uuid.uuid4().hex}"
    judged.write.partitionBy("bucket").option("ignoreNullFields", "false").json(staging)
    new, ok = ~F.col("again"), F.coalesce("parse_ok", F.lit(False))
    written = spark.read.schema(f"{JOURNAL}, {CARRIED}").json(staging)
    sums = written.groupBy("bucket").agg(
        F.count_if(new).alias("new"),
        key_sum(F.when(new, F.col("judge_id"))).alias("sum"),
        F.count_if(new & ~ok).alias("failed"),
        F.count_if(~new & ok).alias("mended"),
    )
    facts = {"batch": batch, "buckets": {str(r.bucket): {"new": r.new, "sum": str(int(r.sum or 0)), "failed": r.failed, "mended": r.mended} for r in sums.collect()}}
    write_stats(spark, facts, f"{staging}/_facts.json")
    folder = at(f"{journal}/writer={writer}")
    fs.mkdirs(folder)
    if not fs.rename(at(staging), at(f"{journal}/writer={writer}/commit={state['commits']}")):
        raise RuntimeError(f"commit {state['commits']} cannot be renamed into {journal}")
    after = _add(state, writer, facts)
    write_stats(spark, {k: v for k, v in after.items() if k != "n"}, f"{journal}.state.json")
    return after


def has_batch(state: dict, writer: str, batch: int) -> bool:
    return state["batches"].get(writer, -1) >= batch


def units(counts: dict[int, int], most: int) -> list[tuple[list[int], int, int]]:
    """What is judged together, ``(buckets, part, parts)``: small buckets in one, large ones in parts, of about ``most`` rows at most."""
    out: list[tuple[list[int], int, int]] = []
    some: list[int] = []
    size = 0
    for bucket, n in sorted(counts.items()):
        if n > most:
            parts = -(-n // most)
            out += [([bucket], part, parts) for part in range(parts)]
        else:
            if size + n > most:
                out.append((some, 0, 1))
                some, size = [], 0
            some, size = [*some, bucket], size + n
    return out + ([(some, 0, 1)] if some else [])
