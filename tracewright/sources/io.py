"""Sources and sinks: JSON lines, CSV, templates, metrics files, chunks and all-or-nothing outputs."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- reading --------------------------------------------------------------------


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, mode: str = "strict") -> DataFrame:
    """JSON lines with an explicit schema.

    ``strict`` raises on a line that is not a JSON object of the schema, ``resume``
    leaves such lines out (half-written ones of a journal). Blank lines do not count.
    """
    if mode not in ("strict", "resume"):
        raise ValueError(mode)
    return spark.read.schema(schema).option("mode", "FAILFAST" if mode == "strict" else "DROPMALFORMED").json(path)


def read_jsonl_numbered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with ``raw_line_no``, the line's number in its file, from 1; malformed lines raise with it.

    Large files are read in splits. Within a split lines follow each other in their ids; the lines of the
    splits before are added.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    splits = read.groupBy("file", "at").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    splits = splits.select("file", "at", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("add"))
    lines = read.where(F.btrim("line") != "").join(splits, ["file", "at"]).select("file", (F.col("id") + F.col("add")).alias("raw_line_no"), "line")
    parsed = F.from_json("line", schema, {"mode": "PERMISSIVE"})
    ok = F.try_parse_json("line").isNotNull() & F.regexp_like("line", F.lit(r"^\s*\{"))
    fail = F.raise_error(F.concat(F.lit("malformed JSON object in line "), F.col("raw_line_no").cast("string")))
    return lines.where(F.when(ok, True).otherwise(fail.cast("boolean"))).select("file", "raw_line_no", parsed.alias("r")).select("file", "raw_line_no", "r.*")


def done_ids(spark: SparkSession, path: str, key: str = "judge_id", failed_too: bool = False) -> DataFrame:
    """Ids of a journal that were parsed well, or (``failed_too``) that it has at all; damaged lines are left out."""
    rows = read_jsonl(spark, path, f"{key} string, parse_ok boolean", "resume").where(F.col(key).isNotNull())
    return (rows if failed_too else rows.where("parse_ok")).select(key).distinct()


def read_pool(spark: SparkSession, path: str, schema: str, required: tuple[str, ...], key: str = "judge_id") -> DataFrame:
    """A pool of candidates: required fields set and not blank, keys unique, at least one row."""
    rows = read_jsonl(spark, path, schema)
    # Counted by key first: partial counts move, and the number of keys is the number of groups.
    blank = [F.count_if(F.col(c).isNull() | (F.btrim(F.col(c).cast("string")) == "")).alias(f"blank{i}") for i, c in enumerate(required)]
    by_key = rows.groupBy(key).agg(F.count("*").alias("rows"), *blank)
    sums = [F.coalesce(F.sum(f"blank{i}"), F.lit(0)).alias(f"blank{i}") for i in range(len(required))]
    facts = by_key.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.count(key).alias("k"), *sums).first()
    wrong = [c for i, c in enumerate(required) if facts[f"blank{i}"]]
    if not facts["n"] or facts["n"] != facts["k"] or wrong:
        raise ValueError(f"{facts['n']} rows, {facts['k']} keys, blank: {wrong}")
    return rows


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, quotes doubled inside quotes, and line breaks in fields; all strings."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def canonical_english(rows: DataFrame, split: str, media: str) -> DataFrame:
    """Samples from the English split tables; a label other than 0 or 1 raises."""
    key = F.regexp_replace("KEY", r"\.0$", "")
    label = F.col("Sarcasm").try_cast("double").cast("int")
    return _canonical(rows, key, F.col("SENTENCE"), label, split, media, "mustard", "en")


def canonical_chinese(rows: DataFrame, split: str, media: str) -> DataFrame:
    """Samples from the Chinese split tables, labels ``s`` and ``ns``."""
    key = F.regexp_replace("`File Name`", r"\.0$", "")
    label = F.when(F.col("Labels") == "s", 1).when(F.col("Labels") == "ns", 0)
    return _canonical(rows, key, F.col("Transcriptions"), label, split, media, "mcsd", "zh")


def _canonical(rows: DataFrame, key: Column, text: Column, label: Column, split: str, media: str, dataset: str, language: str) -> DataFrame:
    checked = F.when(label.isin(0, 1), label).otherwise(F.raise_error(F.lit("unknown label")).cast("int"))
    return rows.select(
        key.alias("id"),
        text.alias("text"),
        checked.alias("label"),
        F.when(checked == 1, "sarcasm").otherwise("non_sarcasm").alias("label_text"),
        F.concat(F.lit(f"{media}/audio/"), key, F.lit(".wav")).alias("audio"),
        F.concat(F.lit(f"{media}/video/"), key, F.lit(".mp4")).alias("video"),
        F.lit(dataset).alias("dataset"),
        F.lit(language).alias("language"),
        F.lit(split).alias("split"),
    )


def zero_shot(rows: DataFrame, template: str) -> DataFrame:
    """Prompt rows: the filled template as the user's message, media as lists, no gold label in the prompt."""
    content = F.replace(F.lit(template), F.lit("{{TRANSCRIPT}}"), F.col("text"))
    return rows.select(
        "id",
        F.col("text").alias("transcript"),
        F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("messages"),
        F.array("audio").alias("audios"),
        F.array("video").alias("videos"),
        "label",
        "label_text",
        "dataset",
        "language",
        "split",
    )


def read_template(spark: SparkSession, path: str) -> str:
    """A text file, stripped; raises where it is missing."""
    return spark.read.text(path, wholetext=True).first()[0].strip()


def read_metrics(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Metrics documents of ``<method>_ckpt<step>`` folders, with ``method`` and ``step``."""
    found = spark.read.schema(schema).option("multiLine", True).json(pattern).select("*", F.col("_metadata.file_path").alias("_path"))
    name = r"/([^/]+)_ckpt(\d+)(?:/|\.|_)"
    named = found.withColumn("method", F.regexp_extract("_path", name, 1)).withColumn("step", F.regexp_extract("_path", name, 2).try_cast("int"))
    return named.where(F.col("step").isNotNull()).drop("_path")


def checkpoint_curve(metrics: DataFrame, score: str = "macro_f1") -> DataFrame:
    """Steps in numeric order with their finite scores and ``best``: the highest, the earliest on ties."""
    ok = F.when(~F.isnan(score) & (F.abs(score) < float("inf")), F.col(score))
    top = metrics.groupBy("method").agg(F.max(F.struct(ok.alias("s"), (-F.col("step")).alias("o"))).alias("_t"))
    out = metrics.withColumn(score, ok).join(top, "method")
    return out.withColumn("best", F.col("_t.s").isNotNull() & (-F.col("step") == F.col("_t.o"))).drop("_t").orderBy("method", "step")


def media_frame(spark: SparkSession, path: str, probe, schema: str) -> DataFrame:
    """Media files through a decoder given as a ``mapInPandas`` function over ``(path, modificationTime, length, content)``."""
    return spark.read.format("binaryFile").load(path).mapInPandas(probe, schema)


#: What :func:`probe_wave` tells of a file.
WAVE = "path string, sha256 string, bytes long, duration double, rate int, channels int, width int, error string"


def probe_wave(frames):
    """A probe for :func:`media_frame`: facts of WAV files, each distinct content decoded once a batch; unreadable ones get an ``error``."""
    import io
    import wave

    import pandas as pd

    for frame in frames:
        known, out = {}, []
        for path, content in zip(frame["path"], frame["content"]):
            digest = hashlib.sha256(content).hexdigest()
            if digest not in known:
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        known[digest] = (w.getnframes() / w.getframerate(), w.getframerate(), w.getnchannels(), w.getsampwidth(), None)
                except (wave.Error, EOFError, ZeroDivisionError) as e:
                    known[digest] = (None, None, None, None, f"{type(e).__name__}: {e}")
            out.append((path, digest, len(content), *known[digest]))
        rows = pd.DataFrame(out, columns=[c.split()[0] for c in WAVE.split(", ")])
        yield rows.astype({"rate": "Int32", "channels": "Int32", "width": "Int32"})


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def key_sum(value: Column) -> Column:
    """An order-free digest of a multiset, as an aggregate: the exact sum of the values' hashes; nulls do not count."""
    return F.sum(F.when(value.isNotNull(), F.xxhash64(value)).cast("decimal(28,0)"))


# --- writing --------------------------------------------------------------------


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines, nulls kept, text unescaped."""
    rows.write.mode("append" if append else "errorifexists").option("ignoreNullFields", "false").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV file with a header: for summaries."""
    rows.coalesce(1).write.mode("errorifexists").csv(path, header=True)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def write_stats(spark: SparkSession, stats: dict, path: str) -> None:
    """One JSON document, written beside and renamed over the old one, in any file system Spark reaches."""
    fs, at = _fs(spark, path)
    beside = at(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(stats, ensure_ascii=False, indent=2).encode()))
    out.close()
    sc = spark.sparkContext
    rename = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
    over = sc._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(beside), fs.makeQualified(at(path)), over)  # at no time is there neither


def read_stats(spark: SparkSession, path: str) -> dict | None:
    """What :func:`write_stats` has written; null if nothing."""
    text = read_small(spark, path)
    return None if text is None else json.loads(text)


def read_small(spark: SparkSession, path: str) -> str | None:
    """A small file's text, read by the driver from any file system that Spark reaches; null if it is not there."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(path)):
        return None
    stream = fs.open(at(path))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def watch(rows: DataFrame, /, **aggregates: Column) -> tuple[DataFrame, Observation]:
    """The rows, and aggregates over them that are there once the rows have been written: counted on the way, without a scan of their own.

    Filters behind do not change what is counted, as with rows that are rejected and not written.
    """
    seen = Observation()
    return rows.observe(seen, *[c.alias(n) for n, c in aggregates.items()]), seen


def reason_counts(reason: Column, reasons: tuple[str, ...]) -> dict[str, Column]:
    """Aggregates for :func:`watch`: how many rows have each reason, none, and one that is not listed."""
    counts = {r: F.count_if(reason == r) for r in reasons}
    return counts | {"accepted": F.count_if(reason.isNull()), "other": F.count_if(~reason.isin(*reasons))}


def _digest_of(rows: DataFrame) -> dict[str, Column]:
    """Aggregates for a digest of all rows, with how often each comes, in any order: their number, and exact sums of two hashes of each."""
    body = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    hashes = {"_a": F.xxhash64(body), "_b": F.xxhash64(F.lit("second"), body)}
    return {"_n": F.count("*"), **{k: F.sum(h.cast("decimal(28,0)")) for k, h in hashes.items()}}


def _digest(facts: dict) -> str:
    return hashlib.sha256(f"{facts['_n']}:{facts['_a']}:{facts['_b']}".encode()).hexdigest()


def multiset_digest(rows: DataFrame) -> str:
    """A digest of all rows, with how often each comes, in any order."""
    return _digest(rows.agg(*[c.alias(n) for n, c in _digest_of(rows).items()]).first().asDict())


def publish(spark: SparkSession, outputs: dict[str, DataFrame], path: str, overwrite: bool = False, watched: dict[str, Observation] | None = None) -> dict[str, str]:
    """Write all outputs to a folder of their own, then make the manifest point there; published outputs are only replaced on demand.

    Returns, and writes to the manifest, a content digest of each output (independent of row order), taken while it is written. What
    outputs :func:`watch` goes to the manifest as well, see :func:`statistics`. Readers
    (:func:`published`) see the old outputs until the manifest is renamed over the old one, then all new ones; the folder
    before is deleted after that.
    """
    fs, at = _fs(spark, path)
    old = read_stats(spark, f"{path}/manifest.json")
    if old and not overwrite:
        raise FileExistsError(path)
    run, digests = uuid.uuid4().hex, {}
    for name, rows in outputs.items():
        rows, facts = watch(rows, **_digest_of(rows))
        rows.write.parquet(f"{path}/{run}/{name}")
        digests[name] = _digest(facts.get)
    write_stats(spark, {"run": run, "outputs": digests, "statistics": {n: o.get for n, o in (watched or {}).items()}}, f"{path}/manifest.json")
    if old:
        fs.delete(at(f"{path}/{old['run']}"), True)
    return digests


def statistics(spark: SparkSession, path: str) -> dict[str, dict]:
    """What was counted while the published outputs were written."""
    manifest = read_stats(spark, f"{path}/manifest.json")
    if not manifest:
        raise FileNotFoundError(path)
    return manifest["statistics"]


def published(spark: SparkSession, path: str, name: str) -> DataFrame:
    """An output of :func:`publish`."""
    manifest = read_stats(spark, f"{path}/manifest.json")
    if not manifest or name not in manifest["outputs"]:
        raise FileNotFoundError(f"{path}: {name}")
    return spark.read.parquet(f"{path}/{manifest['run']}/{name}")
