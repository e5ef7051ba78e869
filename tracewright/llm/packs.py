"""Documents in packs: a few MB of text each, compressed, written once.

A pack is an Arrow table of keys and texts, sorted by key. Operators that need the
texts more than once read packs again, which costs a third of moving the texts.
``uid`` names a document in its pack, ``pack << 16 | row``, also where keys repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.shared import durable, map_arrow
from tracewright.llm.tokens import slices

ROW_BITS = 16
PACK_BYTES = 4 << 20
LEVEL = 6  # packs are moved several times, so a fifth less is worth the time


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 24
    for batch in batches:
        for part in slices(batch, "text", PACK_BYTES):
            for at in range(0, part.num_rows, 1 << ROW_BITS):
                some = part.slice(at, 1 << ROW_BITS).sort_by("key")
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, some.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as out:
                    out.write(some)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["pack", "body"])
                number += 1


def pack_documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(pack, body)``, checkpointed. Keys must be integers; null ones are left out, null texts are empty."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.col("key").isNotNull())
    return durable(map_arrow(rows, _pack, "pack long, body binary"))


def unpack(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all().combine_chunks()
