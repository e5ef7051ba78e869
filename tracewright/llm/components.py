"""Connected components in Spark, safe with vertices of very many links.

A round has two steps. Every partition of links is contracted by a union-find of its
own, so that each vertex there has one link, to the smallest vertex it reaches; then
links are dealt by their larger end, where a vertex meets the parents that other
partitions found for it. After that, parents are replaced by their own parents
(one join, whose large side may be split). It ends when nothing changes any more. Links that
fit into one partition need no round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.shared import durable, map_arrow, parallelism


#: A task contracts two to this power links at most, 16 MB.
TASK_BITS = 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(vertex, root)`` for every vertex but the roots; roots are the smallest of their tree."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ends))
    while True:  # hook larger roots onto smaller ones, then shorten all paths
        rx, ry = root[x], root[y]
        lo, hi = np.minimum(rx, ry), np.maximum(rx, ry)
        if (lo == hi).all():
            break
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    child = root != np.arange(len(ends))
    return ends[child], ends[root[child]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for x in batches:
        a.append(x.column(0).to_numpy())
        b.append(x.column(1).to_numpy())
    if not a:
        return
    a, b = np.concatenate(a), np.concatenate(b)
    v, r = forest(a, b)
    # A vertex with two different parents means that trees were joined here.
    pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
    joined = len(np.unique(pairs[0])) != pairs.shape[1]
    for i in range(0, len(v), 100_000):
        n = len(v[i : i + 100_000])
        yield pa.RecordBatch.from_arrays([pa.array(v[i : i + n]), pa.array(r[i : i + n]), pa.array([joined] * n)], names=["v", "root", "changed"])


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(v, root)`` for every vertex of ``links (a long, b long)`` that is not the smallest of its component.

    Links are read twice, so they had better be checkpointed.
    """
    count = links.count()
    schema = "v long, root long, changed boolean"
    # A task holds a million links at most, and no task is begun for fewer: a vertex of very many links has one for each part.
    parts = (count >> TASK_BITS) + 1
    tree = map_arrow(links.where(F.col("a") != F.col("b")).coalesce(parts), _contract, schema)
    if parts == 1:
        return durable(tree.select("v", "root"))
    n = max(parallelism(links.sparkSession), parts)
    for _ in range(rounds):
        met = durable(map_arrow(tree.select("v", "root").repartition(n, "v"), _contract, schema))
        parent = met.select(F.col("v").alias("p"), F.col("root").alias("up"))
        tree = durable(
            met.join(parent, F.col("root") == F.col("p"), "left").select(
                "v", F.coalesce("up", "root").alias("root"), (F.col("changed") | F.col("up").isNotNull()).alias("changed")
            )
        )
        if not tree.where("changed").take(1):
            return tree.select("v", "root")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
