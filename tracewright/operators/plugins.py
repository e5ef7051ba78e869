"""Rewards and other functions from Python files, by path: as columns, in batches, and in SQL.

A file lists what it offers::

    PLUGINS = [
        {"name": "brevity", "function": brevity, "inputs": ["response"], "kind": "scalar", "returns": "double"},
        {"name": "spread", "function": spread, "inputs": ["gold", "score"], "kind": "batch"},
        {"name": "sentences", "function": Sentences, "kind": "table", "returns": "sentence string"},
    ]

A ``scalar`` gets the values of a row (Arrow-batched), a ``batch`` a pandas frame of its inputs and gives one number a row, and a ``table``
is a class with ``eval`` that yields rows. All are registered for SQL under their names; scalars and batches also
become rewards for :func:`tracewright.operators.rewards.rewarded`.
"""

from __future__ import annotations

import hashlib
import importlib
import sys
import tempfile
from pathlib import Path

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracewright.operators import rewards
from tracewright.session import ship_package
from tracewright.sources.io import read_small

_KINDS = ("scalar", "batch", "table")


def load_plugins(spark: SparkSession, path: str) -> list[str]:
    """Load a file from any file system that Spark reads, send it to the executors, and register what it offers; returns the names.

    The module is named by its content, so two versions of a file do not meet, and loading the same one again changes nothing. A name that
    another file or the engine has taken raises, before anything is registered.
    """
    source = read_small(spark, path)
    if source is None:
        raise FileNotFoundError(path)
    name = f"plugin_{hashlib.sha256(source.encode()).hexdigest()[:16]}"
    if name in sys.modules and name in _shipped(spark):
        return [p["name"] for p in sys.modules[name].PLUGINS]
    file = Path(tempfile.mkdtemp(prefix="tracewright-plugins-")) / f"{name}.py"
    file.write_text(source, encoding="utf-8")
    sys.path.insert(0, str(file.parent))
    try:
        module = importlib.import_module(name)
    finally:
        sys.path.remove(str(file.parent))
    offered = _checked(getattr(module, "PLUGINS", None), path)
    ship_package(spark)
    spark.sparkContext.addPyFile(str(file))
    for p in offered:
        _register(spark, p)
    _shipped(spark).add(name)
    return [p["name"] for p in offered]


def _shipped(spark: SparkSession) -> set[str]:
    sc = spark.sparkContext
    if not hasattr(sc, "_tracewright_plugins"):
        sc._tracewright_plugins = set()
    return sc._tracewright_plugins


def _checked(offered, path: str) -> list[dict]:
    if not isinstance(offered, list) or not offered:
        raise ValueError(f"{path} has no list PLUGINS")
    names = [p.get("name") for p in offered]
    for p in offered:
        if p.get("kind") not in _KINDS or not callable(p.get("function")) or not str(p.get("name", "")).isidentifier():
            raise ValueError(f"not a plugin: {p}")
        if p["kind"] == "table" and "returns" not in p or p["kind"] != "table" and not p.get("inputs"):
            raise ValueError(f"{p['name']} lacks its inputs, or what it returns")
        if names.count(p["name"]) > 1 or p["name"] in rewards.PLUGINS:
            raise ValueError(f"there is a plugin {p['name']!r}")
    return offered


def _register(spark: SparkSession, p: dict) -> None:
    name, function, returns = p["name"], p["function"], p.get("returns", "double")
    if p["kind"] == "table":
        spark.udtf.register(name, F.udtf(function, returnType=returns))
        return
    if p["kind"] == "scalar":
        column = F.udf(function, returns, useArrow=True)
    else:
        column = F.pandas_udf(_framed(function, tuple(p["inputs"])), returns)
    spark.udf.register(name, column)
    rewards.register(name, column, tuple(p["inputs"]))


def _framed(function, names: tuple[str, ...]):
    """A batch function over columns."""

    def run(*columns: pd.Series) -> pd.Series:
        frame = pd.DataFrame(dict(zip(names, columns)))
        out = list(function(frame))
        if len(out) != len(frame):
            raise ValueError(f"{len(out)} values for {len(frame)} rows")
        return pd.Series(out)

    return run
