"""Session settings that the engine relies on, and its code on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tracewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution, whose checkpoints go when nothing refers to them.

    ``master`` and resources are left to the deployment unless given; settings are
    keywords with ``__`` for dots.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def durable(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster names.

    The folder comes from ``spark.checkpoint.dir``; only where a local session has
    none (tests, notebooks) a temporary one is set.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("executors need a shared folder: set spark.checkpoint.dir")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tracewright-"))


def ship_package(spark: SparkSession) -> None:
    """Send the package's source to the Python workers, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_tracewright_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="tracewright-")) / "tracewright_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._tracewright_shipped = True
