"""Session helpers: shared scratch space, materialised tables, package shipping."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir`` and can't do without; only where that is unset under a local
    master (tests, a laptop) is a local temporary folder made and used for the session.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_cues_scratch", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = context._cues_scratch = "file://" + tempfile.mkdtemp(prefix="spark-cues-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete, when the block ends, the tables that ``materialize`` wrote in it under names of its own."""
    scopes = spark.sparkContext.__dict__.setdefault("_cues_scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a short lineage that survives lost executors.

    The table stays until the enclosing ``temporary`` block ends; where there is none, or the caller gives the ``path``, until it is discarded.
    """
    spark = df.sparkSession
    scopes = getattr(spark.sparkContext, "_cues_scopes", None)
    if path is None:
        path = scratch_path(spark, name)
        if scopes:
            scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small table.

    Its files go when they are no longer used if the session sets ``spark.cleaner.referenceTracking.cleanCheckpoints``, else with the folder.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package when it isn't on their path already."""
    root = str(PACKAGE.parent)
    on_path = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root in map(os.path.abspath, filter(None, on_path)) or getattr(spark.sparkContext, "_cues_shipped", False):
        return
    spark.sparkContext._cues_shipped = True
    target = os.path.join(tempfile.mkdtemp(prefix="spark-cues-"), "spark_cues_pkg.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(PACKAGE.rglob("*.py")):
            archive.write(file, str(file.relative_to(PACKAGE.parent)))
    spark.sparkContext.addPyFile(target)
    if root not in sys.path:
        sys.path.insert(0, root)
