"""Making the package importable where the work is done."""

from __future__ import annotations

import contextlib
import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors' Python, once a session; not if their path has it already."""
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or any(f.endswith("/kinweave.zip") for f in context.listFiles):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="kinweave-"), "kinweave.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted((ROOT / "kinweave").rglob("*.py")):
            out.write(file, file.relative_to(ROOT))
    context.addPyFile(path)


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Plans made and run within leave no shuffle files behind; else those stay until the driver happens to collect its garbage."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the session's shared spark.checkpoint.dir, so lost executors don't recompute its lineage.

    Only where that folder is unset (a local session) is one made. The files of its shuffles go as soon as it is stored.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="kinweave-checkpoint-"))
    with tidy(spark):
        # The setting holds for plans made under it, so this is one.
        return df.select("*").checkpoint()


def drop(*stored: DataFrame) -> None:
    """Deletes what cut() stored, where nothing will read it any more."""
    for df in stored:
        context = df.sparkSession.sparkContext
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            path = context._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
