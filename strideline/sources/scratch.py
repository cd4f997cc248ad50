"""Intermediate tables in the folder that driver and executors share.

A table written here outlives the executors that made it, so a lost executor
costs one task and not the lineage before the table.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset and all tasks run on this machine, a new folder of our own."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="strideline-")
        atexit.register(shutil.rmtree, given, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


_made: ContextVar[list[Scratch] | None] = ContextVar("made", default=None)


@contextmanager
def begun() -> Iterator[list[Scratch]]:
    """The tables of all jobs that begin inside."""
    inside: list[Scratch] = []
    before = _made.set(inside)
    try:
        yield inside
    finally:
        _made.reset(before)


class Scratch:
    """Names and drops the tables of one job.

    ``save`` writes a DataFrame as Parquet and returns the table read back. The
    shuffle files behind it are freed with the write, so that a job of many steps
    holds the tables it still needs and the shuffle of one step.
    """

    def __init__(self, spark: SparkSession, owner: str):
        self.spark = spark
        self.name = f"{owner}-{uuid.uuid4().hex}"
        self.base = f"{shared_dir(spark)}/{self.name}"
        made = _made.get()
        if made is not None:
            made.append(self)

    def save(self, df: DataFrame, label: str, **options: str) -> DataFrame:
        path = f"{self.base}/{label}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.options(**options).parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        """Deletes tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        for label in labels:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{label}")
            path.getFileSystem(hadoop).delete(path, True)
