"""Session settings the jobs are written for, and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import SparkSession

# What a cluster submit should set as well. Parallelism and memory belong to the
# cluster and are left alone.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # One task writes its few (format, family, run) files side by side instead
    # of sorting its rows by partition first.
    "spark.sql.maxConcurrentOutputFileWriters": "64",
}


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("eventloom")
    settings = {
        **RECOMMENDED,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        # Building a wide mapping makes many columns; noting the call site of each
        # takes longer than the rest of the planning.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for what is run in here."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def many_writers(spark: SparkSession, most: int = 128) -> AbstractContextManager[None]:
    """Writes in here keep so many folders' files of a task open at a time, at least.

    Else a task sorts its rows by folder first: rendered events, which are forty times
    the size of their records. Beyond ``most`` folders it sorts the rest.
    """
    key = "spark.sql.maxConcurrentOutputFileWriters"
    return setting(spark, key, str(max(most, int(spark.conf.get(key, None) or 0))))


def small_shares(spark: SparkSession, size: str = "4MB") -> AbstractContextManager[None]:
    """Tasks in here get shares of about ``size`` of what was moved, where Spark may cut it.

    For records that are rendered after they were moved. Where a task has more folders
    than it keeps open it sorts its events, so their memory is that of one share.
    """
    return setting(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", size)


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that every executor can reach.

    It lies under ``spark.checkpoint.dir``. A machine-local folder is used only
    when that is unset and the session runs in this process alone.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="eventloom-")
    return os.path.join(shared, f"{purpose}-{uuid.uuid4().hex}")
