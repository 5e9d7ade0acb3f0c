"""Session helpers: a local session for tests and timing, and shared scratch folders."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session. On a cluster, the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quernstone")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        # without call sites in error messages, building a plan takes fewer round trips
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder path below the shared folder named in ``spark.checkpoint.dir``.

    A machine-local folder is used only where that setting is missing *and* the
    master is local: on a cluster the executors could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = Path(tempfile.mkdtemp(prefix="quernstone-")).as_uri()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Set session options (dots written as ``__``) and put the old ones back afterwards."""
    pairs = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in pairs}
    for name, value in pairs.items():
        spark.conf.set(name, value)
    try:
        yield spark
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
