"""A session with the settings that the engine's results rely on."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; on a local master, as many shuffle partitions as cores. ANSI mode stays on."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        cores = os.cpu_count() or 4
        if master.startswith("local["):
            cores = int(n) if (n := master[6:-1]).isdigit() else cores
        builder = builder.master(master).config("spark.sql.shuffle.partitions", str(cores))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); it is deleted when this Python ends.

    Where that is unset, a temporary folder if all runs in one process, and else an error."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("millrace.shared.dir", "")
    if not own:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("millrace.shared.dir", own)
    path = f"{own.rstrip('/')}/millrace/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        return
