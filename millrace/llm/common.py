"""Helpers that the operators share: bounded Arrow batches, tables in the shared folder, null-safe columns."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of a batch that goes to a Python worker: long texts then come few at a time.
BATCH_BYTES = 2 << 20


def bounded(spark: SparkSession) -> None:
    """Let no Arrow batch exceed BATCH_BYTES, so that a worker's memory doesn't follow the longest texts times 10,000 rows.

    Plans read the setting when they run, so it stays; a smaller one of the caller's is left alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark.conf.get(name)) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def _bytes(value: str | None) -> int:
    """The number of bytes that a setting without a larger unit names; 0 for others."""
    value = (value or "").lower().removesuffix("b")
    return int(value) if value.isdigit() else 0


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for reference cycles inside: over large tables of strings it takes long and finds none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


#: Memory in MB above which a worker gives back what it doesn't use when its task ends.
KEPT = 100


def freed(f: Callable) -> Callable:
    """f for mapInArrow, after which the worker gives unused memory back: it waits for its next task beside those that work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            _give_back()

    return run


def _give_back() -> None:
    try:
        with open("/proc/self/statm") as statm:
            pages = int(statm.read().split()[1])
        if pages * os.sysconf("SC_PAGE_SIZE") > KEPT << 20:
            gc.collect()
            pa.default_memory_pool().release_unused()
            ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError, ValueError):  # another system
        return


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where that is unset, a temporary one if all runs in
    one process, and else an error, since executors would write to their own disks."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("millrace.shared.dir", "")
    if not own:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("millrace.shared.dir", own)
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


#: Paths made inside each passing() under way, and the paths of settled tables.
_passing: list[list[str]] = []
_where: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when this Python ends, or the passing() around it."""
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    if _passing:
        _passing[-1].append(path)
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        return


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are settled inside are deleted at the end; write what shall stay to a path made before."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            remove(spark, path)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _where[out] = path
    return out


def done(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in tables:
        if df in _where:
            remove(df.sparkSession, _where.pop(df))


def settle_stage(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make() settled; what it settled itself on the way is deleted."""
    path = scratch(spark, name)
    with passing(spark):
        df = make()
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _where[out] = path
    return out


#: Rows of keys (id and hash) up to which a settled table is broadcast: 24 bytes each, some 100 MB in memory.
MOST_KEYS = 1_000_000


def settle_keys(df: DataFrame, name: str, most: int = MOST_KEYS) -> DataFrame:
    """df settled, and marked for broadcast if its rows, now counted, are few; else joins shuffle."""
    out = settle(df, name)
    return F.broadcast(out) if out.count() <= most else out


#: Rows up to which met() broadcasts a table (some 10 MB), rows that make a key hot, and how many ways a hot key is dealt.
MOST_MET, HOT, SALTS = 100_000, 2_000, 64


def met(rows: DataFrame, table: DataFrame, on: str | list[str], name: str, how: str = "inner", most: int = MOST_MET, hot: int = HOT) -> DataFrame:
    """rows joined with a table that has one row a key. The table is settled and broadcast if its rows, now counted, are few.

    Else both are shuffled, where the rows of a hot key are dealt to SALTS tasks and its row of the table is repeated for
    each; of hot keys there are at most the rows' number divided by hot, and they are broadcast if few. rows are read twice."""
    out, keys = settle(table, name), [on] if isinstance(on, str) else on
    if out.count() <= most:
        return rows.join(F.broadcast(out), on, how)
    crowded = settle_keys(rows.groupBy(*keys).count().filter(F.col("count") > hot).select(*keys, F.lit(True).alias("__mr_hot")), "hot")
    # of a row and the task that has it, so a task that runs again deals alike whatever order its rows come in
    ways = F.when(F.col("__mr_hot"), F.pmod(F.xxhash64(F.spark_partition_id(), *rows.columns), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = rows.join(crowded, keys, "left").withColumn("__mr_salt", ways).drop("__mr_hot")
    every = out.join(crowded, keys, "left").withColumn("__mr_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("__mr_hot"), SALTS - 1).otherwise(0)))).drop("__mr_hot")
    return dealt.join(every, [*keys, "__mr_salt"], how).drop("__mr_salt")


def utf8(c: str) -> Column:
    """The column's text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
