"""Session, shared folder and size-checked broadcast helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Rows a side may have before it is no longer offered for broadcast.
BROADCAST_ROWS = 1_000_000
# Rows that a task of `dealt` is meant to sort or group.
TASK_ROWS = 200_000
# Bytes of rows that a Python worker is handed at once; rows alone, 10,000 by default, do not bound whole texts.
ARROW_BYTES = 4 << 20
ARROW_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"

_SHIPPED: dict[str, str] = {}


def build_session(app: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Streaming state on disk rather than on the heap.
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the session's Python workers, once per application, wherever they run."""
    context = spark.sparkContext
    if _SHIPPED.get("app") != context.applicationId:
        package = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="corpusloom-package-")
        copy = os.path.join(folder, "package", os.path.basename(package))
        shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
        archive = os.path.join(folder, os.path.basename(package))
        # Spark's file server hands the archive on; no executor reads this folder.
        context.addPyFile(shutil.make_archive(archive, "zip", os.path.join(folder, "package")))
        _SHIPPED["app"] = context.applicationId
    bound_batches(spark)
    return spark


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches within ARROW_BYTES, unless the session has a bound other than Spark's own of 64 MB."""
    if spark.conf.get(ARROW_BOUND, None) in (None, "67108864b"):
        spark.conf.set(ARROW_BOUND, str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`, or on a local master a fresh local one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = spark.conf.get("corpusloom.test.dir", None)
        if not configured:
            configured = tempfile.mkdtemp(prefix="corpusloom-")
            spark.conf.set("corpusloom.test.dir", configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, never reused path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Truncate lineage with a reliable checkpoint, so a lost executor costs a re-read only."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast `df` only after counting that it has at most `rows` rows.

    Beyond the bound the frame is returned as it is and the join shuffles (AQE splits hot keys).
    The check stops after `rows + 1` rows.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def load(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    df = ship(spark).read.parquet(f"{folder}/{table}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when a scan yields fewer partitions than cores; otherwise no change.

    For steps that cost far more than moving their input (parsing, normalising). Large tables already
    split into more partitions than cores, so they are never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def keyed(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitions for grouped Python work, as many as the session's shuffle partitions.

    Adaptive execution sizes tasks by bytes and would put a small but slow stage into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Hash partitions for `rows` rows, so many that what a task sorts or groups does not grow with the table.

    Adaptive execution would join partitions up to a size in compressed bytes, which bounds no memory.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // TASK_ROWS)), *keys)


def join_back(rows: DataFrame, reduced: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join rows to an aggregate of their own keys, so that a hot key can be split.

    An aggregate leaves its result partitioned by its keys and a join on those keys would reuse that,
    but adaptive execution splits skewed partitions only between two fresh exchanges. The extra key,
    a hash of the others, matches whenever they do and makes both sides exchange anew.
    """
    tag = F.xxhash64(*keys)
    return rows.withColumn("_tag", tag).join(reduced.withColumn("_tag", tag), [*keys, "_tag"], how).drop("_tag")


def lookup(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a side that is usually small: broadcast when it is counted small, splittable otherwise."""
    small = if_small(side)
    return join_back(rows, side, keys, how) if small is side else rows.join(small, keys, how)
