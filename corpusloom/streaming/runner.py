"""Running a file-sourced stream to its end, with restartable sinks in the shared folder."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..session import scratch_path
from ..sources.store import _exists
from .state import Sliced


def file_stream(spark: SparkSession, folder: str, table: str, files: int | None = None) -> DataFrame:
    """Stream of a Parquet table that is a single file or a folder of part files, `files` a batch if given."""
    path = f"{folder}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    single = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile()
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder) if single else reader.parquet(path)


def event_time(events: DataFrame) -> DataFrame:
    """Event time as a timestamp with session time zone; watermarks reject the zone-free type."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def append(stream: DataFrame, label: str, root: str | None = None) -> DataFrame:
    """Run everything available in append mode to Parquet and return what was written.

    Running again with the same `root` resumes at the checkpoint and adds only what is new.
    """
    spark = stream.sparkSession
    root = root or scratch_path(spark, label)
    out = os.path.join(root, "rows")
    with states_on_disk(spark):
        run = (
            stream.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", os.path.join(root, "checkpoint"))
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@contextmanager
def states_on_disk(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, which keyed processors need, for the streams started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _as_text(types: dict[str, T.DataType]) -> Column:
    """Key columns as one text, exact and with nulls; pandas would turn numbers with nulls into floats."""
    return F.to_json(F.array(*((F.unix_micros(n) if t == T.TimestampType() else F.col(n)).cast("string") for n, t in types.items())))


def _from_text(text: Column, kind: T.DataType) -> Column:
    return F.timestamp_micros(text.cast("bigint")) if kind == T.TimestampType() else text.cast(kind)


def keyed_state(
    events: DataFrame, late: str, reduce: Callable, reduced: str, processor: StatefulProcessor, label: str, root: str | None = None,
    mode: str = "update",
) -> DataFrame:
    """Run a keyed processor with event-time timers over events(ts, us, ...) and return its rows with their batch.

    `reduce` shrinks the rows of an Arrow batch to `reduced` before they are shuffled to the processor's key, or to the
    slice of keys that a `Sliced` processor holds together. A
    micro-batch is computed once and overwrites its own folder, split by `kind`, so a repeated batch leaves the same
    rows behind; running again with the same `root` resumes at the checkpoint.
    """
    spark = events.sparkSession
    root = root or scratch_path(spark, label)
    out = os.path.join(root, "rows")
    types = {n: events.schema[n].dataType for n in processor.names}
    keys = ", ".join(f"`{n}` {t.simpleString()}" for n, t in types.items())
    schema = f"{keys}, {processor.SCHEMA}"
    stream = events.withWatermark("ts", late).drop("ts").mapInArrow(reduce, f"{keys}, {reduced}")
    if isinstance(processor, Sliced):
        carried = [c for c in stream.columns if c not in processor.names or c in processor.CARRIED]
        processor.columns = ["key", *carried]
        rows = stream.select(F.pmod(F.xxhash64(*types), F.lit(processor.SLICES)).cast("int").alias("_slice"), _as_text(types).alias("key"), *carried)
        stream = rows.groupBy("_slice").transformWithStateInPandas(processor, f"key string, {processor.SCHEMA}", mode, "EventTime")
        stream = stream.withColumn("key", F.from_json("key", "array<string>")).select(
            *(_from_text(F.get("key", F.lit(at)), t).alias(n) for at, (n, t) in enumerate(types.items())), *stream.columns[1:]
        )
    else:
        stream = stream.groupBy(*processor.names).transformWithStateInPandas(processor, schema, mode, "EventTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.partitionBy("kind").mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

    with states_on_disk(spark):
        run = (
            stream.writeStream.foreachBatch(write).outputMode(mode)
            .option("checkpointLocation", os.path.join(root, "checkpoint")).trigger(availableNow=True).start()
        )
        run.awaitTermination()
    fields = T.StructType.fromDDL(f"{schema}, batch int")
    if not _exists(spark, out):
        return spark.createDataFrame([], fields)
    return spark.read.schema(fields).option("basePath", out).parquet(out)
