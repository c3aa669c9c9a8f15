"""Streams of parquet tables run to completion over what is there, written to a table in the shared folder.

Every job has a checkpoint, so a restart continues where it stopped; writes of a batch replace that batch's own
folder, so a repeated batch changes nothing. On a cluster the folder is the one that spark.checkpoint.dir names.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.sources.versioned import VersionedTable

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, label: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
    return f"{base.rstrip('/')}/stream-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder, for plans that read them more than once; the shuffles that made it are deleted."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files; the pattern fits a single file as well as a folder."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def run(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over all available rows; append keeps every batch, complete and update the latest state."""
    spark = stream.sparkSession
    folder = shared_folder(spark, label)
    schema = stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number if mode == 'append' else 0}")

    job = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    job.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out").select(schema.names)


def upsert(stream: DataFrame, folder: str, table: VersionedTable, order: Column) -> None:
    """Run a stream of changes over all available rows; of each key's changes in a batch the last by `order` is merged into the table."""
    names = table.schema.names

    def merge(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(*table.keys).agg(F.max_by(F.struct(*names), order).alias("row"))
        changes = f"{folder}/changes/batch={number}"  # a merge reads its changes twice; the stream behind them runs once
        last.select("row.*").write.mode("overwrite").parquet(changes)
        table.merge(table.spark.read.schema(table.schema).parquet(changes), number)

    job = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(merge).start()
    job.awaitTermination()


def stateful(stream: DataFrame, keys: list[str], output: str, state: str, step: Callable, ttl_seconds: int, delay: str = "1 hour") -> DataFrame:
    """Rows of step(key, rows in order of time, state tuple or None) -> (rows, state) for each key, across batches.

    A key's rows of one batch meet in memory. Its state goes when the watermark (`delay` behind the newest time) is
    `ttl_seconds` past the key's last row; steps treat older state as none, so that batches do not change results.
    """
    import pandas as pd

    def f(key, frames, held):
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out, new = step(key, rows, held.get if held.exists else None)
        held.update(new)
        last = int(rows.ts.iloc[-1].timestamp() * 1000)
        held.setTimeoutTimestamp(max(last + ttl_seconds * 1000, held.getCurrentWatermarkMs() + 1))
        yield out

    return stream.withWatermark("ts", delay).groupBy(*keys).applyInPandasWithState(f, output, state, "append", "EventTimeTimeout")
