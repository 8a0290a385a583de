"""Streams over append-only logs: last write wins, budgets a host, first outcomes, idle steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from provenant.operators import runs


def upsert_latest(stream: DataFrame, path: str, key: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Keeps the last row of each key at path: each batch is merged with what is there, in a new version of the table.

    Versions are folders by batch id, so a batch that runs again after a failure overwrites its own version only. Only the first
    batch starts from nothing: a later one whose predecessor's version cannot be read fails, as it would lose all keys. The version
    before that is deleted.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(batch.schema).parquet(f"{path}/v={number - 1}") if number else batch.limit(0)
        runs.latest(before.unionByName(batch), key, order).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/v={number}")
        if number > 1:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v={number - 2}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, late: str, width: str, *by: str) -> DataFrame:
    """Events by window and key; what is later than the watermark doesn't count."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def first_of_each(events: DataFrame, time: str, late: str, *key: str) -> DataFrame:
    """The first row of a key within the watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))


def idle_steps(steps: DataFrame, most: int) -> DataFrame:
    """key, step, fresh -> key, step, idle, stopped: how long nothing new came, and whether the run had stopped before.

    The state of a key is two numbers, whatever the length of its run; steps of one batch are taken in order.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        idle, stopped = state.get if state.exists else (0, False)
        rows = pd.concat(list(batches)).sort_values("step")
        out = []
        for step, fresh in zip(rows["step"], rows["fresh"], strict=True):
            idle = 0 if fresh else idle + 1
            out.append((key[0], step, idle, stopped))
            stopped = stopped or idle >= most
        state.update((int(idle), bool(stopped)))
        yield pd.DataFrame(out, columns=["key", "step", "idle", "stopped"])

    return steps.groupBy("key").applyInPandasWithState(follow, "key long, step long, idle long, stopped boolean", "idle long, stopped boolean", "append", GroupStateTimeout.NoTimeout)
