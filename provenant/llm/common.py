"""What the operators share: input columns and shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.functions.storage import checkpoint, checkpoint_dir

__all__ = ["WORD", "checkpoint", "checkpoint_dir", "forget_written", "numbered", "small", "table", "text_of", "written"]

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A null text counts as the empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces: Python objects of a thousand texts at a time, whatever size the session's batches have."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_WRITTEN: list[str] = []


def forget_written(spark: SparkSession) -> int:
    """Deletes the tables that `written` made in this process, and tells how many. Results that still read them are lost, so
    call it when these are stored."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _WRITTEN:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    count = len(_WRITTEN)
    _WRITTEN.clear()
    return count


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: smaller than a checkpoint, and columns can be pruned."""
    path = f"{checkpoint_dir(df.sparkSession)}/provenant-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, written so that it stays; and that column's name, which no other column has."""
    name = "row_" + "_" * max((len(c) for c in docs.columns), default=0)
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name
