"""Folds over the ordered rows of a key, streamed in Arrow batches: no key's rows are collected into one value."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def streamed(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str], columns: Sequence[str], start: Callable[[], Any], step: Callable[[Any, tuple], tuple | None], names: Sequence[str], types: Sequence[tuple[str, pa.DataType]]) -> DataFrame:
    """key and what step(state, values of columns) returns for each row of a key in order, None for no row; start() gives each key's
    first state.

    Rows are dealt out by key and sorted within partitions, so memory is one batch and one state, whatever rows a key has. Null
    keys are a key of their own; an empty table gives no rows.
    """
    width = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            values = [batch.column(i).to_pylist() for i in range(width + len(columns))]
            picked, out = [], []
            for i, row in enumerate(zip(*values, strict=True)):
                if state is None or row[:width] != at:
                    at, state = row[:width], start()
                said = step(state, row[width:])
                if said is not None:
                    picked.append(i)
                    out.append(said)
            if out:
                keys = [batch.column(i).take(pa.array(picked, pa.int64())) for i in range(width)]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, kind) for c, (_, kind) in zip(zip(*out, strict=True), types, strict=True))], [*key, *names])

    fields = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key] + [f"`{n}` {t}" for n, (t, _) in zip(names, types, strict=True)]
    ordered = rows.repartition(*[F.col(k) for k in key]).sortWithinPartitions(*[F.col(k) for k in key], *order)
    return ordered.select(*key, *columns).mapInArrow(run, ", ".join(fields))
