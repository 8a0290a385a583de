"""Arrow UDFs and flat maps over the text kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.functions import html, text


_STRING, _INT, _DOUBLE, _STRINGS = T.StringType(), T.IntegerType(), T.DoubleType(), T.ArrayType(T.StringType())


def mapped(kernel: Callable, returns: T.DataType) -> Callable[..., Column]:
    """A kernel of one or more values as a vectorised UDF; a null argument gives null."""

    @F.pandas_udf(returns)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else kernel(*row) for row in zip(*columns, strict=True)], dtype=object)

    return run


def _span(found: tuple[int, int] | None) -> dict | None:
    return None if found is None else {"start": found[0], "end": found[1]}


normalised = mapped(lambda t: text.normalise(t)[0], _STRING)
folded = mapped(text.fold, _STRING)
key_of = mapped(text.comparison_key, _STRING)
located = mapped(lambda q, t: (text.locate(q, t) or (-1, -1))[0], _INT)
main_text = mapped(html.main_text, _STRING)
title = mapped(html.title, _STRING)
links = mapped(html.links, _STRINGS)
number_list = mapped(text.numbers, _STRINGS)
token_list = mapped(text.tokens, _STRINGS)
redacted = mapped(lambda t: text.redact(t)[0], _STRING)
set_ratio = mapped(text.token_set_ratio, _DOUBLE)
sort_ratio = mapped(text.token_sort_ratio, _DOUBLE)
part_ratio = mapped(lambda a, b: text.partial_ratio(a, b)[0], _DOUBLE)
shape = mapped(text.shape, _STRING)


def spans(docs: DataFrame, kernel: Callable[[str], list[tuple]], schema: str, names: Sequence[str], key: str = "doc_id", body: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per tuple that a kernel finds in a text: key, an ordinal, the tuple, and columns of docs to carry. Null texts give no
    rows."""
    fields = ["key", "ordinal", *names, *carry]
    kinds = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), *[kinds[x.split(" ")[1]] for x in schema.split(", ")]]
        for batch in batches:
            rows, picked = [], []
            for at, (k, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                for i, found in enumerate(kernel(t) if t is not None else ()):
                    rows.append((k, i, *found))
                    picked.append(at)
            if rows:
                held = [c.take(pa.array(picked, pa.int64())) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), types, strict=True)), *held], fields)

    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(F.col(key).cast("long"), body, *carry).mapInArrow(run, f"key long, ordinal int, {schema}{more}").withColumnRenamed("key", key)
