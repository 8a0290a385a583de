"""Sinks: runs, assessments, append-only logs, and the small tables that reports are made of."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.functions import udfs


def write_run(tables: Mapping[str, DataFrame], path: str, run_id: str) -> DataFrame:
    """Each table under path, partitioned by run; and the manifest: table, rows."""
    sizes = None
    for name, df in tables.items():
        df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{path}/{name}")
        written = df.sparkSession.read.parquet(f"{path}/{name}").where(F.col("run_id") == run_id)
        own = written.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
        sizes = own if sizes is None else sizes.union(own)
    return sizes


def latest_assessment(spark: SparkSession, path: str, tables: Sequence[str]) -> dict[str, DataFrame]:
    """The tables of the newest run under a path, by the ids that write_run gave; a path without runs raises."""
    newest = spark.read.parquet(f"{path}/{tables[0]}").agg(F.max("run_id")).first()[0]
    if newest is None:
        raise ValueError(f"no run under {path}")
    return {name: spark.read.parquet(f"{path}/{name}").where(F.col("run_id") == newest) for name in tables}


def append(log: DataFrame, path: str) -> None:
    """To an append-only log; readers take the last row of a key by its sequence."""
    log.write.mode("append").parquet(path)


def decisions(fetches: DataFrame) -> DataFrame:
    """gate, decision -> n."""
    return fetches.groupBy("gate", "decision").agg(F.count(F.lit(1)).alias("n"))


def failures(results: DataFrame) -> DataFrame:
    """The histogram of failed checks; results has an array of them."""
    return results.select(F.explode("failures").alias("failure")).groupBy("failure").agg(F.count(F.lit(1)).alias("n"))


def call_statistics(calls: DataFrame) -> DataFrame:
    """vendor_id -> calls, cached, withheld, models, percent withheld."""
    n = F.count(F.lit(1))
    held = F.count_if(F.col("status") == "withheld")
    return calls.groupBy("vendor_id").agg(n.alias("calls"), F.count_if("cached").alias("cached"), held.alias("withheld"), F.count_distinct("model").alias("models"), F.round(100.0 * held / n, 1).alias("percent_withheld"))


def over_budget(cells: DataFrame, budgets: Mapping[str, int], allowed: Mapping[str, list[str]]) -> DataFrame:
    """Cells that are too long or not among the allowed values; must be empty to write them."""
    limit = F.create_map(*[F.lit(x) for pair in budgets.items() for x in pair]) if budgets else F.lit(None).cast("map<string,int>")
    values = F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if allowed else F.lit(None).cast("map<string,array<string>>")
    long = F.coalesce(F.length("value") > F.get(F.array(F.try_element_at(limit, F.col("column"))), F.lit(0)), F.lit(False))
    odd = F.coalesce(~F.array_contains(F.try_element_at(values, F.col("column")), F.col("value")), F.lit(False))
    return cells.withColumn("problem", F.when(long, "too long").when(odd, "not allowed")).where("problem IS NOT NULL")


def flattened(body: str) -> list[tuple[str, str]]:
    """(path, value) of a JSON text's leaves in its order; paths join keys and places by dots. No JSON has none; empty containers are
    leaves, strings stay as they are, other values are JSON."""
    try:
        todo: list[tuple[str, object]] = [("", json.loads(body))]
    except ValueError:
        return []
    out = []
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict | list) and value:
            inner = value.items() if isinstance(value, dict) else enumerate(value)
            todo += [(f"{path}.{k}" if path else str(k), v) for k, v in reversed(list(inner))]
        else:
            out.append((path, value if isinstance(value, str) else json.dumps(value)))
    return out


def manifest_rows(manifests: DataFrame) -> DataFrame:
    """key, body (JSON) -> key, ordinal, path, value: a row per leaf, however deep it nests."""
    return udfs.spans(manifests, flattened, "path string, value string", ["path", "value"], key="key", body="body")
