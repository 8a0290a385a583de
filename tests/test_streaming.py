import pytest

from provenant.plans import registry
from provenant.streaming import logs


def test_upsert(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "key string, seq long, value string"
    for i, batch in enumerate(([("a", 1, "x"), ("b", 2, "y")], [("a", 3, "z")])):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        logs.upsert_latest(stream, out, ["key"], ["seq"], str(tmp_path / "check")).awaitTermination()
        found = {r["key"]: r["value"] for r in spark.read.schema(schema).parquet(f"{out}/v={i}").collect()}
    assert found == {"a": "z", "b": "y"}


def run(df, tmp_path, name, mode="append"):
    spark = df.sparkSession
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_windows_and_first(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "events"))
    counts = run(logs.windowed_counts(stream, "ts", "1 hour", "1 day", "event_type"), tmp_path, "counts", "complete")
    assert counts.groupBy().sum("n").first()[0] == batch.count()
    first = run(logs.first_of_each(stream, "ts", "60 days", "user_id"), tmp_path, "first")
    assert first.count() == batch.select("user_id").distinct().count()


def test_idle_steps(spark, tmp_path):
    spark.createDataFrame([(1, i, i % 5 == 0) for i in range(12)] + [(2, i, False) for i in range(4)], "key long, step long, fresh boolean").write.parquet(str(tmp_path / "steps"))
    stream = spark.readStream.schema("key long, step long, fresh boolean").parquet(str(tmp_path / "steps"))
    found = {(r["key"], r["step"]): (r["idle"], r["stopped"]) for r in run(logs.idle_steps(stream, 3), tmp_path, "idle").collect()}
    assert [found[2, i] for i in range(4)] == [(1, False), (2, False), (3, False), (4, True)]
    assert found[1, 3] == (3, False) and found[1, 4] == (4, True) and found[1, 5] == (0, True)


@pytest.mark.parametrize("name, table", [("streamed_idle_steps", "orders"), ("streamed_firsts", "events")])
def test_appended_rows_are_in_files(spark, sf_dir, tmp_path, name, table):
    """The driver holds no row of a stream that only appends; an empty table gives none."""
    found = registry.QUERIES[name](spark, sf_dir)
    assert found.inputFiles() and found.count()
    spark.read.parquet(f"{sf_dir}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    empty = registry.QUERIES[name](spark, str(tmp_path))
    assert empty.columns == found.columns and empty.count() == 0
