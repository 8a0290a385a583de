from pyspark.sql import functions as F

from provenant.operators import decisions, tagging, verdict
from provenant.plans.tables import items


def test_cues(spark):
    rows = spark.createDataFrame([(1, "We use machine learning in production."), (2, "Air conditioning agents"), (3, None)], "id int, passage string")
    found = {r["id"]: r for r in tagging.cues(rows).collect()}
    assert found[1]["cue_term"] and found[1]["cue_deployed"] and not found[1]["cue_planned"] and found[2]["cue_agentic"] and not found[3]["cue_term"]


def test_entity_guard(spark):
    docs = spark.createDataFrame([(1, "Northwind and its Harbor engine"), (2, "the north wind doctrine of Northwind Airlines"), (3, "Northwind alone"), (4, None)], "doc_id long, text string")
    found = {r["doc_id"]: (r["named"], r["corroborated"]) for r in tagging.corroborated(docs, "Northwind", ["Harbor"], ["Northwind Airlines"]).collect()}
    assert found == {1: (True, True), 2: (False, False), 3: (True, False), 4: (False, False)}


def test_batches_keep_order_and_budget(spark):
    rows = spark.createDataFrame([("a", i, s) for i, s in enumerate((10, 90, 50, 200, 1, 1, 1))], "k string, item_key long, size long")
    found = [r["batch"] for r in decisions.batches(rows, "k", [F.col("item_key")], 2, 100).orderBy("item_key").collect()]
    assert found == [0, 0, 1, 2, 3, 3, 4]


def test_fitted_skips_what_is_too_long(spark):
    parts = spark.sql("SELECT array(struct(1 AS rank, 3 AS place, 'last' AS body), struct(0 AS rank, 1 AS place, 'first' AS body), struct(2 AS rank, 2 AS place, 'much too long' AS body)) AS p")
    assert parts.select(decisions.fitted(F.col("p"), 12)).first()[0] == "first last"


def test_distinct_sources_are_independent(spark, sf_dir):
    rows = items(spark, sf_dir)
    info = {r["item_key"]: r for r in rows.select("item_key", "vendor_id", "cluster_id", "publisher", "family").collect()}
    kept = {}
    for r in verdict.distinct_sources(rows).collect():
        assert info[r["item_key"]]["vendor_id"] == r["vendor_id"]
        kept.setdefault(r["vendor_id"], []).append(info[r["item_key"]])
    for own in kept.values():
        assert len({x["cluster_id"] for x in own}) == len(own) == len({(x["publisher"], x["family"]) for x in own})
