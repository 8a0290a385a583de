"""Every query runs; those with SQL give DuckDB's rows."""

import hashlib

import duckdb
import pandas as pd
import pytest

from provenant.operators import evaluation
from provenant.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    made = duckdb.connect()
    for name in TABLES:
        made.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return made


def shown(frame, columns):
    def one(value):
        if pd.isna(value):
            return None
        return int(value) if isinstance(value, float) and value == int(value) else str(value)

    return sorted(str([str(one(v)) for v in row]) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, sf_dir, con, name):
    found = registry.QUERIES[name](spark, sf_dir).toPandas()
    assert len(found.columns)
    if name in registry.ORACLES:
        wanted = con.execute(registry.ORACLES[name]).fetchdf()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert shown(found, sorted(found.columns)) == shown(wanted, sorted(found.columns))


def test_every_document_is_redacted(spark, tmp_path):
    texts = ["call +44 20 7946 0958 now", "ask Dr. Jane Roe", "mail a@b.org", "plain"]
    spark.createDataFrame(list(enumerate(texts)) + [(4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["redacted_sha"] for r in registry.QUERIES["redacted_texts"](spark, str(tmp_path)).collect()}
    plain = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    assert set(found) == set(range(5)) and [found[i] != plain[i] for i in range(4)] == [True, True, True, False]


def test_excerpts_beside_other_characters(spark):
    body = 'He said "the quick brown fox jumps over the lazy dog." Or (so be it) and onetwo'
    texts = ["the quick brown fox jumps over the lazy dog", "said", "e said", "so be it", "the lazy dog.", "two", "it) and one", "quick  brown fox", "The quick brown", ""]
    docs = spark.createDataFrame([(1, body), (2, "no such words"), (3, None)], "doc_id long, text string")
    hits = evaluation.excerpt_hits(docs, spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "item_id long, text string")).collect()
    want = [(i, d["doc_id"]) for i, t in enumerate(texts) for d in docs.collect() if d["text"] is not None and t in d["text"]]
    assert sorted((r["item_id"], r["doc_id"]) for r in hits) == sorted(want)


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
