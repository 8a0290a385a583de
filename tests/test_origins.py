"""Same-origin links, clusters and duplicates against brute force; gates that must fail closed."""

import random

import pytest
from pyspark.sql import functions as F

from provenant.functions import expressions as E
from provenant.functions import text
from provenant.operators import origins, runs, spans

ITEM = "vendor_id long, item_key long, doc_id string, url string, title string, excerpt string, dns string"


def brute_clusters(rows, linked):
    root = {(r[0], r[1]): (r[0], r[1]) for r in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and linked(a, b):
                x, y = sorted((find(a[:2]), find(b[:2])))
                root[y] = x
    return {k: str(find(k)[1]) for k in root}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"word{i}" for i in range(60)] + ["the", "of", "and"] * 6
    bases = [[rng.choice(words) for _ in range(rng.randrange(4, 25))] for _ in range(25)]
    out = []
    for i in range(160):
        own = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 3))):
            own[rng.randrange(len(own))] = rng.choice(words)
        rng.shuffle(own)
        out.append((i % 3, i, f"d{rng.randrange(400)}", "", "", " ".join(own) if i % 23 else None, "" if i % 19 else f"provider:p{i % 2}"))
    return out


def test_similar_links_against_all_pairs(spark, rows):
    found = origins.similar_links(spark.createDataFrame(rows, ITEM)).collect()
    words = lambda r: set(r[5].lower().split())
    want = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and not a[6] and not b[6] and a[5] and b[5] and a[5] != b[5]:
                if len(words(a) & words(b)) >= 0.5 * min(len(words(a)), len(words(b))) and text.token_set_ratio(a[5], b[5]) >= 90:
                    want.add((a[1], b[1]))
    assert {tuple(sorted((r["a"], r["b"]))) for r in found} == want and len(want) > 20


def test_clusters_against_brute_force(spark, rows):
    def linked(a, b):
        if a[6] or b[6]:
            return a[6] == b[6]
        if a[2] == b[2]:
            return True
        return bool(a[5] and b[5]) and text.token_set_ratio(a[5], b[5]) >= 90

    found = origins.clustered(spark.createDataFrame(rows, ITEM)).collect()
    assert {(r["vendor_id"], r["item_key"]): r["cluster_id"] for r in found} == brute_clusters(rows, linked)
    assert origins.clustered(spark.createDataFrame([], ITEM)).collect() == []


def test_title_keys_keep_the_order_of_words(spark):
    df = spark.createDataFrame([("One two three four | Four three two one",), ("Site – short",), ("Ünï çödé wörds ïn a title",), (None,)], "t string")
    found = [r[0] for r in df.select(E.title_keys(F.col("t"))).collect()]
    assert found == [["one two three four four three two one", "one two three four", "four three two one"], [], ["ünï çödé wörds ïn a title"], None]


def test_access_fails_closed(spark):
    terms = spark.createDataFrame([("a.com", "allowed", 1.0), ("b.com", "alowed", 1.0), ("c.com", None, 1.0), ("d.com", "limited", 1.0), ("e.com", "allowed", None), ("f.com", "allowed", 0.0)], "domain string, automation string, rps double")
    hosts = spark.createDataFrame([("x.a.com", False), ("b.com", True), ("c.com", True), ("d.com", None), ("d.com", True), ("e.com", True), ("f.com", True), ("none.org", True), ("", True)], "host string, seeded boolean")
    found = [(r["host"], r["seeded"], r["decision"]) for r in runs.access(hosts, terms).collect()]
    assert sorted(found, key=str) == sorted(
        [("x.a.com", False, "allow"), ("b.com", True, "unknown"), ("c.com", True, "unknown"), ("d.com", None, "seeds_only"), ("d.com", True, "allow"), ("e.com", True, "blocked_rate"), ("f.com", True, "blocked_rate"), ("none.org", True, "unknown"), ("", True, "no_host")],
        key=str,
    )


def test_passages_of_odd_terms(spark):
    docs = spark.createDataFrame([(1, "We use C++ (beta) here. Nothing else."), (2, "The sandbox is red."), (3, "A red  box stands.")], "doc_id long, text string")
    assert {r["doc_id"] for r in spans.passages(docs, ["c++ (beta)"]).collect()} == {1}
    assert {r["doc_id"] for r in spans.passages(docs, ["red box", "box is"]).collect()} == {3}
