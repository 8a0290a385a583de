"""The gold report's fuzzy path, duplicates and folds against brute force, and logs that must not lose keys."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from provenant.functions import text
from provenant.operators import folds, gold, origins, spans
from provenant.plans import registry
from provenant.streaming import logs

ITEM = "item_key long, vendor_id long, url string, family string, excerpt string, ai_type string, method string, review string, u int, sr string, sp int, rl int, rc int, locus string, codes array<string>"


def test_answers_by_likeness(spark):
    said = "the quick brown fox jumps over the lazy dog"
    excerpts = ["something else entirely is told here", "a quick brown fax jumps over the lazy dog now", "the quick brown fox", "short", None]
    items = [(i, 1, "https://h.org/p", "PRD", x, "genai_llm", "rules", "accepted", 1, "A", 3, 3, 3, "service_feature", []) for i, x in enumerate(excerpts)]
    findings = spark.createDataFrame([(1, 1, "PRD", "http://h.org/p", said), (2, 1, "PRD", "https://h.org/p/", said[:10]), (3, 1, "PRD", "https://h.org/other", said), (4, 1, "PRD", "https://H.org/p#x", said.replace("fox", "ox"))], "finding_id long, vendor_id long, family string, url string, excerpt string")
    found = {r["finding_id"]: r for r in gold.answered(findings.withColumn("url", F.regexp_replace("url", "^http:", "https:")), spark.createDataFrame(items, ITEM)).collect()}
    assert found[1]["item_key"] == 2 and found[1]["overlap"] == 100 and found[1]["basis"] == "excerpt"
    assert found[2]["basis"] == "url" and found[2]["overlap"] == 0 and found[3]["item_key"] is None
    best = max((text.partial_ratio(*sorted((said.replace("fox", "ox"), x), key=len))[0], -i) for i, x in enumerate(excerpts[:3]))
    assert found[4]["overlap"] == pytest.approx(best[0]) and found[4]["item_key"] == -best[1]


def most_rows(df):
    """The rows of a query, and the most rows that any operator of its plan made."""
    rows, most, todo = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
        made = node.metrics().get("numOutputRows")
        most = max(most, made.get().value() if made.isDefined() else 0)
    return rows, most


FINDING = "finding_id long, vendor_id long, family string, url string, expect string, excerpt string"


def test_captures_make_no_pairs(spark):
    """Half the findings at one page, half at one name asked for, as many captures; no operator makes more rows than a few times these."""
    n, asked = F.col("id") % 2 == 0, F.concat(F.lit("https://d/q?name=H.org&x="), "id")
    place = F.when(n, "https://h.org/p").otherwise(asked)
    findings = spark.range(2000).select(F.col("id").alias("finding_id"), F.lit(1).alias("vendor_id"), F.when(n, "PRD").otherwise("DNS").alias("family"), place.alias("url"))
    found, most = most_rows(gold.captured(findings, spark.range(10_000, 12_000).select(F.lit(1).alias("vendor_id"), F.col("id").alias("capture_id"), place.alias("url"))))
    assert {(r["finding_id"] % 2, r["n_captures"], r["basis"]) for r in found} == {(0, 1000, "url"), (1, 1000, "dns domain")} and len(found) == 2000
    assert most <= 20_000


def test_captures_of_odd_rows(spark):
    rows = [(1, 1, "DNS", "https://d/q?name=a.org", "x", "x"), (2, 1, "DNS", "https://D/q?name=b.org", "x", "x"), (3, 1, "PRD", "https://e/q?name=a.org", "x", "x"), (4, 1, "DNS", None, "x", "x"), (5, None, "DNS", "https://d/q?name=a.org", "x", "x"), (6, 2, None, "https://d/q?name=a.org", "x", "x"), (7, 1, "DNS", "https://no.name/", "x", "x")]
    captures = [(1, 10, "https://d/q?name=a.org"), (1, 10, "https://d/q?name=a.org#again"), (1, 11, "https://e/?name=A.org."), (1, 12, "https://e/?name=b.org"), (1, 13, None), (1, 14, "https://other/"), (None, 15, "https://d/q?name=a.org")]
    found = gold.captured(spark.createDataFrame(rows, FINDING), spark.createDataFrame(captures, "vendor_id long, capture_id long, url string"))
    assert {r["finding_id"]: (r["n_captures"], r["basis"]) for r in found.collect()} == {1: (1, "url"), 2: (1, "dns domain"), 3: (0, None), 4: (0, None), 5: (0, None), 6: (0, None), 7: (0, None)}


def test_answers_make_no_pairs(spark):
    """As many items as findings at one page and one name, with a few excerpts: only these meet, and the best item answers."""
    n, half = F.col("id"), F.col("id") % 2 == 0
    place = F.when(half, "https://h.org/p").otherwise(F.concat(F.lit("https://d/q?name=H.org&x="), n))
    fields = {"ai_type": F.lit("genai_llm"), "method": F.lit("rules"), "review": F.when(n < 10_100, "rejected").otherwise("accepted"), "u": F.lit(1), "sr": F.lit("A"), "sp": F.lit(3), "rl": F.lit(3), "rc": F.lit(3), "locus": F.lit("sdlc"), "codes": F.array().cast("array<string>")}
    excerpt = F.when(n % 3 == 0, "Some words about a thing").otherwise("brief")
    items = spark.range(10_000, 12_000).select(n.alias("item_key"), F.lit(1).alias("vendor_id"), place.alias("url"), F.lit("x").alias("family"), excerpt.alias("excerpt"), *[v.alias(k) for k, v in fields.items()])
    findings = spark.range(2000).select(n.alias("finding_id"), F.lit(1).alias("vendor_id"), F.when(half, "PRD").otherwise("DNS").alias("family"), place.alias("url"), F.when(n % 4 < 2, "words about a thing").otherwise("tiny").alias("excerpt"))
    found, most = most_rows(gold.answered(findings, items))
    want = {0: (10_104, 100.0, "excerpt"), 1: (10_101, 100.0, "excerpt"), 2: (10_100, 0.0, "url"), 3: (10_101, 0.0, "url")}
    assert len(found) == 2000 and {(r["finding_id"] % 4, r["item_key"], r["overlap"], r["basis"]) for r in found} == {(k, *v) for k, v in want.items()}
    assert most <= 20_000


def test_answers_against_every_pair(spark):
    """Findings and items at few pages and names, with nulls, short and edited excerpts, against all pairs in Python."""
    rng = random.Random(5)
    said = [None, "short", " The Quick brown fox jumps", "the quick brown fox jumps over", "a quick brawn fox jumps", "other words altogether", "quick brown fox"]
    urls = [None, "https://h.org/p", "https://H.org/p/#x", "https://d/q?name=a.org", "https://d/q?name=A.org.&x=1", "https://e/"]
    items = [(i, rng.choice([None, 1, 2]), rng.choice(urls), "x", rng.choice(said), rng.choice(["not_ai", "genai_llm"]), "rules", rng.choice(["rejected", "accepted"]), rng.choice([1, 7, 8]), "A", rng.randrange(4), 3, 3, rng.choice(["sdlc", "relationship"]), []) for i in range(60)]
    findings = [(i, rng.choice([None, 1, 2, 3]), rng.choice([None, "DNS", "PRD"]), rng.choice(urls), "strong", rng.choice(said)) for i in range(400)]
    have = spark.createDataFrame(items, ITEM)
    graded = {r["item_key"]: r for r in have.select("item_key", (~gold.grading.citable()).alias("b"), gold.grading.position(gold.grading.strength(), gold.grading.STRENGTHS).alias("d"), gold.grading.strength().alias("s")).collect()}
    page = {None: None, urls[1]: 1, urls[2]: 1, urls[3]: 3, urls[4]: 4, urls[5]: 5}

    def overlap(x, y):
        x, y = ((t or "").strip().lower() for t in (x, y))
        return 0.0 if min(len(x), len(y)) < gold.SEGMENT else 100.0 if x in y or y in x else text.partial_ratio(x, y)[0]

    want = {}
    for i, vendor, family, url, _, excerpt in findings:
        mine = [x for x in items if vendor is not None and x[1] == vendor]
        met = [x for x in mine if url and page[x[2]] == page[url]] or [x for x in mine if family == "DNS" and url and x[2] and "name=" in url and "name=" in x[2]]
        scored = [((o < 90, graded[x[0]]["b"], -o, graded[x[0]]["d"], x[0]), x[5] == "not_ai") for x in met for o in [overlap(excerpt, x[4])]]
        (far, _, o, _, key), trap = min(scored) if scored else ((None, None, None, None, None), None)
        want[i] = (key, None if o is None else -o, None if far is None else "url" if far else "excerpt", graded[key]["s"] if key is not None else None, trap)
    found = gold.answered(spark.createDataFrame(findings, FINDING), have).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == want and len(found) == 400 and sum(v[0] is not None for v in want.values()) > 80


def crowded(spark, path):
    """Orders whose findings and items share one vendor and number of a page, and DuckDB over them."""
    rows = spark.range(3000).select((F.col("id") * 70).alias("o_orderkey"), (F.col("id") % 25 * 40).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.expr("timestamp '1997-01-01' + make_interval(0, 0, 0, int(id % 900))").alias("o_orderdate"))
    rows.write.parquet(f"{path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{path}/orders.parquet/*.parquet')")
    return con


def test_strengths_of_a_crowded_page(spark, tmp_path):
    want = crowded(spark, tmp_path).execute(registry.ORACLES["gold_strengths"]).fetchall()
    found, most = most_rows(registry.QUERIES["gold_strengths"](spark, str(tmp_path)))
    assert sorted(map(tuple, found)) == sorted(want) and len(want) == 1500 and most <= 20_000


def test_report_of_a_crowded_page(spark, tmp_path):
    want = crowded(spark, tmp_path).execute(registry.ORACLES["gold_report"]).fetchall()
    found, most = most_rows(registry.QUERIES["gold_report"](spark, str(tmp_path)))
    assert sorted(map(tuple, found)) == sorted(want) and len(want) == 10 and most <= 20_000


def dealt_rows(spark, name, path):
    """The rows that a query's exchanges deal out when no table is small enough to be sent whole."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = registry.QUERIES[name](spark, str(path))
        df.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    dealt, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "ShuffleExchangeExec":
            dealt += node.metrics().apply("shuffleRecordsWritten").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return dealt


def test_strengths_deal_findings_once(spark, tmp_path):
    """1,500 findings that ask alike, and what few they ask."""
    crowded(spark, tmp_path)
    assert dealt_rows(spark, "gold_strengths", tmp_path) < 1.5 * 1500


def test_report_deals_findings_once_a_section(spark, tmp_path):
    """1,500 findings for each of three sections, 3,000 captures that are told apart, and what few are asked."""
    crowded(spark, tmp_path)
    assert dealt_rows(spark, "gold_report", tmp_path) < 4 * 1500 + 3000


def test_streamed_folds_by_key(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]), rng.randrange(1000), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, size long, id long").repartition(5)

    def step(state, row):
        state[0] += row[1]
        return (row[0], state[0]) if row[1] % 2 else None

    found = folds.streamed(df, ["k"], ["size", F.desc("id")], ["id", "size"], lambda: [0], step, ["id", "total"], [("long", pa.int64())] * 2).collect()
    want, totals = set(), {}
    for k, size, i in sorted(rows, key=lambda r: (str(r[0]), r[1], -r[2])):
        totals[k] = totals.get(k, 0) + size
        if size % 2:
            want.add((k, i, totals[k]))
    assert {tuple(r) for r in found} == want
    assert folds.streamed(df.limit(0), ["k"], ["size"], ["id", "size"], lambda: [0], step, ["id", "total"], [("long", pa.int64())] * 2).collect() == []


def test_duplicates_against_the_greedy_walk(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.randrange(80), rng.randrange(4), s := rng.randrange(300), s + rng.randrange(5, 60), rng.choice(["rules", "llm", "manual"])) for _ in range(200)]
    df = spark.createDataFrame(rows, "vendor_id long, item_key long, doc_id long, start long, end long, method string").dropDuplicates(["vendor_id", "item_key", "doc_id", "start"])
    full = df.selectExpr("*", "'accepted' AS review", "'genai_llm' AS ai_type", "1 AS u", "'A' AS sr", "int(item_key % 4) AS sp", "3 AS rl", "3 AS rc", "'sdlc' AS locus", "cast(array() as array<string>) AS codes")
    found = {(r["vendor_id"], r["item_key"], r["doc_id"], r["start"]): r["kept"] for r in origins.dedupe(full).collect()}
    ranks = {"manual": 0, "rules": 1, "llm": 2}
    strengths = {r["item_key"]: r["s"] for r in full.select("item_key", F.expr("CASE WHEN sp >= 2 THEN 1 ELSE 7 END").alias("s")).collect()}
    kept, want = [], {}
    weak = {k: (1 if k % 4 >= 2 else 6 if k % 4 == 0 else 7) for k in strengths}
    for v, k, d, a, z, m in sorted(((r["vendor_id"], r["item_key"], r["doc_id"], r["start"], r["end"], r["method"]) for r in df.collect()), key=lambda r: (r[0], weak[r[1]], ranks[r[5]], r[3] - r[4], r[1], r[2], r[3])):
        ok = not any(v == x[0] and (k == x[1] or d == x[2] and a < x[4] and x[3] < z) for x in kept)
        want[v, k, d, a] = ok
        if ok:
            kept.append((v, k, d, a, z))
    assert found == want


def test_headings_reach_only_so_far(spark):
    lines = spark.createDataFrame([(1, 0, 9, "Top", "heading"), (1, 10, 19, "prose here", "prose"), (1, 20, 29, "x" * 150, "heading"), (2, 0, 5, "Other", "heading")], "doc_id long, start long, end long, line string, shape string")
    hits = spark.createDataFrame([(1, 1, 15), (2, 1, 3100), (3, 1, 5), (4, 3, 9)], "id long, doc_id long, start long")
    assert {r["id"]: r["heading"] for r in spans.with_heading(hits, lines).collect()} == {1: "Top", 2: None, 3: None, 4: None}


def test_an_upsert_without_its_last_version_fails(spark, tmp_path):
    schema, source, out = "key string, seq long", str(tmp_path / "in"), tmp_path / "out"
    import shutil

    for i in range(2):
        spark.createDataFrame([(f"k{i}", i)], schema).write.mode("append").parquet(source)
        query = logs.upsert_latest(spark.readStream.schema(schema).parquet(source), str(out), ["key"], ["seq"], str(tmp_path / "check"))
        if i:
            with pytest.raises(Exception, match="(?i)path|exist"):
                query.awaitTermination()
        else:
            query.awaitTermination()
            shutil.rmtree(out / "v=0")
