import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from provenant.operators import evaluation, grading, runs, scoring, spans, verify
from provenant.sources import sinks, tables, web


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_jsonl_and_latest_run(spark, tmp_path):
    lines = [{"run_id": f"r{i}", "vendor_id": "v", "as_of": f"2024-01-0{i}", "created_at": "2024-02-01T00:00:00Z"} for i in (1, 2, 3)]
    (tmp_path / "runs.jsonl").write_text("\n".join(map(json.dumps, lines)))
    found = tables.jsonl(spark, str(tmp_path / "runs.jsonl"), "runs")
    assert runs.latest_run(found, F.lit("2024-01-02")).first()["run_id"] == "r2"
    assert tables.replayed_as_of(found.where("run_id = 'r3'")) == "2024-01-03"
    with pytest.raises(ValueError):
        tables.replayed_as_of(found)


def test_sheet(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("Export,,\nVendor Name,Services provided,Site\nAcme,hosting,acme.com\n,,\n")
    found, issues = tables.sheet(spark, str(path), {"name": ["vendor name"], "service": ["service provided"], "website": ["site"], "region": []})
    assert rows(found) == [("Acme", "hosting", "acme.com", None)] and issues == [("E02", "no column for region")]


def test_inbox(spark, tmp_path):
    path = tmp_path / "i.csv"
    path.write_text("vendor_id,url,captured_at,file\nv1,https://x.com/legal/terms,2024-06-01 12:00:00,a.html\nv1,ftp://x,2024-06-01,b\n,https://x.com/legal,2024-06-01,c\nv2,https://x.com/legal,soon,d\n")
    good, bad = tables.inbox(spark, str(path), {"legal|terms": "LEG"}, "America/New_York")
    assert [(r["family"], r["retrieved_at"]) for r in good.collect()] == [("LEG", dt.datetime(2024, 6, 1, 16))]
    assert sorted(r["skipped"] for r in bad.collect()) == ["no time", "no url", "no vendor"]


def test_replay(spark):
    captures = spark.createDataFrame([("u1", "c1", 200, 1), ("u1", "c2", 403, 2), ("u2", "c3", 200, 1)], "url_requested string, capture_id string, status int, retrieved_at int")
    requests = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "url string")
    assert {r["url"]: r["outcome"] for r in tables.replayed(requests, captures).collect()} == {"u1": "blocked_bot", "u2": "ok", "u3": "replay_miss"}


def test_sitemaps_and_links(spark):
    body = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> http://h/a </loc><lastmod>2024-01-02T03:04</lastmod></url><url><loc>http://h/b</loc></url></urlset>'
    found = web.sitemaps(spark.createDataFrame([(1, body), (2, "no xml"), (3, None)], "key long, body string")).collect()
    assert [(r["key"], r["kind"], r["url"], r["lastmod"]) for r in found] == [(1, "page", "http://h/a", "2024-01-02"), (1, "page", "http://h/b", "")]
    pages = spark.createDataFrame([(1, "http://h/x/", '<a href="../y#z">y</a><a href="#q">q</a>')], "page_id long, url string, html string")
    assert rows(web.page_links(pages)) == [(1, "http://h/y")]


def test_dns(spark):
    def body(*data):
        return json.dumps({"Status": 0, "Answer": [{"name": "d", "type": 16, "TTL": 1, "data": x} for x in data] + [{"name": "d", "type": 5, "TTL": 1, "data": "cname"}]})

    answers = spark.createDataFrame([("d", "a", body('"x=1"', '"long" "er"')), ("d", "b", body("x=1")), ("e", "a", body("q")), ("e", "b", body('"q"')), ("f", "a", "broken")], "name string, resolver string, body string")
    records = web.dns_records(answers, 16)
    found = {r["name"]: (r["records"], r["agreed"]) for r in web.agreed_records(records).collect()}
    assert found["d"] == (["longer", "x=1"], False) and found["e"] == (["q"], True) and found["f"] == ([], False)


def test_filings_and_registrants(spark):
    body = json.dumps({"hits": {"hits": [{"_id": "0001-24-5:a.htm", "_source": {"ciks": ["0000042"], "form": "10-K", "file_date": "2024-03-01", "display_names": ["X"]}}]}})
    found = web.filings(spark.createDataFrame([(body,)], "body string")).first()
    assert found["url"] == "https://www.sec.gov/Archives/edgar/data/42/0001245/a.htm" and found["filed"] == dt.date(2024, 3, 1)
    listed = spark.createDataFrame([("ACME CORP", "1"), ("Acme Labs Inc.", "2")], "title string, cik string")
    vendors = spark.createDataFrame([("v1", "Acme, Inc"), ("v2", "Acme Lab")], "vendor_id string, name string")
    assert {r["vendor_id"]: r["cik"] for r in web.registrants(vendors, listed).collect()} == {"v1": "1", "v2": None}


def test_posts_snapshots_postings(spark):
    body = json.dumps([{"id": 5, "date": "2024-01-02T00:00:00", "link": "http://h/p", "title": {"rendered": "A &amp; B"}, "content": {"rendered": "<p>Hi</p>"}}])
    assert tuple(web.posts(spark.createDataFrame([(body,)], "body string")).first()) == (5, dt.date(2024, 1, 2), "http://h/p", "A & B", "Hi")
    closest = json.dumps({"archived_snapshots": {"closest": {"url": "http://web/1", "timestamp": "20230405060708"}}})
    assert rows(web.snapshots(spark.createDataFrame([("k", closest), ("l", "{}")], "key string, body string"))) == [("k", "http://web/1", dt.date(2023, 4, 5))]
    jobs = spark.createDataFrame([("ML engineer", "x", dt.date(2024, 1, 1)), ("ML engineer", "x", dt.date(2020, 1, 1)), ("Cook", "x", None), ("Cook", "uses ml", None)], "title string, body string, posted date")
    assert web.postings(jobs, "ml", "ml", F.lit(dt.date(2024, 6, 1))).count() == 2
    modes = spark.createDataFrame([(200,), (404,), (500,)], "s int").select(web.robots_mode(F.col("s")).alias("m")).collect()
    assert [r["m"] for r in modes] == ["rules", "allow", "deny"]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    assert rows(sinks.write_run({"docs": docs}, str(tmp_path), "r1")) == [("docs", 2)]
    assert rows(sinks.write_run({"docs": docs.limit(1)}, str(tmp_path), "r2")) == [("docs", 1)]
    cells = spark.createDataFrame([("t", "Low"), ("t", "Odd"), ("x", "long text"), ("y", "any")], "column string, value string")
    assert rows(sinks.over_budget(cells, {"x": 5}, {"t": ["Low", "High"]}).select("column", "problem")) == [("t", "not allowed"), ("x", "too long")]
    log = spark.createDataFrame([("m", "h", None, "ok"), ("q", "h", "text", None)], "model string, host string, payload string, status string")
    assert [r["violations"] for r in evaluation.audit_violations(log, ["m"], ["h"]).collect()] == [["model", "text", "status"]]


def test_verify(spark):
    body = "We run the Harbor engine in production today, and customers rely on it."
    docs = spark.createDataFrame([(1, body)], "doc_id long, text string")
    claims = spark.createDataFrame([
        (1, 1, "run the Harbor engine in production", ["Harbor", "Other"], ["in production"]), (2, 1, "run the Harbor engine in production", [], []),
        (3, 1, "nothing like this is in the document", [], []), (4, 9, "x", [], []), (5, 1, "too short", [], []),
    ], "claim_id long, doc_id long, quote string, names array<string>, indicators array<string>")
    found = {r["claim_id"]: r for r in verify.verify(claims, docs).collect()}
    assert found[1]["ok"] and found[1]["failures"] == ["V5"] and found[1]["names"] == ["Harbor"] and body[found[1]["start"] : found[1]["end"]] == "run the Harbor engine in production"
    assert [found[i]["ok"] for i in (2, 3, 4, 5)] == [False] * 4 and "V9" in found[2]["failures"] and found[4]["failures"] == ["V1"]


def test_fuzzy_recall(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again and again")], "doc_id long, text string")
    excerpts = spark.createDataFrame([(1, 1, "quick brown fox"), (2, 1, "quick brown fix jumps over"), (3, 1, "unrelated words entirely")], "item_id long, doc_id long, excerpt string")
    assert {r["item_id"]: r["how"] for r in verify.fuzzy_recall(excerpts, docs).collect()} == {1: "exact", 2: "fuzzy", 3: None}


def test_passages(spark):
    docs = spark.createDataFrame([(1, "Intro here. We use smart tools daily. Then more text follows. " + "Filler words go on. " * 60 + "The smart tools again."), (2, "nothing"), (3, None)], "doc_id long, text string")
    found = spans.passages(docs, ["smart tools"]).collect()
    text = docs.first()["text"]
    assert len(found) == 2 and all(r["passage"] == text[r["start"] : r["end"]] and r["hits"] == ["smart tools"] and len(r["passage"]) <= 700 for r in found)
    assert spans.passages(docs, ["smart tools"], suppress=["smart tools"]).count() == 0


def test_grades_are_monotone(spark):
    grid = spark.sql("SELECT u, sr, sp, rl, rc, locus FROM VALUES (1),(4),(7),(8) t(u), VALUES ('A'),('C'),('E') s(sr), VALUES (0),(2),(3) p(sp), VALUES (1),(2),(3) r(rl), VALUES (0),(2) c(rc), VALUES ('sdlc'),('relationship') l(locus)")
    grid = grid.selectExpr("*", "'x' AS ai_type", "'rules' AS method", "'accepted' AS review", "array() AS codes")
    found = grid.select("*", grading.qualifying().alias("q"), grading.corroborating().alias("k"), grading.strength().alias("s")).collect()
    assert all(r["k"] or not r["q"] for r in found) and {r["s"] for r in found if r["q"] and r["rl"] == 3} == {"Strong"}
    assert all((r["s"] == "Negative") == (r["u"] == 8) for r in found)


def test_more_exposure_never_lowers_risk(spark):
    grid = spark.range(4 * 4 * 4 * 5).selectExpr("id AS vendor_id", "int(id % 4) AS e", "int(id DIV 4 % 4) AS k", "int(id DIV 16 % 4) AS tier_points", "int(2) AS missing", "element_at(array('Confirmed','Probable','Inconclusive','Affirmed','Not detected'), int(id DIV 64) + 1) AS verdict", "array('X3') AS escalators")
    order = ["None identified", "Low", "Medium", "High", "Critical"]
    found = {(r["tier_points"], r["verdict"], r["k"], r["e"]): order.index(r["risk_class"]) for r in grid.join(scoring.risk(grid), "vendor_id").collect()}
    assert all(found[t, v, k, e] <= found[t, v, k, e + 1] for t, v, k, e in found if e < 3)


def test_policy_and_headers():
    assert tables.policy("[a]\nb = 1") == {"a": {"b": 1}}
    assert tables.map_headers(["Nme", "Name"], {"name": []})[0] == {"name": 1}
