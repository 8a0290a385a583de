"""Queries of scans, logs and streams: each writes its input to the shared folder, reads it through the library, and has the SQL
of what must come back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.functions.storage import checkpoint_dir
from provenant.operators import runs
from provenant.plans.tables import derived, query, read
from provenant.sources import sinks, tables, web
from provenant.streaming import logs


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


_COVERED = "SELECT 'v' || (o_custkey % 40) AS vendor_id, o_orderpriority AS family, o_orderkey % 2 = 0 AS mandatory, CAST(o_orderkey % 9 AS INT) AS requests, o_orderstatus AS status FROM orders"


@query(f"SELECT vendor_id, family, count(*) AS n, CAST(sum(requests) AS BIGINT) AS requests, count(*) FILTER (WHERE mandatory) AS mandatory FROM ({_COVERED}) GROUP BY 1, 2")
def coverage_lines(spark, sf_dir):
    path = _folder(spark)
    derived(spark, sf_dir, _COVERED).write.json(path)
    return tables.jsonl(spark, path, "coverage").groupBy("vendor_id", "family").agg(F.count(F.lit(1)).alias("n"), F.sum("requests").alias("requests"), F.count_if("mandatory").alias("mandatory"))


_PROFILED = """SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN 'Example vendor' ELSE c_name END AS name, CASE WHEN c_custkey % 7 = 0 THEN 'V1' ELSE 'V' || c_custkey END AS vendor_id, CASE WHEN c_custkey % 5 > 0 THEN 'hosting' END AS service,
  CASE WHEN c_custkey % 6 = 0 THEN 'Odd' ELSE 'Tier' END AS category, CASE WHEN c_custkey % 9 = 0 THEN 'not an address' WHEN c_custkey % 2 = 0 THEN concat('https:/', '/h.example.com') ELSE 'www.h.org' END AS website FROM customer"""


@query(f"""
WITH p AS ({_PROFILED}), d AS (SELECT vendor_id FROM p GROUP BY 1 HAVING count(*) > 1)
SELECT code, what, count(*) AS n FROM (
  SELECT 'E04' AS code, vendor_id AS what FROM p WHERE vendor_id IN (SELECT vendor_id FROM d) UNION ALL SELECT 'E05', 'name' FROM p WHERE name = '' UNION ALL SELECT 'E05', 'service' FROM p WHERE service IS NULL
  UNION ALL SELECT 'E06', 'Odd' FROM p WHERE category = 'Odd' UNION ALL SELECT 'E07', website FROM p WHERE website = 'not an address' UNION ALL SELECT 'E08', name FROM p WHERE name = 'Example vendor') GROUP BY 1, 2
""")
def sheet_issues(spark, sf_dir):
    """A sheet's rows read below a title line and a header whose names are only like the ones looked for."""
    path = _folder(spark)
    lines = derived(spark, sf_dir, _PROFILED).select(F.concat_ws(",", "vendor_id", "name", F.coalesce("service", F.lit("")), "category", "website").alias("line"), F.col("c_custkey").alias("k"))
    top = spark.createDataFrame([("Export of profiles,,,,", -2), ("Vendor ID,Vendor names,Services,Categories,Web site", -1)], "line string, k long")
    top.unionByName(lines).coalesce(1).sortWithinPartitions("k").select("line").write.text(path)
    aliases = {"vendor_id": ["vendor id"], "name": ["vendor name"], "service": ["service"], "category": ["category"], "website": ["web site"]}
    rows, issues = tables.sheet(spark, path, aliases)
    if issues:
        raise ValueError(f"columns not found: {issues}")
    return tables.profile_issues(rows, "vendor_id", ["name", "service"], ["Tier"]).groupBy("code", "what").agg(F.count(F.lit(1)).alias("n"))


_MANUAL = """SELECT CASE WHEN c_custkey % 8 = 0 THEN '' ELSE 'v' || c_custkey END AS vendor_id, CASE WHEN c_custkey % 5 = 0 THEN 'file.html' WHEN c_custkey % 3 = 0 THEN concat('https:/', '/h.org/Legal/terms') ELSE concat('https:/', '/h.org/blog') END AS url,
  CASE WHEN c_custkey % 7 = 0 THEN 'soon' ELSE '2024-06-0' || (1 + c_custkey % 9) || ' 12:00:00' END AS captured_at, 'f' || c_custkey AS file FROM customer"""


@query(f"""
SELECT file, CASE WHEN vendor_id = '' THEN 'no vendor' WHEN url = 'file.html' THEN 'no url' WHEN captured_at = 'soon' THEN 'no time' WHEN url NOT LIKE '%Legal%' THEN 'no family' ELSE '' END AS skipped,
  CASE WHEN vendor_id <> '' AND url LIKE '%Legal%' AND captured_at <> 'soon' THEN replace(captured_at, ' 12:', ' 16:') END AS retrieved FROM ({_MANUAL})
""")
def manual_inbox(spark, sf_dir):
    path = _folder(spark)
    derived(spark, sf_dir, _MANUAL).write.option("header", True).csv(path)
    good, bad = tables.inbox(spark, path, {"legal|terms": "LEG"}, "America/New_York")
    good = good.select("file", F.lit("").alias("skipped"), F.date_format("retrieved_at", "yyyy-MM-dd HH:mm:ss").alias("retrieved"))
    return good.union(bad.select("file", "skipped", F.lit(None).cast("string")))


@query("""SELECT c_custkey AS key, CAST(o AS INT) AS ordinal, CASE WHEN c_custkey % 4 = 0 THEN 'map' ELSE 'page' END AS kind, concat('http:/', '/h/', c_custkey, '/', o) AS url, CASE WHEN o = 0 THEN '2024-01-0' || (1 + c_custkey % 9) ELSE '' END AS lastmod FROM customer, (VALUES (0), (1)) v(o) WHERE c_custkey % 5 > 0""")
def sitemap_pages(spark, sf_dir):
    k = F.col("c_custkey")
    tag = lambda name: F.concat(F.lit(f"<{name}set><{name}><loc> http://h/"), k, F.lit("/0 </loc><lastmod>2024-01-0"), 1 + k % 9, F.lit(f"T03:04</lastmod></{name}><{name}><loc>http://h/"), k, F.lit(f"/1</loc></{name}></{name}set>"))
    body = F.when(k % 5 == 0, "no xml").when(k % 4 == 0, tag("sitemap")).otherwise(F.concat(F.lit('<?xml version="1.0"?>'), F.regexp_replace(tag("url"), "<urlset>", '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">')))
    return web.sitemaps(read(spark, sf_dir, "customer").select(k.alias("key"), body.alias("body")))


_LOGGED = "SELECT 'k' || (o_orderkey % 700) AS key, o_orderkey AS seq, o_orderstatus AS value FROM orders"


@query(f"SELECT key, arg_max(value, seq) AS value, max(seq) AS seq FROM ({_LOGGED}) GROUP BY 1")
def review_log(spark, sf_dir):
    """Two appends to a log, read back as the last row of each key."""
    path, rows = _folder(spark), derived(spark, sf_dir, _LOGGED)
    for part in (0, 1):
        sinks.append(rows.where(F.col("seq") % 2 == part), path)
    return runs.latest(spark.read.parquet(path), ["key"], ["seq"]).select("key", "value", "seq")


@query(f"SELECT 'log' AS \"table\", 'r2' AS run_id, count(*) AS n FROM ({_LOGGED}) WHERE seq % 3 = 0")
def newest_assessment(spark, sf_dir):
    path, rows = _folder(spark), derived(spark, sf_dir, _LOGGED)
    sinks.write_run({"log": rows}, path, "r1")
    sinks.write_run({"log": rows.where("seq % 3 = 0")}, path, "r2")
    return sinks.latest_assessment(spark, path, ["log"])["log"].groupBy(F.lit("log").alias("table"), "run_id").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey AS k, CASE WHEN length(o_orderpriority) > 8 AND o_orderkey % 2 = 0 THEN 'too long' WHEN o_orderkey % 2 = 1 AND o_orderstatus NOT IN ('O', 'F') THEN 'not allowed' END AS problem FROM orders
WHERE (length(o_orderpriority) > 8 AND o_orderkey % 2 = 0) OR (o_orderkey % 2 = 1 AND o_orderstatus NOT IN ('O', 'F'))
""")
def cell_budgets(spark, sf_dir):
    odd = F.col("o_orderkey") % 2 == 1
    cells = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(odd, "status").otherwise("priority").alias("column"), F.when(odd, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority")).alias("value"))
    return sinks.over_budget(cells, {"priority": 8}, {"status": ["O", "F"]}).select("k", "problem")


@query("SELECT (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) || '' AS day")
def replay_day(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    newest = runs.latest(orders.select(F.lit("v").alias("vendor_id"), F.to_date("o_orderdate").cast("string").alias("as_of")), ["vendor_id"], ["as_of"])
    return spark.createDataFrame([(tables.replayed_as_of(newest),)], "day string")


@query("""
WITH r AS (SELECT 'c' || (o_orderkey % 500) AS capture_id, 'u' || (o_orderkey % 500) AS url_requested, CAST(o_orderkey % 500 AS INT) AS n FROM orders)
SELECT capture_id, CASE WHEN n % 2 = 0 THEN 'run' ELSE 'manual' END AS family FROM r WHERE n % 2 = 0 OR n % 9 < 5 GROUP BY 1, 2
""")
def manual_additions(spark, sf_dir):
    """A run's captures and the manual ones up to a day, each once."""
    n = (F.col("o_orderkey") % 500).cast("int")
    rows = read(spark, sf_dir, "orders").select(F.concat(F.lit("c"), n).alias("capture_id"), F.concat(F.lit("u"), n).alias("url_requested"), n.alias("n"), F.timestamp_add("DAY", n % 9, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("retrieved_at"))
    run = rows.where("n % 2 = 0").dropDuplicates(["capture_id"]).withColumn("family", F.lit("run"))
    return tables.with_additions(run, rows.where("n % 2 = 1").withColumn("family", F.lit("manual")), "2024-01-05").select("capture_id", "family")


def _streamed(spark, df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _table(spark, stream: DataFrame, path: str, mode: str) -> DataFrame:
    """What a stream gave: rows that are only appended go to files by executors, the whole aggregate of a complete mode to memory."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-check").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(f"{path}-rows").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}-rows")
    name = f"stream_{uuid.uuid4().hex}"
    writer.format("memory").queryName(name).start().awaitTermination()
    return spark.table(name)


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_windows(spark, sf_dir):
    path = _folder(spark)
    counts = logs.windowed_counts(_streamed(spark, read(spark, sf_dir, "events"), path), "ts", "60 days", "1 day", "event_type")
    return _table(spark, counts, path, "complete")


@query("SELECT user_id, event_type, 1::BIGINT AS n FROM events GROUP BY 1, 2")
def streamed_firsts(spark, sf_dir):
    path = _folder(spark)
    first = logs.first_of_each(_streamed(spark, read(spark, sf_dir, "events"), path), "ts", "60 days", "user_id", "event_type")
    return _table(spark, first, path, "append").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


_STEPS = "SELECT o_custkey % 40 AS key, o_orderkey AS step, o_orderkey % 4 = 0 AS fresh FROM orders"


@query(f"""
WITH s AS ({_STEPS}), i AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY key ORDER BY step) AS island FROM s), d AS (SELECT *, count(*) FILTER (WHERE NOT fresh) OVER (PARTITION BY key, island ORDER BY step) AS idle FROM i)
SELECT key, step, idle, coalesce(max(idle) OVER (PARTITION BY key ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 6, false) AS stopped FROM d
""")
def streamed_idle_steps(spark, sf_dir):
    path = _folder(spark)
    return _table(spark, logs.idle_steps(_streamed(spark, derived(spark, sf_dir, _STEPS), path), 6), path, "append")


@query(f"SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM ({_LOGGED}) GROUP BY 1")
def streamed_upserts(spark, sf_dir):
    """Two runs of a stream over a growing log; the second merges with what the first left."""
    path, rows = _folder(spark), derived(spark, sf_dir, _LOGGED)
    for part in (0, 1):
        rows.where(F.col("seq") % 2 == part).write.mode("append").parquet(f"{path}/in")
        logs.upsert_latest(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/out", ["key"], ["seq"], f"{path}/check").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/out/v=1").select("key", "seq", "value")


@query("SELECT doc_id, sha256(text) AS text_sha, length(text) AS n_chars, true AS intact FROM documents")
def stored_texts(spark, sf_dir):
    """Texts stored in two parts, the second with some that are there already, and read again by their hash."""
    path, docs = _folder(spark), read(spark, sf_dir, "documents")
    wanted = tables.store(docs.where("doc_id % 2 = 0"), path).union(tables.store(docs.where("doc_id % 3 = 0"), path).where("doc_id % 2 = 1")).union(tables.store(docs.where("doc_id % 6 IN (1, 5)"), path))
    return tables.stored(spark, path, wanted).select("doc_id", "text_sha", F.length("text").alias("n_chars"), "intact")


@query("""
WITH j AS (SELECT o_custkey % 30 AS vendor_id, o_orderkey AS k, CASE (o_custkey % 30) % 4 WHEN 0 THEN 'workday' WHEN 1 THEN 'oracle_orc' WHEN 2 THEN 'workable' END AS platform, o_orderpriority AS title, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) END AS posted FROM orders)
SELECT vendor_id, platform, 'j' || k AS job_id FROM j WHERE platform IS NOT NULL AND (regexp_matches(lower(title), 'urgent|high') OR k % 50 = 0) AND (posted IS NULL OR posted >= DATE '1998-06-30') AND (k % 3 = 0 OR k % 50 = 0)
""")
def job_details(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 30).alias("vendor_id"), F.concat(F.lit("j"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 5 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("Posted today").alias("day"), F.col("o_orderkey").alias("k"))
    platform = F.element_at(F.array(*map(F.lit, ("workday", "oracle_orc", "workable", "other"))), (F.col("vendor_id") % 4 + 1).cast("int"))
    every = lambda **names: F.collect_list(F.struct(*[F.col(c).alias(n) for n, c in names.items()]))
    grouped = orders.groupBy("vendor_id").agg(
        F.to_json(F.struct(every(title="title", externalPath="id", postedOn="day").alias("jobPostings"))).alias("workday"),
        F.to_json(F.struct(F.array(F.struct(every(Id="id", Title="title", PostedDate="day").alias("requisitionList"))).alias("items"))).alias("oracle_orc"),
        F.to_json(F.struct(every(title="title", shortcode="id", published_on="day").alias("jobs"))).alias("workable"),
    ).withColumn("platform", platform)
    body = F.when(F.col("platform") == "workday", F.col("workday")).when(F.col("platform") == "oracle_orc", F.col("oracle_orc")).otherwise(F.col("workable"))
    jobs = web.job_lists(grouped.select("vendor_id", "platform", body.alias("body")))
    details = orders.select("vendor_id", F.col("id").alias("job_id"), F.when(F.col("k") % 3 == 0, "with Machine Learning").otherwise("without").alias("body"))
    seeds = orders.where("k % 50 = 0").select("vendor_id", F.col("id").alias("job_id"))
    return web.detailed(jobs, details, "urgent|high", "machine learning", F.lit("2000-06-30").cast("date"), seeds).select("vendor_id", "platform", "job_id")


@query("""
SELECT c_custkey AS capture_id, CASE c_custkey % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'json' WHEN 2 THEN 'text' ELSE 'pdf' END AS kind, CASE c_custkey % 4 WHEN 0 THEN c_name ELSE '' END AS title,
  CASE c_custkey % 4 WHEN 0 THEN 'Body of ' || c_custkey WHEN 1 THEN '{"a":' || c_custkey || ',"b":"x"}' WHEN 2 THEN 'plain ' || c_custkey ELSE '' END AS text,
  CASE WHEN c_custkey % 8 = 0 THEN '2024-03-0' || (1 + c_custkey % 9) WHEN c_custkey % 3 = 0 THEN '2021-05-04' ELSE '' END AS published, CASE WHEN c_custkey % 8 = 0 THEN 'meta' WHEN c_custkey % 3 = 0 THEN 'last-modified' ELSE '' END AS basis FROM customer
""")
def extracted_documents(spark, sf_dir):
    k = F.col("c_custkey")
    dated = F.when(k % 8 == 0, F.concat(F.lit('<meta name="date" content="2024-03-0'), 1 + k % 9, F.lit('">'))).otherwise("")
    page = F.concat(F.lit("<html><head><title>"), "c_name", F.lit("</title>"), dated, F.lit("</head><body><nav>Menu</nav><p>Body  of "), k, F.lit("</p></body></html>"))
    body = F.when(k % 4 == 0, page).when(k % 4 == 1, F.concat(F.lit('{ "b": "x",\n "a": '), k, F.lit("}"))).when(k % 4 == 2, F.concat(F.lit("plain "), k)).otherwise("%PDF-1.4 ...")
    kind = F.when(k % 4 == 1, "application/json").when(k % 4 == 0, "text/html; charset=utf-8")
    captures = read(spark, sf_dir, "customer").select(k.alias("capture_id"), kind.alias("content_type"), F.lit("http://h/p").alias("url"), body.alias("body"), F.when(k % 3 == 0, "Tue, 04 May 2021 10:00:00 GMT").alias("last_modified"))
    return web.documents(captures)
