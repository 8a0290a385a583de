"""Queries of scans, sinks, joins and scalar functions, over collector payloads made from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenant.functions import expressions as E
from provenant.functions import udfs
from provenant.functions.storage import checkpoint_dir
from provenant.operators import evaluation, grading, runs, spans, verify
from provenant.plans.tables import ITEMS, PROFILES, derived, items, query, read
from provenant.sources import sinks, tables, web

_CAPTURES = "SELECT 'u' || (o_custkey % 300) AS url_requested, 'c' || o_orderkey AS capture_id, CASE o_orderkey % 6 WHEN 0 THEN 403 WHEN 1 THEN 500 ELSE 200 END AS status, CAST(o_orderdate AS DATE) AS retrieved_at FROM orders"


@query(f"""
WITH c AS ({_CAPTURES}), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url_requested ORDER BY retrieved_at DESC, capture_id DESC) AS n FROM c) WHERE n = 1), r AS (SELECT DISTINCT 'u' || (c_custkey % 400) AS url FROM customer)
SELECT url, capture_id, CASE WHEN capture_id IS NULL THEN 'replay_miss' WHEN status IN (403, 503) THEN 'blocked_bot' WHEN status BETWEEN 200 AND 299 THEN 'ok' ELSE 'error' END AS outcome FROM r LEFT JOIN l ON url = url_requested
""")
def replay_fetch(spark, sf_dir):
    requests = read(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey") % 400).alias("url")).distinct()
    return tables.replayed(requests, derived(spark, sf_dir, _CAPTURES)).select("url", "capture_id", "outcome")


_RUNS = "SELECT o_custkey % 40 AS vendor_id, CAST(o_orderdate AS DATE) AS as_of, o_orderkey % 7 AS created_at, 'r' || o_orderkey AS run_id FROM orders"


@query(f"SELECT vendor_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY as_of DESC, created_at DESC, run_id DESC) AS n FROM ({_RUNS}) WHERE as_of <= DATE '2000-06-30') WHERE n = 1")
def latest_run(spark, sf_dir):
    return runs.latest_run(derived(spark, sf_dir, _RUNS), F.lit("2000-06-30").cast("date")).select("vendor_id", "run_id")


@query("""
SELECT DISTINCT o_custkey % 40 AS vendor_id, 'u' || (o_custkey % 350) AS url FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM orders m WHERE m.o_orderkey % 11 = 0 AND m.o_custkey % 40 = o.o_custkey % 40 AND m.o_custkey % 350 = o.o_custkey % 350)
""")
def unvisited_seeds(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("vendor_id"), F.concat(F.lit("u"), F.col("o_custkey") % 350).alias("url"), (F.col("o_orderkey") % 11 == 0).alias("manual"))
    return tables.unvisited_seeds(orders.select("vendor_id", "url").distinct(), orders.withColumn("url_final", F.col("url")))


def _dns(spark, sf_dir) -> DataFrame:
    """A body for each of two resolvers and name: the second lacks one record of some names."""
    rows = read(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_custkey") % 200).alias("name"), F.concat(F.lit('"k='), F.col("c_custkey") % 17, F.lit('"')).alias("data"), F.col("c_custkey").alias("i"))
    both = rows.withColumn("resolver", F.explode(F.array(F.lit("a"), F.lit("b")))).where("resolver = 'a' OR i % 23 > 0")
    answer = F.struct(F.col("name").alias("name"), F.when(F.col("i") % 5 == 0, 5).otherwise(16).alias("type"), F.lit(60).alias("TTL"), F.col("data").alias("data"))
    return both.groupBy("name", "resolver").agg(F.to_json(F.struct(F.lit(0).alias("Status"), F.collect_list(answer).alias("Answer"))).alias("body"))


@query("""
WITH r AS (SELECT 'n' || (c_custkey % 200) AS name, x AS resolver, CASE WHEN c_custkey % 5 > 0 THEN 'k=' || (c_custkey % 17) END AS rec, c_custkey FROM customer, (VALUES ('a'), ('b')) v(x) WHERE x = 'a' OR c_custkey % 23 > 0),
s AS (SELECT name, resolver, coalesce(string_agg(DISTINCT rec, ',' ORDER BY rec), '') AS recs FROM r GROUP BY 1, 2)
SELECT name, (SELECT coalesce(string_agg(DISTINCT rec, ',' ORDER BY rec), '') FROM r WHERE r.name = s.name) AS records, count(DISTINCT recs) <= 1 AS agreed FROM s GROUP BY name
""")
def dns_agreement(spark, sf_dir):
    return web.agreed_records(web.dns_records(_dns(spark, sf_dir), 16)).withColumn("records", F.array_join("records", ","))


@query("""
SELECT '0001-' || o_orderkey AS accession, 'd' || (o_custkey % 9) || '.htm' AS document, CASE WHEN o_orderkey % 2 = 0 THEN '10-K' ELSE '8-K' END AS form, strftime(o_orderdate, '%Y-%m-%d') AS filed,
  'https://www.sec.gov/Archives/edgar/data/' || (o_custkey + 1) || '/0001' || o_orderkey || '/d' || (o_custkey % 9) || '.htm' AS url FROM orders
""")
def filings_flattened(spark, sf_dir):
    source = F.struct(F.array(F.lpad((F.col("o_custkey") + 1).cast("string"), 10, "0")).alias("ciks"), F.when(F.col("o_orderkey") % 2 == 0, "10-K").otherwise("8-K").alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("file_date"), F.array(F.lit("X")).alias("display_names"))
    hit = F.struct(F.concat(F.lit("0001-"), "o_orderkey", F.lit(":d"), F.col("o_custkey") % 9, F.lit(".htm")).alias("_id"), source.alias("_source"))
    bodies = read(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 50).alias("page")).agg(F.to_json(F.struct(F.struct(F.collect_list(hit).alias("hits")).alias("hits"))).alias("body"))
    return web.filings(bodies).withColumn("filed", F.col("filed").cast("string"))


@query("""
WITH v AS (SELECT c_custkey AS vendor_id, 'Supplier#' || lpad(CAST(c_custkey % 150 AS VARCHAR), 9, '0') || ', Inc.' AS name FROM customer), l AS (SELECT regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS k, min('' || s_suppkey) AS cik FROM supplier GROUP BY 1 HAVING count(*) = 1)
SELECT vendor_id, cik FROM v LEFT JOIN l ON k = regexp_replace(regexp_replace(lower(name), '[ ,.]+inc[.]?$', ''), '[^a-z0-9]', '', 'g')
""")
def registrant_lookup(spark, sf_dir):
    vendors = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vendor_id"), F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 150).cast("string"), 9, "0"), F.lit(", Inc.")).alias("name"))
    listed = read(spark, sf_dir, "supplier").select(F.concat("s_name", F.lit(" LTD")).alias("title"), F.col("s_suppkey").cast("string").alias("cik"))
    return web.registrants(vendors, listed).select("vendor_id", "cik")


@query("SELECT o_orderkey FROM orders WHERE (regexp_matches(lower(o_orderpriority), 'urgent|high') OR o_orderkey % 13 = 0) AND (o_orderkey % 17 = 0 OR CAST(o_orderdate AS DATE) >= DATE '1998-12-31')")
def job_postings(spark, sf_dir):
    body = F.when(F.col("o_orderkey") % 13 == 0, "You will train Machine Learning models").otherwise("You will not")
    posted = F.when(F.col("o_orderkey") % 17 > 0, F.to_date("o_orderdate"))
    jobs = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("title"), body.alias("body"), posted.alias("posted"))
    return web.postings(jobs, "urgent|high", "machine learning", F.lit("2000-12-31").cast("date")).select("o_orderkey")


@query("SELECT 'k' || c_custkey AS key, 'http://web/' || c_custkey AS url, '20' || lpad(CAST(c_custkey % 24 AS VARCHAR), 2, '0') || '-0' || (1 + c_custkey % 9) || '-15' AS day FROM customer WHERE c_custkey % 3 > 0")
def archive_snapshots(spark, sf_dir):
    when = F.concat(F.lit("20"), F.lpad((F.col("c_custkey") % 24).cast("string"), 2, "0"), F.lit("0"), 1 + F.col("c_custkey") % 9, F.lit("15101112"))
    closest = F.struct(F.concat(F.lit("http://web/"), "c_custkey").alias("url"), when.alias("timestamp"))
    body = F.when(F.col("c_custkey") % 3 > 0, F.to_json(F.struct(F.struct(closest.alias("closest")).alias("archived_snapshots")))).otherwise("{}")
    bodies = read(spark, sf_dir, "customer").select(F.concat(F.lit("k"), "c_custkey").alias("key"), body.alias("body"))
    return web.snapshots(bodies).withColumn("day", F.col("day").cast("string"))


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS base, unnest(regexp_extract_all(html, '<a href="(/[^"#]*)"', 1)) AS href FROM pages)
SELECT page_id, count(DISTINCT base || href) AS n, min(base || href) AS first_target FROM p GROUP BY 1
""")
def page_links(spark, sf_dir):
    return web.page_links(read(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("first_target"))


@query(r"""
SELECT doc_id AS id, '2024-01-02' AS day, 'http://h/' || doc_id AS link, length(trim(regexp_replace(regexp_replace(text, '[<>&]', ' ', 'g'), '\s+', ' ', 'g'))) AS n_chars FROM documents
""")
def blog_posts(spark, sf_dir):
    post = F.struct(F.col("doc_id").alias("id"), F.lit("2024-01-02T00:00:00").alias("date"), F.concat(F.lit("http://h/"), "doc_id").alias("link"), F.struct(F.lit("T").alias("rendered")).alias("title"), F.struct(F.concat(F.lit("<p>"), F.regexp_replace("text", "[<>&]", " "), F.lit("</p>")).alias("rendered")).alias("content"))
    bodies = read(spark, sf_dir, "documents").select(F.to_json(F.array(post)).alias("body"))
    return web.posts(bodies).select("id", F.col("day").cast("string").alias("day"), "link", F.length("text").alias("n_chars"))


@query(f"SELECT 'items' AS \"table\", count(*) AS \"rows\" FROM ({ITEMS}) UNION ALL SELECT 'decisions', count(*) FROM (SELECT DISTINCT event_type, value > 50 FROM events)")
def run_manifest(spark, sf_dir):
    """A run's tables and how many rows of each were written and can be read again."""
    path = f"{checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"
    gates = sinks.decisions(read(spark, sf_dir, "events").select(F.col("event_type").alias("gate"), F.when(F.col("value") > 50, "deny").otherwise("allow").alias("decision")))
    return sinks.write_run({"items": items(spark, sf_dir), "decisions": gates}, path, "r1")


_LOG = "SELECT o_custkey % 40 AS vendor_id, 'm' || (o_orderkey % 4) AS model, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'withheld' ELSE 'ok' END AS status, o_orderkey % 3 = 0 AS cached, 'h' || (o_custkey % 6) AS host, CASE WHEN o_orderkey % 31 = 0 THEN 'text' END AS payload, o_orderkey AS call FROM orders"


@query(f"SELECT vendor_id, count(*) AS calls, count(*) FILTER (WHERE cached) AS cached, count(*) FILTER (WHERE status = 'withheld') AS withheld, count(DISTINCT model) AS models, round(100.0 * count(*) FILTER (WHERE status = 'withheld') / count(*), 1) AS percent_withheld FROM ({_LOG}) GROUP BY 1")
def call_statistics(spark, sf_dir):
    return sinks.call_statistics(derived(spark, sf_dir, _LOG))


@query(f"""
SELECT call, concat_ws(',', CASE WHEN model NOT IN ('m0', 'm1') THEN 'model' END, CASE WHEN host NOT IN ('h0', 'h1', 'h2', 'h3') THEN 'host' END, CASE WHEN payload IS NOT NULL THEN 'text' END, CASE WHEN status IS NULL THEN 'status' END) AS violations
FROM ({_LOG}) WHERE model NOT IN ('m0', 'm1') OR host NOT IN ('h0', 'h1', 'h2', 'h3') OR payload IS NOT NULL OR status IS NULL
""")
def audit_gate(spark, sf_dir):
    found = evaluation.audit_violations(derived(spark, sf_dir, _LOG), ["m0", "m1"], ["h0", "h1", "h2", "h3"])
    return found.select("call", F.array_join("violations", ",").alias("violations"))


@query(f"SELECT 'F' || (mask % 4) AS failure, count(*) AS n FROM ({ITEMS}) WHERE mask % 2 = 0 GROUP BY 1")
def failure_histogram(spark, sf_dir):
    return sinks.failures(items(spark, sf_dir).select(F.when(F.col("mask") % 2 == 0, F.array(F.concat(F.lit("F"), F.col("mask") % 4))).otherwise(F.array().cast("array<string>")).alias("failures")))


@query("SELECT event_type AS gate, CASE WHEN value > 50 THEN 'deny' ELSE 'allow' END AS decision, count(*) AS n FROM events GROUP BY 1, 2")
def gate_histogram(spark, sf_dir):
    return sinks.decisions(read(spark, sf_dir, "events").select(F.col("event_type").alias("gate"), F.when(F.col("value") > 50, "deny").otherwise("allow").alias("decision")))


@query(f"SELECT item_key, 'U' || u || ' · SR:' || sr || ' · SP:S' || sp || ' · RL:R' || rl || ' · RC:T' || rc || ' · locus=' || locus AS tags FROM ({ITEMS})")
def tag_strings(spark, sf_dir):
    return items(spark, sf_dir).select("item_key", grading.tag_string().alias("tags"))


@query(f"""
WITH i AS ({ITEMS}), r AS (SELECT o_orderkey % 400 AS item_key, o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'pending' END AS value FROM orders),
l AS (SELECT item_key, arg_max(value, seq) AS value FROM r GROUP BY 1)
SELECT i.item_key, coalesce(l.value, 'pending') AS review FROM i LEFT JOIN l ON i.item_key = l.item_key
""")
def reviewed_items(spark, sf_dir):
    value = F.when(F.col("o_orderkey") % 3 == 0, "accepted").when(F.col("o_orderkey") % 3 == 1, "rejected").otherwise("pending")
    reviews = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 400).alias("item_key"), F.col("o_orderkey").alias("seq"), value.alias("value"))
    return runs.reviewed(items(spark, sf_dir).drop("review"), reviews).select("item_key", "review")


@query(f"""
WITH i AS ({ITEMS}), c AS (SELECT *, (CASE WHEN mask % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN mask % 3 = 0 THEN 1 ELSE 0 END) AS points FROM i)
SELECT vendor_id, item_key, points FROM (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY points DESC, item_key) AS n FROM c WHERE points > 0) WHERE n <= 12
""")
def keyword_triage(spark, sf_dir):
    points = sum((F.when(F.array_contains("codes", c), 1).otherwise(0) for c in ("G1", "G2")), F.lit(0))
    return grading.top_scored(items(spark, sf_dir), points, ["vendor_id"], [F.col("item_key")], 12).select("vendor_id", "item_key", "points")


@query(f"""
WITH i AS ({ITEMS}), d AS (SELECT vendor_id, list_sort(list(DISTINCT 'p' || publisher)) AS p FROM i GROUP BY 1)
SELECT vendor_id, CASE len(p) WHEN 1 THEN p[1] WHEN 2 THEN p[1] || ' and ' || p[2] ELSE array_to_string(p[1:len(p) - 1], ', ') || ', and ' || p[len(p)] END AS publishers FROM d
""")
def publisher_lists(spark, sf_dir):
    rows = items(spark, sf_dir).groupBy("vendor_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("p"), "publisher"))).alias("p"))
    return rows.select("vendor_id", E.serial_list(F.col("p")).alias("publishers"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[.]{3}|…')) AS INT) AS ellipses, substring(text, 1, 60) = text AS short, strftime(DATE '2024-01-01' + CAST(doc_id % 366 AS INT), '%-d %B %Y') AS written FROM documents")
def text_facts(spark, sf_dir):
    day = E.written_date(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 366).cast("int")))
    return read(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(r"[.]{3}|…")).alias("ellipses"), (E.clip(F.col("text"), 60) == F.col("text")).alias("short"), day.alias("written"))


@query("SELECT p_partkey, 1 + CAST(len(list_filter([10, 20, 30, 40], lambda o: o <= p_size)) AS INT) AS page, regexp_replace(lower(regexp_replace(p_name, ' (inc|ltd)$', '')), '[^a-z0-9]', '', 'g') AS name_key FROM part")
def page_numbers(spark, sf_dir):
    offsets = F.array(*map(F.lit, (0, 10, 20, 30, 40)))
    return read(spark, sf_dir, "part").select("p_partkey", E.page_number(offsets, F.col("p_size")).alias("page"), E.compact_key(F.col("p_name")).alias("name_key"))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'allow' WHEN page_id % 5 = 1 THEN 'deny' ELSE 'rules' END AS mode, page_id % 7 = 0 AND page_id % 5 = 1 AS wall, CASE WHEN page_id % 3 = 0 THEN url ELSE 'http://' || page_id END AS original FROM pages")
def robots_and_walls(spark, sf_dir):
    i = F.col("page_id")
    status = F.when(i % 5 == 0, 404).when(i % 5 == 1, 503).otherwise(200)
    body = F.when(i % 7 == 0, "Please solve the CAPTCHA").otherwise("hello")
    address = F.when(i % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("https://archive.example/web/20240101000000id_/http://"), i))
    return read(spark, sf_dir, "pages").select("page_id", web.robots_mode(status).alias("mode"), web.bot_wall(status, F.lit(""), body).alias("wall"), E.archived(address).alias("original"))


@query("""
SELECT d.doc_id AS item_key, concat_ws(',', CASE WHEN d.doc_id % 4 = 1 THEN 'text' END, CASE WHEN d.doc_id % 4 = 2 THEN 'slice' END, CASE WHEN d.doc_id % 4 = 2 THEN 'key' END) AS problems FROM documents d
""")
def reverified_items(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    odd = F.col("doc_id") % 4
    true = F.substring("text", 6, 10)
    rows = docs.select(
        F.col("doc_id"), F.lit("u").alias("url"), F.lit(5).alias("start"), F.lit(15).alias("end"), F.when(odd == 2, F.concat(true, F.lit("!"))).otherwise(true).alias("excerpt"),
        F.sha2(F.when(odd == 1, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("text_sha"), E.item_key(F.lit("u"), true).alias("item_key"),
    )
    return verify.reverify(rows, docs).select(F.col("doc_id").alias("item_key"), F.array_join("problems", ",").alias("problems"))


@query(f"""
WITH p AS ({PROFILES}) SELECT vendor_id, concat_ws(',', CASE WHEN e >= 2 AND missing % 2 = 0 THEN 'X1' END, CASE WHEN e >= 2 AND missing % 3 = 0 THEN 'X2' END, CASE WHEN x3 THEN 'X3' END, CASE WHEN k >= 3 THEN 'X4' END, CASE WHEN x6 AND d >= 3 THEN 'X6' END) AS escalators FROM p
""")
def escalators(spark, sf_dir):
    flags = {"X1": (F.col("e") >= 2) & (F.col("missing") % 2 == 0), "X2": (F.col("e") >= 2) & (F.col("missing") % 3 == 0), "X3": F.col("x3"), "X4": F.col("k") >= 3, "X6": F.col("x6") & (F.col("d") >= 3)}
    return derived(spark, sf_dir, PROFILES).select("vendor_id", F.array_join(F.array_compact(F.array(*[F.when(f, F.lit(c)) for c, f in flags.items()])), ",").alias("escalators"))


@query(f"""
WITH i AS ({ITEMS}), r AS (SELECT item_key, CASE WHEN review = 'rejected' OR ai_type = 'not_ai' OR (method = 'llm' AND review = 'pending') THEN 'Logged' WHEN u = 8 THEN 'Negative' WHEN locus IN ('relationship', 'platform_supplier', 'affiliate_inferred') THEN 'Context' ELSE 'Logged' END AS role FROM i)
SELECT role, count(*) AS n, min(item_key) AS first_key FROM r GROUP BY 1
""")
def item_roles(spark, sf_dir):
    role = F.when(~grading.citable(), "Logged").when(F.col("u") == 8, "Negative").when(F.col("locus").isin("relationship", "platform_supplier", "affiliate_inferred"), "Context").otherwise("Logged")
    return items(spark, sf_dir).withColumn("role", role).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.min("item_key").alias("first_key"))


@query("""
SELECT conv_id, turn, role, lag(turn) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
""")
def turns_in_context(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("turn").over(w).alias("before"), F.lead("role").over(w).alias("after"))


_LINES = "SELECT o_custkey % 300 AS doc_id, o_orderkey * 10 AS start, o_orderkey * 10 + 9 AS end_at, 'Line ' || o_orderkey AS line, CASE WHEN o_orderkey % 9 = 0 THEN 'heading' ELSE 'prose' END AS shape FROM orders"


@query(f"""
WITH l AS ({_LINES}), h AS (SELECT c_custkey AS id, c_custkey % 300 AS doc_id, c_custkey * 97 AS start FROM customer), j AS (SELECT id, l.start AS at, line, row_number() OVER (PARTITION BY id ORDER BY end_at DESC) AS n FROM h JOIN l ON h.doc_id = l.doc_id AND shape = 'heading' AND end_at <= h.start)
SELECT h.id, h.doc_id, h.start, CASE WHEN h.start - j.at <= 3000 THEN line END AS heading FROM h LEFT JOIN j ON h.id = j.id AND n = 1
""")
def nearest_heading(spark, sf_dir):
    hits = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 300).alias("doc_id"), (F.col("c_custkey") * 97).alias("start"))
    return spans.with_heading(hits, derived(spark, sf_dir, _LINES).withColumnRenamed("end_at", "end"))


_TRACE = "SELECT o_orderkey AS passage_id, o_custkey % 900 AS doc_id FROM orders"


@query(f"""
WITH p AS ({_TRACE}), d AS (SELECT c_custkey AS doc_id, c_custkey % 70 AS capture_id, 's' || (c_custkey % 50) AS text_sha FROM customer WHERE c_custkey % 6 > 0 AND c_custkey < 900)
SELECT passage_id, CASE WHEN d.doc_id IS NULL THEN 'document' WHEN capture_id >= 60 THEN 'capture' WHEN text_sha = 's7' THEN 'text' ELSE 'none' END AS missing FROM p LEFT JOIN d ON p.doc_id = d.doc_id
""")
def traced_passages(spark, sf_dir):
    own = read(spark, sf_dir, "customer").where("c_custkey < 900")
    docs = own.where("c_custkey % 6 > 0").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 70).alias("capture_id"), F.concat(F.lit("s"), F.col("c_custkey") % 50).alias("text_sha"))
    captures = spark.range(60).select(F.col("id").alias("capture_id"), F.lit("u").alias("url"))
    texts = spark.range(50).where("id <> 7").select(F.concat(F.lit("s"), "id").alias("text_sha"), F.lit("t").alias("text"))
    found, missed = spans.traced(derived(spark, sf_dir, _TRACE), docs, captures, texts)
    return found.select("passage_id", F.lit("none").alias("missing")).union(missed.select("passage_id", "missing"))


@query("""
SELECT o_orderkey AS k, CASE o_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE CASE o_orderkey % 5 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN o_custkey % 4 = 2 WHEN 3 THEN false ELSE true END END AS allowed FROM orders
""")
def robots_rules(spark, sf_dir):
    body = "# ours\nUser-agent: other\nDisallow: /\n\nUser-Agent: Evidence\nUser-agent: x\nDisallow: /private\nAllow: /private/open$\nDisallow: /*.pdf\n"
    strict = body + "\nUser-agent: *\nDisallow:\n"
    files = spark.createDataFrame([("o0", 404, None), ("o1", 500, body), ("o2", 200, body.replace("User-agent: x", "Crawl-delay: 3")), ("o3", 200, strict + "User-agent: evidence\nDisallow: /c\n")], "origin string, status int, body string")
    path = F.expr("element_at(array('/private/x', '/private/open', '/c/d', '/a/b.pdf?x', '/'), cast(o_orderkey % 5 + 1 as int))")
    requests = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("o"), F.col("o_custkey") % 4).alias("origin"), path.alias("path"))
    return web.robots_decision(requests, files, "evidence").select("k", "allowed")


@query("""
WITH r AS (SELECT o_custkey % 40 AS vendor_id, o_orderkey AS seq, 'u' || (o_orderkey % 37) AS url, o_orderkey % 6 = 0 AS refused FROM orders), f AS (SELECT *, row_number() OVER (PARTITION BY vendor_id, url ORDER BY seq) = 1 AS first FROM r),
c AS (SELECT *, coalesce(sum(CASE WHEN first AND NOT refused THEN 1 ELSE 0 END) OVER (PARTITION BY vendor_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS made FROM f)
SELECT vendor_id, seq, first_value(made < 20) OVER (PARTITION BY vendor_id, url ORDER BY seq) AS granted, CAST(least(made, 20) AS BIGINT) AS spent FROM c
""")
def refunded_budget(spark, sf_dir):
    requests = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("vendor_id"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("u"), F.col("o_orderkey") % 37).alias("url"), F.lit("").alias("accept"), (F.col("o_orderkey") % 6 == 0).alias("refused"))
    return runs.spent(requests, ["vendor_id"], ["seq"], F.lit(20), F.col("refused")).select("vendor_id", "seq", "granted", F.col("spent").cast("long").alias("spent"))


@query("""
WITH r AS (SELECT 'n' || (c_custkey % 200) AS name, x AS resolver, CASE WHEN c_custkey % 5 > 0 THEN 'k=' || (c_custkey % 17) END AS rec FROM customer, (VALUES ('a'), ('b')) v(x) WHERE x = 'a' OR c_custkey % 23 > 0),
s AS (SELECT name, resolver, coalesce(string_agg(DISTINCT rec, ',' ORDER BY rec), '') AS recs FROM r GROUP BY 1, 2)
SELECT name, CASE WHEN count(DISTINCT recs) <= 1 THEN 'done' ELSE 'error' END AS status, CASE WHEN count(DISTINCT recs) <= 1 THEN '' ELSE 'resolvers differ' END AS note FROM s GROUP BY name
""")
def dns_coverage(spark, sf_dir):
    return web.dns_coverage(web.agreed_records(web.dns_records(_dns(spark, sf_dir), 16)))


_SET = "SELECT o_orderkey - o_orderkey % 4 AS item_key, CASE o_orderkey % 3 WHEN 0 THEN 'rejected' ELSE 'accepted' END AS value, o_orderkey AS seq, CASE WHEN o_orderkey % 4 = 1 THEN 3 END AS rl, CASE WHEN o_orderkey % 4 = 2 THEN 'sdlc' END AS locus FROM orders"


@query(f"""
WITH l AS (SELECT item_key, arg_max({{'v': value, 'rl': rl, 'locus': locus}}, seq) AS x FROM ({_SET}) GROUP BY 1)
SELECT i.item_key, coalesce(x.v, 'pending') AS review, coalesce(x.rl, i.rl) AS rl, coalesce(x.locus, i.locus) AS locus, CASE WHEN x.rl IS NOT NULL OR x.locus IS NOT NULL THEN 'adjudicated' ELSE method END AS method FROM ({ITEMS}) i LEFT JOIN l ON i.item_key = l.item_key
""")
def adjudicated_items(spark, sf_dir):
    reviews = derived(spark, sf_dir, _SET).withColumns({c: F.lit(None).cast("int") for c in ("sp", "u")} | {"ai_type": F.lit(None).cast("string")})
    return runs.adjudicated(items(spark, sf_dir), reviews).select("item_key", "review", "rl", "locus", "method")


@query("""
WITH b AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM benchmark), v AS (SELECT DISTINCT array_to_string(w[2:5], ' ') AS s FROM b WHERE len(w) >= 5),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, count(DISTINCT s) AS n_whole FROM (SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM d, unnest(range(1, len(w) - 2)) t(i)) JOIN v USING (s) GROUP BY 1
""")
def blocked_values(spark, sf_dir):
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    values = read(spark, sf_dir, "benchmark").select(words.alias("w")).where(F.size("w") >= 5).select(F.array_join(F.slice("w", 2, 4), " ").alias("text"))
    return evaluation.blocked_wholes(read(spark, sf_dir, "documents"), values)


@query("""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS n FROM documents) SELECT doc_id, CAST(len(n) AS INT) AS numbers, CAST(len(list_distinct(n)) AS INT) AS distinct_numbers FROM d WHERE len(n) > 0
""")
def number_counts(spark, sf_dir):
    found = read(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)).alias("n"))
    return found.where(F.size("n") > 0).select("doc_id", F.size("n").alias("numbers"), F.size(F.array_distinct("n")).alias("distinct_numbers"))


_PROPOSED = """SELECT o_orderkey AS id, o_orderkey % 300 AS doc_id, (o_orderkey * 41 + o_custkey * 13) % 5000 AS start, (o_orderkey * 41 + o_custkey * 13) % 5000 + 25 + o_custkey % 60 AS end_at FROM orders"""
_HELD = """SELECT c_custkey AS id, c_custkey % 300 AS doc_id, (c_custkey * 59) % 5000 AS start, (c_custkey * 59) % 5000 + 30 + c_custkey % 300 AS end_at FROM customer"""


@query(f"""
WITH a AS ({_PROPOSED}), b AS ({_HELD}), j AS (SELECT a.id AS proposal_id, b.id AS item_id, row_number() OVER (PARTITION BY a.id ORDER BY least(a.end_at, b.end_at) - greatest(a.start, b.start) DESC, b.id) AS n FROM a JOIN b ON a.doc_id = b.doc_id AND a.start < b.end_at AND b.start < a.end_at)
SELECT a.id AS proposal_id, item_id FROM a LEFT JOIN j ON a.id = proposal_id AND n = 1
""")
def claims_merged(spark, sf_dir):
    """Proposals absorbed by the item they overlap most; the others stay."""
    own, held = (derived(spark, sf_dir, x).withColumnRenamed("end_at", "end") for x in (_PROPOSED, _HELD))
    return verify.merge(own, held)


@query("""
SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'exact' ELSE 'fuzzy' END AS how, CASE WHEN item_id % 3 = 0 THEN 100.0::DOUBLE ELSE round(100.0::DOUBLE * (length(cut) - 1) / length(cut), 6) END AS score
FROM (SELECT item_id, doc_id, substr(regexp_extract(lower(b.text), '[a-z]+ [a-z]+ [a-z]+ [a-z]+'), 1, 40) AS cut, d.text FROM benchmark b, documents d WHERE contains(d.text, b.text)) WHERE length(cut) >= 12
""")
def fuzzy_recall(spark, sf_dir):
    """Four words of each excerpt that a document has; in two thirds of them one letter is another one."""
    marks, docs = read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents")
    hits = evaluation.excerpt_hits(docs, marks)
    cut = F.substring(F.regexp_extract(F.lower("text"), "[a-z]+ [a-z]+ [a-z]+ [a-z]+", 0), 1, 40)
    edited = F.when(F.col("item_id") % 3 == 0, cut).otherwise(F.concat(F.substring(cut, 1, 5), F.lit("\u0416"), F.expr("substring(cut, 7)")))
    own = marks.select("item_id", cut.alias("cut")).where(F.length("cut") >= 12).select("item_id", F.when(F.col("item_id") % 3 == 0, F.col("cut")).otherwise(F.concat(F.substring("cut", 1, 5), F.lit("\u0416"), F.expr("substring(cut, 7)"))).alias("excerpt"))
    found = verify.fuzzy_recall(hits.join(own, "item_id"), docs.withColumn("text", F.lower("text")))
    return found.withColumn("score", F.round("score", 6))


@query(r"""
WITH q AS (SELECT doc_id, text, substr(text, 11, 60) AS quote FROM documents), c AS (
  SELECT doc_id * 2 AS claim_id, doc_id, text, quote, 0 AS names, 0 AS codes FROM q
  UNION ALL SELECT doc_id * 2 + 1, doc_id, text, CASE doc_id % 4 WHEN 1 THEN quote || 'zzq' WHEN 2 THEN substr(text, 11, 12) ELSE quote END, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END, CASE WHEN doc_id % 4 = 3 THEN 1 ELSE 0 END FROM q
), l AS (SELECT *, CASE WHEN regexp_matches(quote, '^\s*$') THEN -1 ELSE strpos(text, quote) - 1 END AS place FROM c),
f AS (SELECT *, CASE WHEN place >= 0 THEN place + length(quote) ELSE -1 END AS stop, row_number() OVER (PARTITION BY doc_id, CASE WHEN place >= 0 THEN place ELSE -1 END, CASE WHEN place >= 0 THEN place + length(quote) ELSE -1 END ORDER BY claim_id) AS n FROM l),
g AS (SELECT *, place < 0 AS v2, contains(quote, '...') OR contains(quote, '…') OR length(quote) < 25 OR length(quote) > 600 AS v3, place >= 0 AND n > 1 AS v9 FROM f)
SELECT claim_id, concat_ws(',', CASE WHEN v2 THEN 'V2' END, CASE WHEN v3 THEN 'V3' END, CASE WHEN codes = 1 THEN 'V4' END, CASE WHEN names = 1 THEN 'V5' END, CASE WHEN v9 THEN 'V9' END) AS failures, CAST(CASE WHEN v2 THEN -1 ELSE place END AS INT) AS start, CAST(stop AS INT) AS "end", NOT (v2 OR v3 OR v9) AS ok FROM g
""")
def verified_quotes(spark, sf_dir):
    """Two claims of each document: its quote; and that with words added, too short, or with a name or an indicator that it lacks."""
    docs, odd = read(spark, sf_dir, "documents"), F.col("doc_id") % 4
    quote, none = F.substring("text", 11, 60), F.array().cast("array<string>")
    first = docs.select((F.col("doc_id") * 2).alias("claim_id"), "doc_id", quote.alias("quote"), none.alias("names"), none.alias("indicators"))
    other = F.when(odd == 1, F.concat(quote, F.lit("zzq"))).when(odd == 2, F.substring("text", 11, 12)).otherwise(quote)
    second = docs.select((F.col("doc_id") * 2 + 1).alias("claim_id"), "doc_id", other.alias("quote"), F.when(odd == 0, F.array(F.lit("Zzqx"))).otherwise(none).alias("names"), F.when(odd == 3, F.array(F.lit("zzqy"))).otherwise(none).alias("indicators"))
    return verify.verify(first.union(second), docs).select("claim_id", F.array_join("failures", ",").alias("failures"), "start", "end", "ok")


@query()
def sorted_titles(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", F.lag("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("before"))
    return rows.where("before IS NOT NULL").select("p_partkey", F.round(udfs.set_ratio(F.col("p_name"), F.col("before")), 6).alias("set_ratio"), F.round(udfs.sort_ratio(F.col("p_name"), F.col("before")), 6).alias("sort_ratio"))


@query("SELECT d.doc_id, p.first_id, p.n FROM documents d JOIN (SELECT sha256(text) AS sha, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1) p ON sha256(d.text) = p.sha")
def content_store(spark, sf_dir):
    """Content-addressed lookup: every document with the first that has its bytes."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    store = docs.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return docs.join(store, "sha").select("doc_id", "first_id", "n")


@query("""
WITH d AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2), f AS (SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS n FROM conversations) WHERE n = 1)
SELECT conv_id, string_agg(role, ',' ORDER BY t, role) AS roles FROM d GROUP BY 1
""")
def ordered_distinct_roles(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    return turns.select("conv_id", F.array_join(E.ordered_distinct(F.col("roles")), ",").alias("roles"))


@query("""SELECT sha256('{"k":' || json_extract_string(props, '$.k') || ',"t":"' || event_type || '"}') AS sha, count(*) AS n FROM events GROUP BY 1""")
def canonical_events(spark, sf_dir):
    parsed = F.map_concat(F.create_map(F.lit("t"), F.concat(F.lit('"'), "event_type", F.lit('"'))), F.create_map(F.lit("k"), F.get_json_object("props", "$.k")))
    text = F.regexp_replace(F.regexp_replace(E.canonical_json(parsed), r'\\"', '"'), r'"k":"(-?\d+)"', '"k":$1')
    return read(spark, sf_dir, "events").select(F.sha2(F.regexp_replace(text, '""', '"'), 256).alias("sha")).groupBy("sha").agg(F.count(F.lit(1)).alias("n"))


_URL_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


@query(f"""
WITH h AS (SELECT page_id, {_URL_HOST} AS host, array_to_string(list_slice(string_split({_URL_HOST}, '.'), greatest(1, len(string_split({_URL_HOST}, '.')) - 1), len(string_split({_URL_HOST}, '.'))), '.') AS site FROM pages)
SELECT page_id, CASE WHEN host = '' THEN 'none' WHEN site = 'example.com' THEN 'own' ELSE 'other' END AS route FROM h
""")
def request_routes(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", E.route(F.col("url"), F.lit("www.example.com")).alias("route"))


@query(f"""
WITH h AS (SELECT page_id, {_URL_HOST} AS host, DATE '2024-01-01' + CAST(page_id % 30 AS INT) AS day FROM pages), r AS (SELECT *, CASE WHEN page_id % 7 = 0 THEN NULL ELSE day END AS lastmod FROM h)
SELECT host, page_id FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY lastmod DESC NULLS LAST, page_id) AS n FROM r) WHERE n <= 5
""")
def newest_pages(spark, sf_dir):
    """The newest pages of a host first, undated ones last; five a host, as a collector's budget has it."""
    pages = read(spark, sf_dir, "pages")
    day = F.when(F.col("page_id") % 7 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 30).cast("int")))
    rows = pages.select(E.host(F.col("url")).alias("host"), "page_id", day.alias("lastmod"))
    return grading.newest_first(rows, ["host"], "lastmod", ["page_id"], 5).select("host", "page_id")


@query(f"""
WITH i AS ({ITEMS}) SELECT vendor_id, family, count(*) AS n, count(*) FILTER (WHERE review = 'accepted') AS accepted, CAST(min(published) AS VARCHAR) AS first_day, CAST(max(published) AS VARCHAR) AS last_day
FROM i GROUP BY ROLLUP (vendor_id, family)
""")
def coverage_sheet(spark, sf_dir):
    """Rows of a report sheet with totals by vendor and over all."""
    return items(spark, sf_dir).rollup("vendor_id", "family").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("review") == "accepted").alias("accepted"), F.min("published").cast("string").alias("first_day"), F.max("published").cast("string").alias("last_day")
    )
