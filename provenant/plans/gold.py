"""Queries of evaluation against prior findings, and of the rules on addresses, hashes, keys and reviews, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.functions import expressions as E
from provenant.operators import gold, runs
from provenant.plans import evidence
from provenant.plans.tables import ITEMS, derived, items, query, read
from provenant.sources import sinks, web

_GOLD = """
SELECT o_orderkey AS finding_id, o_custkey % 40 AS vendor_id, CASE WHEN o_orderkey % 6 = 0 THEN 'DNS' ELSE 'PRD' END AS family,
  CASE WHEN o_orderkey % 6 = 0 THEN concat('https:/', '/dns.test/q?name=H', o_orderkey % 70, '.Org.&type=TXT') ELSE concat('HTTPS:/', '/S', o_orderkey % 70, '.org/p/') END AS url,
  CASE o_orderkey % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'weak' ELSE 'none' END AS expect, CASE WHEN o_orderkey % 4 = 0 THEN 'short' ELSE concat('Words about p', o_orderkey % 70) END AS excerpt FROM orders WHERE o_orderkey % 20 < 7
"""
_EXPECTED = {"strong": ("Strong", "Moderate"), "weak": ("Weak", "Marketing only", "Negative"), "none": ("Context - relationship only",)}


def _gold(spark, sf_dir):
    return derived(spark, sf_dir, _GOLD)


def _placed(spark, sf_dir):
    n = F.col("item_key") % 70
    asked = F.concat(F.lit("https://dns.test/q?type=A&name=h"), n, F.lit(".org"))
    page = F.concat(F.lit("https://s"), n, F.lit(".org/p#part"))
    excerpt = F.when(F.col("item_key") % 3 == 0, F.concat(F.lit("Some words about p"), n, F.lit(" and more"))).otherwise("brief")
    return items(spark, sf_dir).withColumns({"url": F.when(F.col("family") == "DNS", asked).otherwise(page), "excerpt": excerpt})


_MET = evidence._GRADED + f""", gold AS ({_GOLD}), met AS (
  SELECT finding_id, expect, g.excerpt AS said, r.*, CASE WHEN g.family = 'DNS' THEN 'dns domain' ELSE 'url' END AS how FROM gold g JOIN ranked r ON g.vendor_id = r.vendor_id AND finding_id % 70 = item_key % 70 AND (g.family = 'DNS') = (r.family = 'DNS')
)"""


@query(_MET + "SELECT g.finding_id, count(m.item_key) AS n_captures, min(how) AS basis FROM gold g LEFT JOIN met m ON g.finding_id = m.finding_id GROUP BY 1")
def gold_captures(spark, sf_dir):
    return gold.captured(_gold(spark, sf_dir), _placed(spark, sf_dir).withColumnRenamed("item_key", "capture_id"))


_ANSWERED = _MET + """, o AS (SELECT *, CASE WHEN said <> 'short' AND item_key % 3 = 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS overlap FROM met),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY overlap < 90, NOT citable, overlap DESC, s_rank, item_key) AS n FROM o) WHERE n = 1),
answers AS (SELECT g.finding_id, g.expect, b.item_key, b.overlap, CASE WHEN b.overlap >= 90 THEN 'excerpt' WHEN b.overlap IS NOT NULL THEN 'url' END AS basis, b.strength, b.ai_type = 'not_ai' AS trap FROM gold g LEFT JOIN best b ON g.finding_id = b.finding_id)
"""


@query(_ANSWERED + "SELECT finding_id, item_key, overlap, basis, strength, trap FROM answers")
def gold_answers(spark, sf_dir):
    return gold.answered(_gold(spark, sf_dir), _placed(spark, sf_dir))


_AGREED = _ANSWERED + """, agreed AS (SELECT finding_id, CASE WHEN trap THEN 'trap' ELSE strength END AS label, CASE WHEN trap THEN NULL WHEN expect = 'strong' THEN strength IN ('Strong', 'Moderate') WHEN expect = 'weak' THEN strength IN ('Weak', 'Marketing only', 'Negative')
  ELSE strength IN ('Context - relationship only') END AS agree FROM answers)
"""


@query(_AGREED + "SELECT finding_id, label, agree FROM agreed")
def gold_strengths(spark, sf_dir):
    rows = _gold(spark, sf_dir)
    return gold.strength_agreement(rows, gold.answered(rows, _placed(spark, sf_dir), carry=["expect"]), _EXPECTED)


@query(_AGREED + """, c AS (SELECT g.finding_id, count(m.item_key) AS n FROM gold g LEFT JOIN met m ON g.finding_id = m.finding_id GROUP BY 1)
SELECT 'url recall' AS section, unnest(['findings', 'captured', 'percent']) AS metric, unnest([count(*)::DOUBLE, count(*) FILTER (WHERE n > 0)::DOUBLE, round(100.0 * count(*) FILTER (WHERE n > 0) / count(*), 1)::DOUBLE]) AS value FROM c
UNION ALL SELECT 'passage recall', unnest(['findings', 'by_excerpt', 'without_item', 'percent']), unnest([count(*)::DOUBLE, count(*) FILTER (WHERE basis = 'excerpt')::DOUBLE, count(*) FILTER (WHERE item_key IS NULL)::DOUBLE, round(100.0 * count(*) FILTER (WHERE basis = 'excerpt') / count(*), 1)::DOUBLE]) FROM answers
UNION ALL SELECT 'strength', unnest(['judged', 'agreeing', 'traps']), unnest([count(agree)::DOUBLE, count(*) FILTER (WHERE agree)::DOUBLE, count(*) FILTER (WHERE label = 'trap')::DOUBLE]) FROM agreed
""")
def gold_report(spark, sf_dir):
    rows, own = _gold(spark, sf_dir), _placed(spark, sf_dir)
    answers = gold.answered(rows, own, carry=["expect"])
    return gold.report(rows, gold.captured(rows, own.withColumnRenamed("item_key", "capture_id")), answers, gold.strength_agreement(rows, answers, _EXPECTED))


@query(f"""
SELECT finding_id, concat_ws(',', CASE WHEN finding_id % 7 = 0 THEN 'no vendor_id' END, CASE WHEN finding_id % 5 = 0 THEN 'no url' END, CASE WHEN expect = 'none' THEN 'unknown expect' END) AS problems FROM ({_GOLD}) g WHERE finding_id % 7 = 0 OR finding_id % 5 = 0 OR expect = 'none'
""")
def gold_problems(spark, sf_dir):
    n = F.col("finding_id")
    rows = _gold(spark, sf_dir).withColumns({"vendor_id": F.when(n % 7 > 0, F.concat(F.lit("v"), "vendor_id")), "url": F.when(n % 5 > 0, F.col("url")).otherwise("  ")})
    return gold.problems(rows, ["strong", "weak"]).select("finding_id", F.array_join("problems", ",").alias("problems"))


@query(f"WITH a AS ({evidence._SPANS['orders']}), b AS ({evidence._SPANS['customer']}) SELECT id, doc_id, start, end_at AS \"end\" FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.doc_id = b.doc_id AND a.start < b.end_at AND b.start < a.end_at)")
def spans_in_passages(spark, sf_dir):
    return gold.inside_passages(evidence._spans(spark, sf_dir, "orders"), evidence._spans(spark, sf_dir, "customer"))


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND toxic = 0)")
def documents_without_passages(spark, sf_dir):
    return gold.without_passages(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").where("toxic = 0"))


@query("""
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'h' || (o_custkey % 9) || '.org' ELSE '' END AS asked, 'shop' || (o_custkey % 9) || '.com' AS domain,
  CASE WHEN o_orderkey % 5 = 0 THEN 'pdf' WHEN o_orderkey % 7 = 0 THEN 'json' WHEN o_orderkey % 2 = 0 THEN 'html' ELSE 'text' END AS kind FROM orders
""")
def address_rules(spark, sf_dir):
    n, c = F.col("o_orderkey"), F.col("o_custkey") % 9
    asked = F.when(n % 3 == 0, F.concat(F.lit("https://d/q?type=A&name=H"), c, F.lit("%2eOrg."))).otherwise("https://d/q?named=x")
    address = F.when(n % 2 == 0, F.concat(F.lit("https://user@WWW.shop"), c, F.lit(".com:8080/a?b#c"))).otherwise(F.concat(F.lit(" Shop"), c, F.lit(".com. ")))
    kind = E.document_kind(F.when(n % 7 == 0, "application/JSON"), F.when(n % 5 == 0, "http://h/x.PDF?y=1").otherwise("http://h/"), F.when(n % 2 == 0, "<!DOCTYPE html><HTML>").otherwise("plain"))
    return read(spark, sf_dir, "orders").select(n.alias("k"), E.dns_name(asked).alias("asked"), E.bare_domain(address).alias("domain"), kind.alias("kind"))


@query("""
SELECT o_orderkey AS k, sha256('m' || (o_custkey % 3) || '|p|s|' || o_orderkey || '|7') AS cache_key, 'A-' || strftime(o_orderdate, '%Y%m%d') || '-' || substr(sha256(o_custkey || '|' || o_orderstatus), 1, 8) AS run_id,
  greatest(CASE WHEN o_custkey % 4 > 0 THEN 1.0::DOUBLE / (o_custkey % 4) ELSE 0 END, CASE WHEN o_orderkey % 2 = 0 THEN 0.4::DOUBLE ELSE 0 END) AS gap, CASE WHEN o_custkey % 5 = 0 THEN 0 WHEN o_orderkey % 6 = 0 THEN 3 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS turn FROM orders
""")
def hash_rules(spark, sf_dir):
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    gap = E.request_gap((c % 4).cast("double"), F.when(n % 2 == 0, 0.4))
    turn = E.collector_rank(c % 5 == 0, F.when(n % 6 == 0, "HIST").otherwise("PRD"), n % 2 == 0)
    key = E.cache_key(F.concat(F.lit("m"), c % 3), F.lit("p"), F.lit("s"), n, F.lit(7))
    return read(spark, sf_dir, "orders").select(n.alias("k"), key.alias("cache_key"), E.run_id(F.lit("A"), F.to_date("o_orderdate"), c, F.col("o_orderstatus")).alias("run_id"), gap.alias("gap"), turn.alias("turn"))


@query("""
SELECT o_orderkey AS k, CASE WHEN length(o_orderpriority) <= 8 THEN o_orderpriority WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'longer' || chr(8230) END AS fit, CASE WHEN o_orderkey % 3 = 0 THEN 't2' ELSE '' END AS missing, CASE WHEN o_custkey % 2 = 0 THEN 'x9' ELSE '' END AS unknown,
  CASE WHEN o_orderkey % 3 = 1 THEN 'sp' ELSE '' END AS disagree, CASE WHEN o_orderkey % 2 = 0 THEN 'M2:' || substr(o_orderpriority, 3, 2) ELSE '' END AS recut FROM orders
""")
def key_rules(spark, sf_dir):
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    fit = E.first_fit(F.array(F.col("o_orderpriority"), F.when(n % 2 == 0, F.col("o_orderstatus")).otherwise("longer words")), 8)
    keys = F.array_compact(F.array(F.lit("t1"), F.when(n % 3 > 0, "t2"), F.when(c % 2 == 0, "x9")))
    other = F.create_map(F.lit("sp"), n % 3, F.lit("u"), F.lit(1).cast("long"))
    apart = E.disagreements(F.create_map(F.lit("sp"), F.when(n % 3 == 1, 9).otherwise(n % 3), F.lit("rl"), F.lit(2).cast("long")), other, ["rl", "sp", "u"])
    spans = F.array(F.struct(F.lit("G1").alias("code"), F.lit(0).alias("start"), F.lit(3).alias("end")), F.struct(F.lit("M2").alias("code"), F.lit(2).alias("start"), F.lit(4).alias("end")))
    again = E.recut(spans, F.when(n % 2 == 0, 1).otherwise(3), F.lit(4), F.col("o_orderpriority"))
    odd = E.key_problems(keys, ["t1", "t2"])
    return read(spark, sf_dir, "orders").select(
        n.alias("k"), fit.alias("fit"), F.array_join(odd["missing"], ",").alias("missing"), F.array_join(odd["unknown"], ",").alias("unknown"), F.array_join(apart, ",").alias("disagree"),
        F.array_join(F.transform(again, lambda s: F.concat(s["code"], F.lit(":"), s["span"])), ",").alias("recut"),
    )


@query("""
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'date' WHEN o_orderkey % 7 = 0 THEN 'recorded_at' WHEN o_custkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'key' WHEN o_custkey % 2 = 0 AND o_orderkey % 11 = 0 THEN 'value' END AS problem FROM orders
""")
def review_rules(spark, sf_dir):
    n = F.col("o_orderkey")
    problem = E.review_problem(
        F.when(n % 5 > 0, "2024-02-29").when(n % 10 == 0, "2023-02-29").otherwise("29.02.2024"), F.when(n % 7 > 0, "2024-02-29T10:00:00Z").when(n % 2 == 0, "2024-02-29T10:00:00+02:00").otherwise("soon"),
        F.when(F.col("o_custkey") % 2 == 0, "tier_override").otherwise("note"), F.when(n % 3 == 0, "other").otherwise("tier"), F.when(n % 11 == 0, "Huge").otherwise("High"), ["Low", "Medium", "High", "Critical"],
    )
    return read(spark, sf_dir, "orders").select(n.alias("k"), problem.alias("problem"))


@query("""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages)
SELECT page_id, CASE WHEN ends_with(host, '.tionsh.example.net') OR host = 'tionsh.example.net' THEN 'Tionsh' WHEN ends_with(host, '.example.net') THEN 'Net' WHEN ends_with(host, '.org') THEN 'Org' ELSE regexp_replace(host, '^www[.]', '') END AS publisher FROM p
""")
def publisher_names(spark, sf_dir):
    named = spark.createDataFrame([("org", "Org"), ("example.net", "Net"), ("tionsh.example.net", "Tionsh")], "domain string, publisher string")
    return runs.publishers(read(spark, sf_dir, "pages").select("page_id", E.host(F.col("url")).alias("host")), named).select("page_id", "publisher")


@query(f"""
WITH i AS ({ITEMS}), g AS (SELECT item_key % 500 AS k, 0 AS of_group, u FROM i WHERE sr = 'A' UNION ALL SELECT item_key % 500, 1, u FROM i WHERE sr = 'B' UNION ALL SELECT item_key % 500, 2, u FROM i WHERE u = 8)
SELECT k, of_group, u FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY of_group, u) AS n FROM g) WHERE n = 1
""")
def ordered_groups(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("k", F.col("item_key") % 500)
    return runs.ordered_union([rows.where(c).select("k", "u") for c in ("sr = 'A'", "sr = 'B'", "u = 8")], "k")


@query("SELECT DISTINCT o_custkey % 3000 AS c_custkey FROM orders WHERE o_custkey % 3000 NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 > 0)")
def unknown_vendors(spark, sf_dir):
    asked = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 3000).alias("c_custkey"))
    return runs.unknown(asked, read(spark, sf_dir, "customer").where("c_custkey % 9 > 0"), "c_custkey")


@query("""
SELECT c_custkey AS reply_id, CASE c_custkey % 6 WHEN 0 THEN 'no json' WHEN 1 THEN 'no object' WHEN 2 THEN 'claims' WHEN 3 THEN 'note' END AS problem FROM customer
""")
def reply_shapes(spark, sf_dir):
    n = F.col("c_custkey") % 6
    body = F.when(n == 0, "{broken").when(n == 1, "[1]").when(n == 2, '{"claims": {"a": 1}, "note": "x"}').when(n == 3, '{"claims": []}').when(n == 4, '{"claims": [1], "note": ""}').otherwise('{"claims": [], "note": "x", "more": 1}')
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("reply_id"), web.shape_problem(body, {"claims": "array", "note": "string"}).alias("problem"))


@query("""
SELECT o_custkey AS reply_id, count(*) AS claims, count(*) FILTER (WHERE o_orderkey % 3 > 0 AND o_orderkey % 5 > 0) AS valid, CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS providers FROM orders GROUP BY 1
""")
def reply_claims(spark, sf_dir):
    n = F.col("o_orderkey")
    claim = F.struct(F.concat(F.lit("p"), n).alias("passage_id"), F.when(n % 3 > 0, "a quote").otherwise("").alias("quote"), F.when(n % 5 > 0, "use").otherwise("other").alias("claim_kind"), F.array(F.lit(" "), F.lit("https://x.org"), F.when(n % 2 == 0, "Maker").otherwise("WWW.y.org")).alias("named_providers"))
    replies = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("reply_id")).agg(F.to_json(F.struct(F.collect_list(claim).alias("claims"))).alias("body"))
    found = web.typed_claims(replies, ["use", "limit"])
    return found.groupBy("reply_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if("valid").alias("valid"), F.sum(F.size("named_providers")).alias("providers"))


@query("SELECT c_custkey AS key, CAST(unnest([0, 1, 2, 3]) AS INT) AS ordinal, unnest(['name', 'at.tier', 'at.codes.0', 'at.codes.1']) AS path, unnest([c_name, CAST(c_custkey % 4 AS VARCHAR), c_mktsegment, '[]']) AS value FROM customer")
def manifest_leaves(spark, sf_dir):
    body = F.concat(F.lit('{"name": "'), "c_name", F.lit('", "at": {"tier": '), F.col("c_custkey") % 4, F.lit(', "codes": ["'), "c_mktsegment", F.lit('", []]}}'))
    return sinks.manifest_rows(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), body.alias("body")))
