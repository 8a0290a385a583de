"""Queries of tagging, risk inputs, release policy, batches and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.functions import expressions as E
from provenant.operators import decisions, grading, runs, scoring, spans, tagging, verdict
from provenant.plans import evidence
from provenant.plans.tables import ORACLES, COVERAGE, ITEMS, PROFILES, derived, items, query, read

_CUES = {"term": 2, "deployed": 3, "planned": 5, "pilot": 14, "limiting": 22, "governance": 6, "building": 10, "generic": 9, "reviewed": 12, "automated": 4, "advisory": 7, "sdlc": 15, "delivery": 8, "corporate": 21, "addon": 25, "partner": 26, "agentic": 18, "conversational": 20, "document": 35}
_GRID = """SELECT o_orderkey AS k, o_orderkey * 13 + o_custkey * 5 AS m, CASE o_custkey % 5 WHEN 0 THEN 'platform_supplier' WHEN 1 THEN 'affiliate_inferred' WHEN 2 THEN 'other' ELSE 'own' END AS relation,
  o_orderkey % 6 = 0 AS job, o_custkey % 2 = 0 AS product, o_orderkey % 8 = 1 AS commentary, o_orderkey % 3 = 0 AS service FROM orders"""
_FLAGS = ", ".join(f"m % {n} = 0 AS {c}" for c, n in _CUES.items())


@query(f"""
WITH g AS ({_GRID}), c AS (SELECT *, {_FLAGS} FROM g), t AS (
  SELECT *, CASE WHEN commentary THEN 'unclear' WHEN pilot THEN 'pilot_or_beta' WHEN planned AND NOT deployed THEN 'planned' WHEN deployed THEN 'in_production' ELSE 'unclear' END AS temporal,
    CASE WHEN reviewed THEN 'human_reviewed_decision' WHEN automated THEN 'automated_action' WHEN advisory THEN 'advisory' ELSE 'unknown' END AS action,
    CASE WHEN NOT term THEN 'not_ai' WHEN agentic THEN 'agentic' WHEN document THEN 'document_ai' WHEN conversational THEN 'conversational' ELSE 'unspecified' END AS ai_type,
    CASE WHEN relation IN ('platform_supplier', 'affiliate_inferred') THEN relation WHEN commentary THEN 'commentary' WHEN partner AND NOT deployed THEN 'relationship' WHEN sdlc AND (job OR NOT product) THEN 'sdlc'
      WHEN delivery AND (job OR NOT product) THEN 'delivery_ops' WHEN corporate AND (job OR NOT product) THEN 'corporate_internal' WHEN job THEN 'corporate_internal' WHEN addon THEN 'vendor_addon'
      WHEN relation = 'own' THEN 'service_feature' ELSE 'unknown' END AS locus FROM c
), x AS (SELECT *, locus IN ('platform_supplier', 'affiliate_inferred') AS away, CASE WHEN governance THEN 6 WHEN building THEN 5 END AS cap FROM t)
SELECT k, temporal, action, ai_type, locus, CASE WHEN ai_type = 'not_ai' THEN 7 WHEN limiting AND NOT away AND locus NOT IN ('commentary', 'relationship') THEN 8 WHEN locus = 'commentary' THEN 7 WHEN locus = 'relationship' THEN 4
  WHEN job AND NOT away THEN CASE WHEN deployed AND NOT building THEN 3 WHEN governance THEN 6 ELSE 5 END WHEN away THEN CASE WHEN generic THEN 7 ELSE 2 END WHEN generic THEN coalesce(cap, 7)
  WHEN locus = 'service_feature' THEN CASE WHEN service THEN 1 ELSE 2 END WHEN locus = 'vendor_addon' THEN 2
  WHEN locus IN ('delivery_ops', 'sdlc', 'corporate_internal') THEN CASE WHEN temporal = 'unclear' THEN coalesce(cap, 3) ELSE 3 END ELSE coalesce(cap, 7) END AS u FROM x
""")
def tag_classes(spark, sf_dir):
    rows = derived(spark, sf_dir, _GRID)
    rows = rows.withColumns({f"cue_{c}": F.col("m") % n == 0 for c, n in _CUES.items()})
    return tagging.tagged(rows).select("k", "temporal", "action", "ai_type", "locus", "u")


@query()
def passage_cues(spark, sf_dir):
    lexicon = {"term": evidence.TERMS, "deployed": ("thing", "que", "die"), "planned": ("la", "der")}
    found = tagging.cues(spans.passages(read(spark, sf_dir, "documents"), evidence.TERMS), lexicon, ())
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("passages"), F.count_if("cue_deployed").alias("deployed"), F.count_if("cue_planned").alias("planned"))


_RULES = [
    (1, "tionsh.example.net", None, "/de/", "register", "A"), (2, "example.com", None, r"\.html$", "statement", "B"), (3, "example.com", None, None, "site", "B"),
    (4, None, None, "^https:", "secure", "C"), (5, "example.org", None, None, "press", "D"), (6, None, None, "/fr/", "foreign", "E"),
]
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


@query(f"""
WITH d AS (SELECT page_id AS doc_id, url, {_HOST} AS host FROM pages)
SELECT doc_id, CASE WHEN (host = 'tionsh.example.net' OR ends_with(host, '.tionsh.example.net')) AND regexp_matches(url, '/de/') THEN 'register' WHEN ends_with(host, '.example.com') AND regexp_matches(url, '[.]html$') THEN 'statement'
  WHEN ends_with(host, '.example.com') THEN 'site' WHEN regexp_matches(url, '^https:') THEN 'secure' WHEN ends_with(host, '.example.org') THEN 'press' WHEN regexp_matches(url, '/fr/') THEN 'foreign' ELSE 'unknown' END AS source_type,
  CASE WHEN (host = 'tionsh.example.net' OR ends_with(host, '.tionsh.example.net')) AND regexp_matches(url, '/de/') THEN 'A' WHEN ends_with(host, '.example.com') THEN 'B' WHEN regexp_matches(url, '^https:') THEN 'C'
  WHEN ends_with(host, '.example.org') THEN 'D' WHEN regexp_matches(url, '/fr/') THEN 'E' ELSE 'F' END AS sr FROM d
""")
def source_types(spark, sf_dir):
    docs = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), E.host(F.col("url")).alias("host"), "url", F.lit("PRD").alias("family"))
    rules = spark.createDataFrame(_RULES, "ordinal int, domain string, family string, pattern string, source_type string, sr string")
    return tagging.source_types(docs, rules).select("doc_id", "source_type", "sr")


@query(f"""
WITH d AS (SELECT page_id AS doc_id, page_id % 3 AS vendor_id, {_HOST} AS host FROM pages)
SELECT doc_id, CASE WHEN vendor_id = 0 AND ends_with(host, '.example.com') THEN 'own' WHEN vendor_id = 0 AND ends_with(host, '.example.net') THEN 'platform_supplier' WHEN vendor_id = 1 AND ends_with(host, '.example.org') THEN 'own'
  WHEN vendor_id = 1 AND ends_with(host, '.example.com') THEN 'affiliate_inferred' ELSE 'other' END AS relation FROM d
""")
def document_relations(spark, sf_dir):
    docs = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), (F.col("page_id") % 3).alias("vendor_id"), E.host(F.col("url")).alias("host"))
    domains = spark.createDataFrame([(0, "example.com", "own"), (0, "example.net", "platform_supplier"), (1, "example.org", "own"), (1, "example.com", "affiliate_inferred")], "vendor_id long, domain string, relation string")
    return tagging.relations(docs, domains).select("doc_id", "relation")


_PROVIDERS = {"k1": "One", "k2": "Two", "k13": "Thirteen"}


@query("SELECT DISTINCT 'n' || (c_custkey % 200) AS name, 'k' || (c_custkey % 17) AS token, CASE c_custkey % 17 WHEN 1 THEN 'One' WHEN 2 THEN 'Two' ELSE 'Thirteen' END AS provider FROM customer WHERE c_custkey % 17 IN (1, 2, 13)")
def dns_provider_tokens(spark, sf_dir):
    records = read(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_custkey") % 200).alias("name"), F.concat(F.lit("K"), F.col("c_custkey") % 17, F.lit("=abc")).alias("record"))
    return tagging.dns_tokens(records, _PROVIDERS).select("name", "token", "provider")


@query(f"SELECT item_key, concat_ws(',', CASE WHEN ai_type = 'not_ai' THEN 'definition' END, CASE WHEN sr IN ('E', 'F') THEN 'source' END, CASE WHEN locus IN ('platform_supplier', 'affiliate_inferred') THEN 'entity' END) AS traps FROM ({ITEMS})")
def trap_checks(spark, sf_dir):
    return tagging.traps(items(spark, sf_dir)).select("item_key", F.array_join("traps", ",").alias("traps"))


@query(f"""
WITH i AS (SELECT *, item_key // 5 AS passage_id, least(u, 7) - 1 AS s FROM ({ITEMS}))
SELECT passage_id, item_key FROM (SELECT *, row_number() OVER (PARTITION BY passage_id ORDER BY ai_type = 'not_ai', least(s, 3), rl DESC, sp DESC, s, mask % 7 DESC, n_providers DESC, item_key) AS n FROM i) WHERE n = 1
""")
def best_candidates(spark, sf_dir):
    rows = items(spark, sf_dir).withColumns({"passage_id": F.expr("item_key DIV 5"), "strength_rank": F.least("u", F.lit(7)) - 1, "trap": F.col("ai_type") == "not_ai", "n_codes": F.col("mask") % 7, "start": F.col("item_key")})
    return tagging.best_candidate(rows).select("passage_id", "item_key")


def _pathways(spark, sf_dir) -> DataFrame:
    action = F.when(F.col("mask") % 4 == 0, "automated_action").when(F.col("mask") % 4 == 1, "human_reviewed_decision").when(F.col("mask") % 4 == 2, "advisory").otherwise("unknown")
    flags = {"external": 9, "customer_data": 2, "artefacts": 3, "production_data": 5, "target": 8}
    return items(spark, sf_dir).withColumn("action", action).withColumns({c: F.col("mask") % n == 0 for c, n in flags.items()})


_VENDORS = f"""SELECT vendor_id, d AS data_level, d3p AS privileged, p AS process_level, registered AS customer_facing, CASE verdict WHEN 'Affirmed' THEN 'No' WHEN 'Not detected' THEN 'No' ELSE verdict END AS verdict FROM ({PROFILES}) x"""


@query(f"""
WITH v AS (SELECT * FROM ({_VENDORS})), i AS (SELECT * FROM ({ITEMS}) WHERE review <> 'rejected' AND ai_type <> 'not_ai' AND NOT (method = 'llm' AND review = 'pending')), l AS (
  SELECT i.vendor_id, item_key, CASE WHEN locus IN ('service_feature', 'vendor_addon') THEN CASE WHEN data_level >= 4 OR privileged OR mask % 9 = 0 THEN CASE WHEN rl = 3 THEN 3 ELSE 2 END WHEN data_level = 3 THEN 2 ELSE 1 END
    WHEN locus = 'delivery_ops' THEN CASE WHEN mask % 2 = 0 THEN CASE WHEN rl = 3 THEN 3 ELSE 2 END WHEN mask % 3 = 0 THEN 2 ELSE 1 END WHEN locus = 'sdlc' THEN CASE WHEN mask % 5 = 0 THEN 2 ELSE 1 END WHEN locus = 'corporate_internal' THEN 0 END AS e,
    CASE mask % 4 WHEN 0 THEN CASE WHEN mask % 8 = 0 THEN 3 ELSE 2 END WHEN 1 THEN 2 WHEN 2 THEN 1 END AS k FROM i JOIN v ON i.vendor_id = v.vendor_id
), b AS (SELECT vendor_id, max(e) AS e, max(k) AS k FROM l GROUP BY 1), r AS (
  SELECT v.*, b.e AS be, b.k AS bk, CASE WHEN data_level >= 4 OR privileged THEN 3 WHEN data_level = 3 THEN 2 ELSE 1 END AS eg, CASE WHEN process_level >= 3 OR privileged THEN 3 WHEN process_level >= 2 OR customer_facing THEN 2 ELSE 1 END AS kg,
    (SELECT min(item_key) FROM l WHERE l.vendor_id = v.vendor_id AND l.e = b.e) AS e_item, (SELECT min(item_key) FROM l WHERE l.vendor_id = v.vendor_id AND l.k = b.k) AS k_item FROM v LEFT JOIN b ON v.vendor_id = b.vendor_id)
SELECT vendor_id, CASE WHEN verdict = 'No' THEN 0 WHEN verdict = 'Inconclusive' THEN greatest(coalesce(be, 0), eg) ELSE coalesce(be, eg) END AS e,
  CASE WHEN verdict = 'No' THEN 0 WHEN verdict = 'Inconclusive' THEN greatest(coalesce(bk, 0), kg) ELSE coalesce(bk, kg) END AS k, e_item, k_item FROM r
""")
def risk_inputs(spark, sf_dir):
    vendors = derived(spark, sf_dir, _VENDORS)
    return decisions.risk_inputs(_pathways(spark, sf_dir), vendors)


@query(f"""
WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages), s AS (SELECT {_HOST} AS host, NOT bool_or(page_id % 4 = 0) AS ok FROM pages WHERE {_HOST} LIKE '%.org' GROUP BY 1)
SELECT h.host, CASE WHEN ends_with(h.host, 'example.com') THEN false WHEN h.host LIKE 'm.%.example.net' THEN coalesce(s.ok, true) ELSE coalesce(s.ok, true) END AS allowed,
  CASE WHEN ends_with(h.host, 'example.com') THEN 'register' WHEN s.ok IS NOT NULL THEN 'directive' ELSE 'default' END AS basis FROM h LEFT JOIN s ON h.host = s.host
""")
def host_policy(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select(E.host(F.col("url")).alias("host"), (F.col("page_id") % 4 == 0).alias("refuses"))
    register = spark.createDataFrame([("example.com", False)], "domain string, allowed boolean")
    return decisions.host_policy(pages.select("host").distinct(), register, pages.where(F.col("host").endswith(".org")))


@query(f"""
WITH RECURSIVE i AS (SELECT vendor_id, item_key, 100 + mask % 900 AS size, row_number() OVER (PARTITION BY vendor_id ORDER BY item_key) AS p FROM ({ITEMS})),
r AS (SELECT vendor_id, item_key, p, 0 AS batch, 1 AS n, size AS chars FROM i WHERE p = 1
  UNION ALL SELECT i.vendor_id, i.item_key, i.p, CASE WHEN r.n >= 12 OR r.chars + i.size > 5000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.n >= 12 OR r.chars + i.size > 5000 THEN 1 ELSE r.n + 1 END,
    CASE WHEN r.n >= 12 OR r.chars + i.size > 5000 THEN i.size ELSE r.chars + i.size END FROM r JOIN i ON i.vendor_id = r.vendor_id AND i.p = r.p + 1)
SELECT vendor_id, item_key, batch FROM r
""")
def budgeted_batches(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("size", 100 + F.col("mask") % 900)
    return decisions.batches(rows, "vendor_id", [F.col("item_key")], 12, 5000)


@query(f"""
WITH v AS ({ORACLES['vendor_verdicts']}), d AS (WITH {evidence._COMPLETE} SELECT * FROM done), n AS ({evidence._GRADED} SELECT vendor_id, count(*) FILTER (WHERE is_q) AS q, count(*) FILTER (WHERE is_k AND NOT is_q) AS k FROM ranked GROUP BY 1),
t AS (SELECT v.vendor_id, verdict || ': AI use is ' || likelihood || ' (' || lower(confidence) || ' confidence), from ' || CASE WHEN q + k = 0 THEN 'no qualifying evidence' ELSE q || ' qualifying and ' || k || ' corroborating items' END || '. ' ||
  CASE WHEN missing = '' THEN 'Coverage is complete.' ELSE 'Not covered: ' || replace(missing, ',', ', ') || '.' END AS whole FROM v JOIN d ON v.vendor_id = d.vendor_id JOIN n ON v.vendor_id = n.vendor_id)
SELECT vendor_id, CASE WHEN length(whole) <= 200 THEN whole ELSE regexp_replace(substr(whole, 1, 199), '\\s+\\S*$', '') || '…' END AS usage FROM t
""")
def usage_cells(spark, sf_dir):
    done = runs.complete(evidence._plan(spark, sf_dir), runs.family_status(derived(spark, sf_dir, COVERAGE)))
    rows = items(spark, sf_dir)
    n = rows.groupBy("vendor_id").agg(F.count_if(grading.qualifying()).alias("n_q"), F.count_if(grading.corroborating() & ~grading.qualifying()).alias("n_k"))
    found = verdict.verdicts(rows, done.drop("missing")).join(done, "vendor_id").join(n, "vendor_id")
    return found.select("vendor_id", decisions.usage_text(200).alias("usage"))


@query("""
WITH c AS (SELECT c_custkey AS vendor_id, x AS "column", c_mktsegment AS value FROM customer, (VALUES ('P'), ('Q')) v(x)), e AS (SELECT o_custkey AS vendor_id, CASE WHEN o_orderkey % 2 = 0 THEN 'P' ELSE 'Z' END AS "column", arg_max('e' || o_orderkey, o_orderkey) AS edit FROM orders GROUP BY 1, 2)
SELECT c.vendor_id, c."column", coalesce(edit, value) AS value, edit IS NOT NULL AS edited FROM c LEFT JOIN e ON c.vendor_id = e.vendor_id AND c."column" = e."column"
""")
def cell_edits(spark, sf_dir):
    cells = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vendor_id"), F.explode(F.array(F.lit("P"), F.lit("Q"))).alias("column"), F.col("c_mktsegment").alias("value"))
    edits = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("vendor_id"), F.when(F.col("o_orderkey") % 2 == 0, "P").otherwise("Z").alias("column"), F.concat(F.lit("e"), "o_orderkey").alias("value"), F.col("o_orderkey").alias("seq"))
    return decisions.edited(cells, edits)


@query("SELECT c_custkey AS vendor_id, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS value, CASE WHEN c_acctbal < 0 THEN 'negative balance' END AS error FROM customer")
def isolated_failures(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vendor_id"), F.col("c_mktsegment").alias("value"), "c_acctbal")
    return decisions.isolated(rows, F.when(F.col("c_acctbal") < 0, "negative balance"), "value").select("vendor_id", "value", "error")


@query("""
WITH RECURSIVE p AS (SELECT o_custkey AS k, o_orderkey % 7 AS place, o_orderkey, o_orderpriority || o_orderstatus AS body, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3, o_orderkey % 7, o_orderkey) AS n FROM orders),
f AS (SELECT k, n, length(body) AS used, CASE WHEN length(body) <= 40 THEN [{'place': place, 'n': n, 'body': body}] ELSE [] END AS kept FROM p WHERE n = 1
  UNION ALL SELECT p.k, p.n, CASE WHEN used + 1 + length(body) <= 40 THEN used + 1 + length(body) ELSE used END, CASE WHEN used + 1 + length(body) <= 40 THEN list_append(kept, {'place': p.place, 'n': p.n, 'body': body}) ELSE kept END FROM f JOIN p ON f.k = p.k AND p.n = f.n + 1)
SELECT k, array_to_string(list_transform(list_sort(arg_max(kept, n)), lambda x: x.body), ' ') AS fit FROM f GROUP BY k
""")
def fitted_parts(spark, sf_dir):
    part = F.struct((F.col("o_orderkey") % 3).alias("rank"), F.struct((F.col("o_orderkey") % 7).alias("at"), "o_orderkey").alias("place"), F.concat("o_orderpriority", "o_orderstatus").alias("body"))
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list(part).alias("parts"))
    by_rank = rows.withColumn("parts", F.array_sort("parts"))
    placed = F.transform("parts", lambda x, i: F.struct(x["rank"].alias("rank"), F.struct(x["place"]["at"].alias("at"), i.alias("turn")).alias("place"), x["body"].alias("body")))
    return by_rank.select("k", decisions.fitted(placed, 40).alias("fit"))


@query(f"""
WITH p AS (SELECT *, 7 * o + 6 * d + 5 * p + 4 * r + 3 * v AS score FROM ({PROFILES}) x), t AS (SELECT *, ['Low', 'Medium', 'High', 'Critical'][1 + {evidence._BASE_TIER}] AS tier FROM p),
w AS (SELECT vendor_id, tier || ' criticality (' || score || ' of 100)' AS head, ': operations ' || o || ', data ' || d || ', process ' || p || ', regulation ' || r || ', volume ' || v || '.' AS rest FROM t)
SELECT vendor_id, CASE WHEN length(head || rest) <= 98 THEN head || rest ELSE head || '.' END AS criticality FROM w
""")
def criticality_cells(spark, sf_dir):
    return scoring.criticality(derived(spark, sf_dir, PROFILES)).select("vendor_id", decisions.criticality_text(98).alias("criticality"))


@query(f"""
WITH j AS ({ORACLES['depth_plan']}), a AS (SELECT vendor_id, coalesce(string_agg(family || ' ' || cap, ', ' ORDER BY family || ' ' || cap) FILTER (WHERE mandatory AND cap IS NOT NULL), '') AS must,
  coalesce(string_agg(family || ' ' || cap, ', ' ORDER BY family || ' ' || cap) FILTER (WHERE NOT mandatory AND cap IS NOT NULL), '') AS may, coalesce(string_agg(family, ', ' ORDER BY family) FILTER (WHERE not_applicable), '') AS no FROM j GROUP BY 1)
SELECT vendor_id, concat_ws(' ', CASE WHEN must <> '' THEN 'Search ' || must || '.' END, CASE WHEN may <> '' THEN 'Optional: ' || may || '.' END, CASE WHEN no <> '' THEN 'Not applicable: ' || no || '.' END) AS depth FROM a
""")
def depth_cells(spark, sf_dir):
    return decisions.depth_text(scoring.depth_plan(scoring.criticality(derived(spark, sf_dir, PROFILES))))


@query(f"""
WITH r AS ({ORACLES['risk_steps']}) SELECT vendor_id, risk_class || ' risk, ' || arp || ' points' || CASE WHEN risk_class <> before_cap THEN ' (held from ' || before_cap || ')' ELSE '' END || '; at most ' || ceiling || '. ' ||
  CASE WHEN flips = '' THEN 'Nothing found would raise it.' ELSE 'Raised by: ' || replace(flips, ',', ', ') || '.' END AS risk FROM r
""")
def risk_cells(spark, sf_dir):
    return scoring.risk(evidence._risk_rows(spark, sf_dir)).select("vendor_id", decisions.risk_text().alias("risk"))


@query(f"""
WITH a AS ({ORACLES['action_plans']}) SELECT vendor_id, 'Follow the ' || playbook || ' playbook' || CASE WHEN deadline_days IS NOT NULL THEN ' within ' || deadline_days || ' business days' ELSE '' END || '.' ||
  CASE vendor_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' Ask about GOV.' WHEN 2 THEN ' Ask about GOV and INC.' ELSE ' Ask about GOV, INC, and SUB.' END AS action FROM a
""")
def action_cells(spark, sf_dir):
    rows = scoring.criticality(evidence._risk_rows(spark, sf_dir))
    plans = scoring.actions(scoring.risk(rows).join(rows.select("vendor_id", "tier", "verdict"), "vendor_id"))
    gaps = F.slice(F.array(F.lit("GOV"), F.lit("INC"), F.lit("SUB")), F.lit(1), (F.col("vendor_id") % 4).cast("int"))
    return plans.withColumn("gaps", gaps).select("vendor_id", decisions.action_text().alias("action"))
