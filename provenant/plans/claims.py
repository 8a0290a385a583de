"""Queries from text to graded items, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.functions import expressions as E
from provenant.operators import claims, grading, tagging, verify
from provenant.plans import evidence
from provenant.plans.tables import ITEMS, PROFILES, derived, items, query, read

_CUES = {"data_use": 2, "boilerplate": 7, "oversight": 3, "governance": 5, "notification": 11, "training": 4, "no_training": 8, "privileged": 13, "production": 6, "credit": 9, "incident": 10, "register": 12, "region": 14}
_CUE_SQL = ", ".join(f"mask % {n} = 0 AS cue_{c}" for c, n in _CUES.items())
_ACTION = "CASE mask % 4 WHEN 0 THEN 'automated_action' WHEN 1 THEN 'human_reviewed_decision' WHEN 2 THEN 'advisory' ELSE 'unknown' END"
_SAID = evidence._GRADED + f""", said AS (SELECT *, {_CUE_SQL}, {_ACTION} AS action, CAST(mask % 4 AS INT) AS k_level, mask % 3 = 0 AS g2, mask % 5 = 0 AS g3, mask % 13 = 0 AS m3,
  locus NOT IN ('platform_supplier', 'affiliate_inferred', 'commentary') AS near, locus NOT IN ('platform_supplier', 'affiliate_inferred', 'commentary') AND family NOT IN ('DNS', 'IND') AND sr IN ('A', 'B', 'C') AS own FROM ranked)
"""


def _said(spark, sf_dir):
    action = F.when(F.col("mask") % 4 == 0, "automated_action").when(F.col("mask") % 4 == 1, "human_reviewed_decision").when(F.col("mask") % 4 == 2, "advisory").otherwise("unknown")
    flags = {f"cue_{c}": F.col("mask") % n == 0 for c, n in _CUES.items()}
    return items(spark, sf_dir).withColumns(flags | {"action": action, "k": (F.col("mask") % 4).cast("int")})


_CHECKS = _SAID + """, checks AS (
  SELECT vendor_id, bool_or(citable AND own AND sr IN ('A', 'B') AND rl = 3 AND u <= 4) AS t1, bool_or(citable AND own AND u <> 8 AND n_providers > 0) AS t2,
    bool_or(citable AND own AND u <> 7 AND family = 'LEG' AND g3 AND cue_data_use) AS t3, bool_or(citable AND own AND u <> 7 AND family <> 'JOB' AND NOT cue_boilerplate AND (action = 'human_reviewed_decision' OR cue_oversight)) AS t4,
    bool_or(citable AND own AND u <> 7 AND family <> 'JOB' AND NOT cue_boilerplate AND cue_governance) AS t5, bool_or(citable AND own AND u <> 7 AND family <> 'JOB' AND NOT cue_boilerplate AND cue_notification) AS t6
  FROM said GROUP BY 1
), m AS (SELECT *, 6 - (t1::INT + t2::INT + t3::INT + t4::INT + t5::INT + t6::INT) AS missing FROM checks)
"""


@query(_CHECKS + "SELECT *, CASE WHEN missing <= 1 THEN 0 WHEN missing <= 3 THEN 1 WHEN missing <= 5 THEN 2 ELSE 3 END AS tg FROM m")
def transparency_checks(spark, sf_dir):
    return claims.transparency(_said(spark, sf_dir))


_RATED = "SELECT c_custkey AS vendor_id, CAST(c_custkey % 4 AS INT) AS e, c_custkey % 7 = 0 AS e_assumed, CAST((c_custkey // 2) % 4 AS INT) AS k, c_custkey % 5 = 0 AS k_assumed, c_custkey % 3 = 0 AS privileged, CASE WHEN c_custkey % 2 = 0 THEN 'Critical' ELSE 'High' END AS tier FROM customer"
_NAMES = "SELECT o_custkey % 40 AS vendor_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Maker' ELSE 'MAKER' END || ((o_orderkey * 7 + o_custkey) % 60) AS provider, (o_orderkey + o_custkey) % 97 = 0 AS foundation, o_orderkey % 3 = 0 AS third_party FROM orders"


@query(_SAID + f""", v AS (SELECT * FROM ({_RATED}) WHERE vendor_id < 40), n AS ({_NAMES}), f AS (
  SELECT said.vendor_id, bool_or(citable AND near AND u <> 8 AND cue_training AND NOT cue_no_training) AS trains,
    bool_or(citable AND (is_q OR is_k) AND action = 'automated_action' AND (ai_type = 'agentic' OR privileged OR cue_privileged) AND cue_production) AS acts, bool_or(citable AND (is_q OR is_k) AND k_level = 3 AND cue_credit) AS credit,
    bool_or(citable AND near AND u <> 8 AND NOT m3 AND cue_incident AND 12 * (2000 - year(published)) + 6 - month(published) - CASE WHEN day(published) > 15 THEN 1 ELSE 0 END <= 24) AS incident
  FROM said JOIN v ON said.vendor_id = v.vendor_id GROUP BY 1
), apart AS (SELECT DISTINCT vendor_id FROM n t WHERE third_party AND NOT EXISTS (SELECT 1 FROM n o WHERE o.vendor_id = t.vendor_id AND NOT o.third_party AND lower(o.provider) = lower(t.provider))),
makers AS (SELECT vendor_id, count(DISTINCT lower(provider)) AS m FROM n WHERE foundation AND NOT third_party GROUP BY 1)
SELECT v.vendor_id, e >= 2 AND NOT e_assumed AND a.vendor_id IS NOT NULL AS x1, e >= 2 AND NOT e_assumed AND coalesce(trains, false) AS x2, coalesce(acts, false) AS x3, k >= 3 AND NOT k_assumed AND coalesce(credit, false) AS x4,
  coalesce(incident, false) AS x5, tier = 'Critical' AND coalesce(m, 0) = 1 AS x6
FROM v LEFT JOIN f ON v.vendor_id = f.vendor_id LEFT JOIN apart a ON v.vendor_id = a.vendor_id LEFT JOIN makers ON v.vendor_id = makers.vendor_id
""")
def risk_escalators(spark, sf_dir):
    vendors = derived(spark, sf_dir, _RATED).where("vendor_id < 40")
    return claims.escalators(_said(spark, sf_dir), derived(spark, sf_dir, _NAMES), vendors, F.lit("2000-06-15").cast("date"))


_USAGE = f"SELECT vendor_id, CASE verdict WHEN 'Affirmed' THEN 'No' WHEN 'Not detected' THEN 'No' WHEN 'Inconclusive' THEN 'Inconclusive' ELSE 'Yes' END AS usage, CASE WHEN missing = 7 THEN 'None identified' ELSE 'High' END AS risk_class, k FROM ({PROFILES}) x"


@query(_SAID + f""", w AS (SELECT s.*, coalesce(usage, 'Inconclusive') AS usage, row_number() OVER (PARTITION BY s.vendor_id ORDER BY NOT (citable AND (is_q OR is_k) AND u <> 8), {evidence._BEST_FIRST}) AS nth FROM said s LEFT JOIN ({_USAGE}) v ON s.vendor_id = v.vendor_id)
SELECT item_key, CASE WHEN NOT citable THEN 'Logged' WHEN u = 8 THEN 'Negative' WHEN usage = 'Yes' AND (is_q OR is_k) THEN CASE WHEN nth = 1 THEN 'Primary' ELSE 'Supporting' END
  WHEN usage <> 'Yes' AND blocks THEN CASE WHEN usage = 'No' THEN 'Counter-evidence' ELSE 'Indicator' END WHEN strength LIKE 'Context%' THEN 'Context' ELSE 'Logged' END AS role FROM w
""")
def evidence_roles(spark, sf_dir):
    return claims.roles(items(spark, sf_dir), derived(spark, sf_dir, _USAGE)).select("item_key", "role")


@query(_CHECKS + f""", flags AS (SELECT vendor_id, bool_or(citable AND family = 'LEG' AND cue_register) AS register, bool_or(citable AND cue_region) AS region, bool_or(citable AND u <> 8 AND (ai_type = 'agentic' OR action = 'automated_action')) AS agent,
  bool_or(citable AND u <> 8 AND ai_type IN ('genai_llm', 'conversational')) AS talks, bool_or(citable AND u <> 8 AND ai_type = 'predictive_ml') AS predicts, count(DISTINCT CASE WHEN citable AND u <> 8 AND n_providers > 0 THEN n_providers END) AS named FROM said GROUP BY 1)
SELECT m.vendor_id, CASE WHEN risk_class = 'None identified' OR usage = 'No' THEN '' ELSE concat_ws(',', CASE WHEN NOT t2 OR NOT register THEN 'SUB' END, CASE WHEN NOT t3 THEN 'TRAIN' END, CASE WHEN NOT region THEN 'LOC' END, CASE WHEN NOT t4 THEN 'EXPL' END,
  CASE WHEN agent THEN 'AGENT' END, CASE WHEN talks THEN 'PI' END, CASE WHEN NOT t5 THEN 'GOV' END, CASE WHEN NOT t6 THEN 'INC' END, CASE WHEN m.vendor_id % 3 = 0 OR named = 1 THEN 'CONC' END, CASE WHEN k >= 2 AND predicts THEN 'MRM' END) END AS gaps
FROM m JOIN ({_USAGE}) v ON m.vendor_id = v.vendor_id JOIN flags g ON m.vendor_id = g.vendor_id
""")
def open_gaps(spark, sf_dir):
    rows = _said(spark, sf_dir)
    vendors = claims.transparency(rows).join(derived(spark, sf_dir, _USAGE), "vendor_id").withColumn("x6", F.col("vendor_id") % 3 == 0)
    return claims.gap_blocks(vendors, rows).select("vendor_id", F.array_join("gaps", ",").alias("gaps"))


@query(f"WITH i AS (SELECT *, mask % 6 AS level FROM ({ITEMS})), t AS (SELECT vendor_id, max(level) AS top FROM i GROUP BY 1) SELECT i.vendor_id, item_key, level FROM i JOIN t ON i.vendor_id = t.vendor_id AND level = top")
def top_level_items(spark, sf_dir):
    return claims.reaching(items(spark, sf_dir).withColumn("level", F.col("mask") % 6), "level")


_LEXICON = {"G2": ("the", "die"), "M1": ("menteas", "que"), "M4": ("und",)}


@query(r"""
WITH w AS (SELECT doc_id, list_transform(string_split_regex(text, '[^\p{L}\p{N}_-]+'), lambda x: x) AS w FROM documents), s AS (
  SELECT doc_id, list_filter(w, lambda x: lower(x) IN ('the', 'die')) AS g2, list_filter(w, lambda x: lower(x) IN ('menteas', 'que')) AS m1,
    CASE WHEN len(list_filter(w, lambda x: lower(x) = 'ist')) = 0 THEN list_filter(w, lambda x: lower(x) = 'und') ELSE [] END AS m4, list_filter(w, lambda x: lower(x) = 'of') AS terms FROM w)
SELECT doc_id, CAST(len(list_distinct(g2)) AS INT) AS g2, CAST(len(list_distinct(m1)) AS INT) AS m1, CAST(len(list_distinct(m4)) AS INT) AS m4, CASE WHEN doc_id % 3 = 0 THEN terms[1] END AS legal_span FROM s
""")
def lexical_indicators(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = docs.select("doc_id", claims.indicators(F.col("text"), _LEXICON, F.col("doc_id") % 3 == 0, F.lit(False), ("of",), ("ist",)).alias("found"))
    many = lambda code: F.size(F.filter("found", lambda x: x["code"] == code))
    legal = F.get(F.filter("found", lambda x: x["code"] == "G6"), F.lit(0))["span"]
    return found.select("doc_id", many("G2").alias("g2"), many("M1").alias("m1"), many("M4").alias("m4"), legal.alias("legal_span"))


_SERVES = """
SELECT c_custkey AS vendor_id, CASE c_custkey % 6 WHEN 0 THEN 'We serve ' || (c_custkey * 37) || ' retail customers and keep ' || (c_custkey % 90) || ' thousand records per month.' WHEN 1 THEN 'About ' || (c_custkey % 9) || '.5 million new card customers a year'
  WHEN 2 THEN 'Runs 40 times daily customers' WHEN 3 THEN 'Not applicable' WHEN 4 THEN 'Holds ' || (c_custkey % 50) || ',000 records, and the entire customer base' ELSE 'Has 12 clients and 2m transactions per week' END AS text FROM customer
"""


@query(f"""
WITH s AS ({_SERVES}), n AS (SELECT *, c.vendor_id * 37 AS served, (c.vendor_id % 90) * 1000 * 12 AS kept, (c.vendor_id % 9 + 0.5) * 1000000 AS cards, (c.vendor_id % 50) * 1000 AS held FROM s c)
SELECT vendor_id, CASE vendor_id % 6 WHEN 0 THEN CASE WHEN served >= 1 THEN greatest(1 + (served >= 10000)::INT + (served >= 100000)::INT + (served >= 1000000)::INT, (kept >= 1)::INT + (kept >= 100000)::INT + (kept >= 1000000)::INT) ELSE (kept >= 1)::INT + (kept >= 100000)::INT + (kept >= 1000000)::INT END
  WHEN 1 THEN 3 + (cards >= 1000000)::INT WHEN 4 THEN 4 WHEN 5 THEN 4 ELSE 0 END AS level FROM n
""")
def service_volumes(spark, sf_dir):
    level = claims.volume(F.col("text"), ("customers", "customer", "clients "), ("records", "transactions"), r"(?i)entire customer base", r"(?i)not applicable|no customer data")
    return derived(spark, sf_dir, _SERVES).select("vendor_id", level.alias("level"))


_FACTS = "SELECT c_custkey AS vendor_id, CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'Runs payments. Holds account data.' WHEN 2 THEN 'We do not hold account data.' WHEN 3 THEN 'No payments, but account data; reports' WHEN 4 THEN 'reports only' WHEN 5 THEN 'something else' ELSE 'Payments and reports' END AS text FROM customer"


@query(f"""
SELECT vendor_id, CASE vendor_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE 4 END AS level, CASE vendor_id % 7 WHEN 1 THEN 'A4' WHEN 3 THEN 'A3' WHEN 4 THEN 'A1' WHEN 6 THEN 'A4' ELSE '' END AS anchor,
  CASE vendor_id % 7 WHEN 0 THEN 'the field is empty' WHEN 1 THEN 'a level below fits too; the higher is taken' WHEN 2 THEN 'no anchor; to confirm' WHEN 5 THEN 'no anchor; to confirm' ELSE '' END AS note FROM ({_FACTS}) f
""")
def factor_anchors(spark, sf_dir):
    found = claims.anchor([F.col("text")], [(4, "A4", r"(?i)payments"), (3, "A3", r"(?i)account data"), (1, "A1", r"(?i)reports")], 2, 0)
    return derived(spark, sf_dir, _FACTS).select("vendor_id", found.alias("f")).select("vendor_id", "f.level", "f.anchor", "f.note")


_REVIEWS = "SELECT o_orderkey - o_orderkey % 4 AS item_key, CASE o_orderkey % 4 WHEN 3 THEN 'rejected' WHEN 2 THEN 'accepted' ELSE 'pending' END AS value, o_orderkey AS seq FROM orders"


@query(evidence._GRADED.replace(f"WITH items AS ({ITEMS})", f"WITH last AS (SELECT item_key, arg_max(value, seq) AS value FROM ({_REVIEWS}) GROUP BY 1), items AS (SELECT i.* REPLACE (coalesce(value, 'pending') AS review) FROM ({ITEMS}) i LEFT JOIN last ON i.item_key = last.item_key)")
       + "SELECT item_key, review, citable, strength FROM s")
def rescored_items(spark, sf_dir):
    reviews = derived(spark, sf_dir, _REVIEWS)
    return claims.rescored(items(spark, sf_dir), reviews, [grading.graded]).select("item_key", "review", "citable", "strength")


_HOSTED = "SELECT page_id AS doc_id, page_id % 5 AS vendor_id, url, page_id % 17 AS cik FROM pages"


@query(r"""
WITH p AS (SELECT page_id AS doc_id, page_id % 5 AS vendor_id, page_id % 17 AS cik, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, lower(regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]+)', 1)) AS slug FROM pages)
SELECT doc_id, CASE WHEN vendor_id = 0 AND ends_with(host, '.example.com') THEN 'own' WHEN vendor_id = 1 AND ends_with(host, '.example.org') AND slug = 'en' THEN 'own' WHEN vendor_id = 2 AND cik = 3 THEN 'own'
  WHEN vendor_id = 0 AND ends_with(host, '.example.net') THEN 'platform_supplier' WHEN vendor_id = 3 AND ends_with(host, '.example.org') THEN 'affiliate_inferred' ELSE 'other' END AS relation FROM p
""")
def known_relations(spark, sf_dir):
    docs = derived(spark, sf_dir, _HOSTED).withColumn("host", E.host(F.col("url")))
    domains = spark.createDataFrame([(0, "example.com", "own"), (0, "example.net", "platform_supplier"), (3, "example.org", "affiliate_inferred")], "vendor_id long, domain string, relation string")
    boards = spark.createDataFrame([(1, "example.org", "en")], "vendor_id long, domain string, slug string")
    return tagging.known_relations(docs, domains, boards, spark.createDataFrame([(2, 3)], "vendor_id long, cik long")).select("doc_id", "relation")


_SPOKEN = """
SELECT c_custkey AS doc_id, c_custkey % 4 AS vendor_id, c_custkey % 5 = 0 AS linked, CASE c_custkey % 6 WHEN 0 THEN 'Acme Harbour is a town. Nothing else.' WHEN 1 THEN 'We met ACME today' WHEN 2 THEN 'Acme (US) Holdings, Inc. filed' WHEN 3 THEN 'Acme sells Beacon-One' WHEN 4 THEN 'Acmes and acme-like things' END AS text,
  'The agent of c' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN ' uses a language model.' WHEN 1 THEN ' sells houses. A model of a house' ELSE ', an estate agent. The language model and its agent' END AS talk FROM customer
"""


@query(f"""
SELECT doc_id, vendor_id, vendor_id = 1 AND doc_id % 6 IN (1, 2, 3) AS named, vendor_id = 1 AND (doc_id % 6 IN (2, 3) OR doc_id % 6 = 1 AND linked) AS corroborated FROM ({_SPOKEN}) s
""")
def document_subjects(spark, sf_dir):
    names = spark.createDataFrame([(1, "Acme", "name"), (1, "Acme (US) Holdings", "legal"), (1, "Beacon One", "product"), (1, "Acme Harbour", "collision"), (2, "Zeta", "name")], "vendor_id long, name string, kind string")
    return tagging.subjects(derived(spark, sf_dir, _SPOKEN), names)


@query(f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 1 END AS hits FROM ({_SPOKEN}) s")
def guarded_terms(spark, sf_dir):
    return derived(spark, sf_dir, _SPOKEN).select("doc_id", tagging.guarded_hits(F.col("talk"), "agent", "language model").alias("hits"))


_CLAIMED = "SELECT o_orderkey AS claim_id, o_custkey % 500 AS doc_id, o_orderkey % 4 = 0 AS long FROM orders"


@query(f"""
WITH c AS ({_CLAIMED}), s AS (SELECT c_custkey % 500 AS doc_id, bool_or(c_custkey % 7 = 0) AS ours FROM customer GROUP BY 1)
SELECT claim_id, concat_ws(',', CASE WHEN long THEN 'V3' END, CASE WHEN NOT coalesce(ours, false) THEN 'V6' END, CASE WHEN claim_id % 3 = 0 THEN 'V7' END) AS failures, NOT long AND coalesce(ours, false) AND claim_id % 3 > 0 AS ok FROM c LEFT JOIN s ON c.doc_id = s.doc_id
""")
def claim_gates(spark, sf_dir):
    checked = derived(spark, sf_dir, _CLAIMED).select("claim_id", "doc_id", F.when(F.col("long"), F.array(F.lit("V3"))).otherwise(F.array().cast("array<string>")).alias("failures"), (~F.col("long")).alias("ok"))
    subjects = read(spark, sf_dir, "customer").select((F.col("c_custkey") % 500).alias("doc_id"), F.lit(1).alias("vendor_id"), (F.col("c_custkey") % 7 == 0).alias("corroborated"))
    found = verify.gates(checked, subjects, checked.where("claim_id % 3 > 0"))
    return found.select("claim_id", F.array_join("failures", ",").alias("failures"), "ok")


_LOOSE = "SELECT o_orderkey AS id, o_orderkey % 300 AS doc_id, (o_orderkey * 41 + o_custkey * 13) % 9000 AS start, (o_orderkey * 41 + o_custkey * 13) % 9000 + 25 + o_custkey % 60 AS end_at, CAST(o_orderkey % 4 AS VARCHAR(9)) AS sp FROM orders"
_TAGGED = "SELECT c_custkey + 10000000 AS id, c_custkey % 300 AS doc_id, (c_custkey * 59) % 9000 AS start, (c_custkey * 59) % 9000 + 30 + c_custkey % 300 AS end_at, CAST(c_custkey % 4 AS VARCHAR(9)) AS sp FROM customer"


@query(f"""
WITH p AS ({_LOOSE}), i AS ({_TAGGED}), j AS (SELECT p.id AS pid, i.id AS iid, p.sp AS psp, least(p.end_at, i.end_at) - greatest(p.start, i.start) AS shared FROM p JOIN i ON p.doc_id = i.doc_id AND p.start < i.end_at AND i.start < p.end_at),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY shared DESC, iid) AS n FROM j) WHERE n = 1), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY shared DESC, pid) AS m FROM b) WHERE m = 1)
SELECT i.id, 'rules' AS method, coalesce(psp, '') AS said, CASE WHEN psp <> sp THEN 'sp' ELSE '' END AS differing FROM i LEFT JOIN t ON i.id = iid UNION ALL SELECT id, 'llm', sp, '' FROM p WHERE id NOT IN (SELECT pid FROM b)
""")
def absorbed_claims(spark, sf_dir):
    labelled = lambda sql: derived(spark, sf_dir, sql).withColumnRenamed("end_at", "end").withColumn("labels", F.create_map(F.lit("sp"), "sp"))
    found = verify.absorbed(labelled(_LOOSE), labelled(_TAGGED), ["sp", "rl"])
    return found.select("id", "method", F.coalesce(F.try_element_at("llm_labels", F.lit("sp")), F.lit("")).alias("said"), F.array_join("differing", ",").alias("differing"))


@query(r"""
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages)
SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'inline' WHEN page_id % 7 = 0 OR (page_id % 5 = 0 AND NOT ends_with(host, 'example.com')) THEN 'refused' WHEN page_id % 3 = 0 THEN 'media' WHEN page_id % 13 = 0 THEN 'tracker' WHEN ends_with(host, 'example.com') THEN 'own' ELSE 'other' END AS route FROM h
""")
def capture_routes(spark, sf_dir):
    i = F.col("page_id")
    same = F.lower("url").rlike(r"^[a-z]+://[^/?#]*example\.com([/?#:]|$)")
    url = F.when(i % 11 == 0, "data:text/plain,x").when((i % 13 == 0) & (i % 5 > 0), "https://pixel.example.com/t").when((i % 13 == 0) & same, "https://ads.example.com/t").when(i % 13 == 0, "https://ads.other.net/t").otherwise(F.col("url"))
    routed = E.route(url, F.lit("www.example.com"), F.when(i % 3 == 0, "media").otherwise("script"), F.when(i % 7 == 0, "post").otherwise("get"), i % 5 == 0)
    return read(spark, sf_dir, "pages").select("page_id", routed.alias("route"))


_TEXTS = "SELECT c_custkey AS vendor_id, CASE c_custkey % 4 WHEN 0 THEN 'Core ledger' WHEN 1 THEN 'Support desk' WHEN 2 THEN 'Something' ELSE '' END AS service, CASE c_custkey % 3 WHEN 0 THEN 'Holds account data' WHEN 1 THEN 'Privileged production access' ELSE 'Confidential plans' END AS data_accessed, 'Serves ' || (c_custkey * 113) || ' customers' AS data_volume, CASE WHEN c_custkey % 5 = 0 THEN 'No process stops' ELSE 'Payments stop without it' END AS process FROM customer"
_FIELDS = {"o": ["service"], "d": ["data_accessed"], "p": ["process"], "r": ["service"], "v": ["data_volume"]}
_RUBRIC = {"o": [(4, "O4", "(?i)core"), (1, "O1", "(?i)support")], "d": [(4, "D4", "(?i)account data"), (3, "D3-P", "(?i)privileged"), (2, "D2", "(?i)confidential")], "p": [(3, "P3", "(?i)payments stop")], "r": [(1, "R1", "(?i)support")]}
_DEFAULTS = {"o": (2, 0), "d": (2, None), "p": (0, None), "r": (0, None)}


@query(f"""
WITH p AS (SELECT vendor_id, CASE vendor_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS o, CASE vendor_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 2 END AS d, CASE WHEN vendor_id % 5 = 0 THEN 0 ELSE 3 END AS p, vendor_id % 3 = 1 AS d3p, vendor_id * 113 AS served FROM ({_TEXTS}) t),
l AS (SELECT *, (served >= 1)::INT + (served >= 10000)::INT + (served >= 100000)::INT + (served >= 1000000)::INT AS v, greatest(CASE WHEN d3p THEN 3 WHEN d >= 3 THEN CASE WHEN served >= 10000 THEN 4 ELSE 3 END ELSE 2 END, CASE WHEN vendor_id % 4 = 1 THEN 1 ELSE 0 END) AS r FROM p)
SELECT vendor_id, o, d, p, r, v, 7 * o + 6 * d + 5 * p + 4 * r + 3 * v AS score, ['Low', 'Medium', 'High', 'Critical'][1 + {evidence._BASE_TIER}] AS tier FROM l
""")
def criticality_of_texts(spark, sf_dir):
    found = claims.profiled(derived(spark, sf_dir, _TEXTS), _FIELDS, _RUBRIC, _DEFAULTS, ("customers",), ("records",))
    return found.select("vendor_id", "o", "d", "p", "r", "v", "score", "tier")


_PASSAGES = """
SELECT c_custkey AS passage_id, 'Our desk is open. We use a chatbot in production ' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '. We plan to use machine learning.' WHEN 1 THEN ', with customer data. Call us.' ELSE ' and more. A language model is next generation.' END AS passage,
  'own' AS relation, c_custkey % 10 = 9 AS job, true AS product, false AS commentary, c_custkey % 2 = 0 AS service, true AS named, 'A' AS sr, 3 AS rc FROM customer WHERE c_custkey % 7 > 0
"""


@query(f"""
SELECT passage_id, 18 AS start, CASE WHEN job THEN 'corporate_internal' ELSE 'service_feature' END AS locus, 'in_production' AS temporal, CASE WHEN job THEN 3 WHEN service THEN 1 ELSE 2 END AS u FROM ({_PASSAGES}) p
""")
def tagged_passages(spark, sf_dir):
    rows = derived(spark, sf_dir, _PASSAGES)
    return claims.tag_passages(rows, tagging.LEXICON).select("passage_id", "start", "locus", "temporal", "u")
