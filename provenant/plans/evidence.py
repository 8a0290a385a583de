"""Queries of the evidence operators and, where SQL can express them, the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenant.functions import expressions as E
from provenant.functions import udfs
from provenant.operators import components, evaluation, grading, runs, scoring, spans, verdict
from provenant.plans.tables import COVERAGE, ITEMS, PROFILES, derived, items, query, read

AS_OF = "2001-12-31"
TERMS = ("the", "de la", "und", "menteas")


# What the oracles share, written out apart from the operators.
_GRADED = f"""
WITH items AS ({ITEMS}), g AS (
  SELECT *, (review <> 'rejected' AND ai_type <> 'not_ai' AND NOT (method = 'llm' AND review = 'pending')) AS citable,
    (sp >= 2 AND rl >= 2 AND rc >= 1 AND u <= 4) AS uses,
    len(list_filter([CASE WHEN mask % 2 = 0 THEN 1 END, CASE WHEN mask % 3 = 0 THEN 1 END, CASE WHEN mask % 5 = 0 THEN 1 END, CASE WHEN mask % 7 = 0 THEN 1 END, CASE WHEN mask % 11 = 0 THEN 1 END], lambda x: x IS NOT NULL)) AS genuine
  FROM items
), t AS (
  SELECT *, citable AND sr IN ('A', 'B') AND uses AND locus IN ('service_feature', 'vendor_addon', 'delivery_ops', 'sdlc') AS is_q,
    citable AND sr IN ('A', 'B', 'C') AND uses AS is_k, sp >= 1 AND rl >= 2 AND rc >= 1 AND u IN (1, 2, 3, 4, 7) AS blocks,
    rc >= 1 AND rl >= 1 AND locus <> 'commentary' AND sr NOT IN ('E', 'F') AS decides,
    u = 8 AND sr IN ('A', 'B') AND rl >= 2 AND rc >= 1 AS limits2, u = 8 AND sr IN ('A', 'B') AND rl >= 3 AND rc >= 1 AS limits3
  FROM g
), s AS (
  SELECT *, CASE WHEN u = 8 THEN 'Negative' WHEN is_q AND rl = 3 THEN 'Strong' WHEN is_q OR is_k THEN 'Moderate' WHEN locus = 'relationship' THEN 'Context - relationship only'
    WHEN locus = 'platform_supplier' THEN 'Context - platform supplier' WHEN locus = 'affiliate_inferred' THEN 'Context - inferred affiliate'
    WHEN u = 7 OR sp = 0 THEN 'Marketing only' ELSE 'Weak' END AS strength
  FROM t
), ranked AS (
  SELECT *, list_position(['Negative', 'Strong', 'Moderate', 'Context - relationship only', 'Context - platform supplier', 'Context - inferred affiliate', 'Marketing only', 'Weak'], strength) AS s_rank,
    list_position(['service_feature', 'vendor_addon', 'delivery_ops', 'sdlc', 'corporate_internal', 'relationship', 'affiliate_inferred', 'platform_supplier', 'unknown', 'commentary'], locus) AS l_rank
  FROM s
)
"""
_BEST_FIRST = "s_rank, sr, rl DESC, rc DESC, u, l_rank, sp DESC, genuine DESC, n_providers DESC, item_key"


@query(_GRADED + "SELECT item_key, citable, is_q, is_k, blocks, decides, limits2, limits3, strength FROM s")
def item_grades(spark, sf_dir):
    return grading.graded(items(spark, sf_dir)).select("item_key", "citable", "is_q", "is_k", "blocks", "decides", "limits2", "limits3", "strength")


@query(f"""
WITH items AS ({ITEMS}), b AS (
  SELECT *, mask % 2 = 0 AS g1, mask % 3 = 0 AS g2, mask % 5 = 0 AS g3, mask % 7 = 0 AS g5, mask % 11 = 0 AS g6, mask % 4 = 0 AS m2, mask % 13 = 0 AS m3, mask % 6 = 0 AS m4,
    12 * (2001 - year(published)) + 12 - month(published) - CASE WHEN day(published) > 31 THEN 1 ELSE 0 END AS months
  FROM items
)
SELECT item_key,
  CASE WHEN temporal = 'planned' OR ((m2 OR m3) AND NOT (g2 OR g3)) THEN 0 WHEN (g1 OR g5 OR g6) AND (g2 OR g3) THEN 3
    WHEN (g2 OR g5) AND n_providers > 0 AND NOT m4 THEN 2 ELSE 1 END AS specificity,
  CASE WHEN locus = 'commentary' THEN 0 WHEN locus IN ('platform_supplier', 'affiliate_inferred') THEN 1 WHEN locus = 'relationship' THEN 2
    WHEN mask % 5 = 0 AND locus IN ('service_feature', 'vendor_addon') THEN 3 WHEN mask % 3 = 0 OR locus IN ('delivery_ops', 'sdlc') THEN 2 ELSE 1 END AS relevance,
  CASE WHEN months <= 12 THEN 'T3' WHEN months <= 24 THEN 'T2' WHEN months <= 36 THEN 'T1' ELSE 'T0' END AS recency,
  CASE WHEN family = 'DNS' THEN 2 WHEN rc = 0 OR sr IN ('E', 'F') THEN 6 WHEN sp <= 1 THEN 3 WHEN sr IN ('C', 'D') THEN 4 ELSE 2 END AS credibility
FROM b
""")
def item_levels(spark, sf_dir):
    return items(spark, sf_dir).select(
        "item_key",
        grading.specificity(F.col("n_providers") > 0, F.col("temporal")).alias("specificity"),
        grading.relevance(F.col("mask") % 5 == 0, F.col("mask") % 3 == 0).alias("relevance"),
        E.recency(F.col("published"), F.lit(AS_OF).cast("date")).alias("recency"),
        grading.credibility(F.col("family") == "DNS").alias("credibility"),
    )


@query(_GRADED + f""", c AS (
  SELECT *, row_number() OVER (PARTITION BY vendor_id, cluster_id ORDER BY {_BEST_FIRST}) AS n FROM ranked WHERE citable
), p AS (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY {_BEST_FIRST}) AS place FROM c WHERE n = 1)
SELECT vendor_id, CAST(place AS INT) AS place, item_key, strength FROM p WHERE place <= 3
""")
def best_items(spark, sf_dir):
    return grading.best_per_cluster(items(spark, sf_dir), 3).select("vendor_id", "place", "item_key", grading.strength().alias("strength"))


@query(_GRADED + """
SELECT item_key, 'V' || vendor_id || '-E-' || lpad(CAST(row_number() OVER (PARTITION BY vendor_id ORDER BY CASE item_key % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 4 ELSE 6 END, s_rank, sr, rl DESC, rc DESC, 'u' || (item_key % 50), mask % 90, item_key) AS VARCHAR), 4, '0') AS evidence_id FROM ranked
""")
def evidence_ids(spark, sf_dir):
    k = F.col("item_key") % 4
    rows = items(spark, sf_dir).withColumns({"role": F.when(k == 0, "Primary").when(k == 1, "Supporting").when(k == 2, "Negative"), "url": F.concat(F.lit("u"), F.col("item_key") % 50), "start": F.col("mask") % 90})
    return grading.evidence_ids(rows).select("item_key", "evidence_id")


@query(_GRADED + f""", c AS (
  SELECT *, row_number() OVER (PARTITION BY vendor_id, cluster_id ORDER BY mask % 3 <> 0, {_BEST_FIRST}) AS n FROM ranked WHERE citable
), p AS (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY {_BEST_FIRST}) AS place FROM c WHERE n = 1)
SELECT vendor_id, CAST(place AS INT) AS place, item_key FROM p WHERE place <= 5
""")
def preferred_items(spark, sf_dir):
    return grading.best_per_cluster(items(spark, sf_dir), 5, F.col("mask") % 3 == 0).select("vendor_id", "place", "item_key")


@query(_GRADED + """
SELECT q.vendor_id, q.item_key, count(*) AS n_corroborating FROM ranked q JOIN ranked k
  ON q.vendor_id = k.vendor_id AND q.cluster_id <> k.cluster_id AND (q.publisher <> k.publisher OR q.family <> k.family) WHERE q.is_q AND k.is_k GROUP BY 1, 2
""")
def corroboration_links(spark, sf_dir):
    return verdict.corroboration(items(spark, sf_dir))


@query(_GRADED + "SELECT vendor_id, cluster_id, publisher, family, count(*) FILTER (WHERE is_q) AS n_q, count(*) FILTER (WHERE is_k) AS n_k, min(item_key) AS best FROM ranked WHERE is_q OR is_k GROUP BY 1, 2, 3, 4")
def corroboration_classes(spark, sf_dir):
    return verdict.corroboration_classes(items(spark, sf_dir))


_COMPLETE = f"""
cov AS ({COVERAGE}), fam AS (
  SELECT vendor_id, family, min(list_position(['done_manual', 'stopped', 'done', 'pending', 'blocked_tou', 'blocked_robots', 'blocked_bot', 'error', 'descoped', 'not_applicable'], status)) AS r FROM cov GROUP BY 1, 2
), want AS (
  SELECT DISTINCT o_custkey % 40 AS vendor_id, f.family FROM orders, (VALUES ('LEG'), ('PRD'), ('IND')) f(family) WHERE (o_custkey % 40) % 3 > 0 OR f.family = 'LEG'
), done AS (
  SELECT w.vendor_id, bool_and(coalesce(r IN (1, 2, 3, 10), false)) AS complete, coalesce(string_agg(CASE WHEN coalesce(r IN (1, 2, 3, 10), false) THEN NULL ELSE w.family END, ',' ORDER BY w.family), '') AS missing
  FROM want w LEFT JOIN fam ON w.vendor_id = fam.vendor_id AND w.family = fam.family GROUP BY 1
)
"""


def _plan(spark, sf_dir):
    vendors = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("vendor_id")).distinct()
    return vendors.select("vendor_id", F.explode(F.array(F.lit("LEG"), F.lit("PRD"), F.lit("IND"))).alias("family")).withColumn("mandatory", (F.col("vendor_id") % 3 > 0) | (F.col("family") == "LEG"))


@query(f"""
WITH cov AS ({COVERAGE})
SELECT vendor_id, family, arg_min(status, list_position(['done_manual', 'stopped', 'done', 'pending', 'blocked_tou', 'blocked_robots', 'blocked_bot', 'error', 'descoped', 'not_applicable'], status)) AS status,
  CAST(sum(requests) AS BIGINT) AS requests, max(cap) AS cap, CAST(sum(documents) AS BIGINT) AS documents, string_agg(DISTINCT collector, '+' ORDER BY collector) AS collectors, count(*) AS n_rows,
  min(printf('%02d', list_position(['done_manual', 'stopped', 'done', 'pending', 'blocked_tou', 'blocked_robots', 'blocked_bot', 'error', 'descoped', 'not_applicable'], status)) || collector)[3:] AS decided_by
FROM cov GROUP BY 1, 2
""")
def family_status_rollup(spark, sf_dir):
    return runs.family_status(derived(spark, sf_dir, COVERAGE))


@query(f"WITH {_COMPLETE} SELECT vendor_id, complete, missing FROM done")
def coverage_complete(spark, sf_dir):
    return runs.complete(_plan(spark, sf_dir), runs.family_status(derived(spark, sf_dir, COVERAGE)))


@query(_GRADED + f", {_COMPLETE}" + """, pair AS (
  SELECT q.item_key, bool_or(k.is_k) AS ind, bool_or(k.is_k AND k.sr = 'A') AS ind_a FROM ranked q JOIN ranked k
    ON q.vendor_id = k.vendor_id AND q.cluster_id <> k.cluster_id AND (q.publisher <> k.publisher OR q.family <> k.family) WHERE q.citable AND k.is_k GROUP BY 1
), f AS (
  SELECT vendor_id, bool_or(is_q) AS any_q, bool_or(is_k) AS any_k, bool_or(is_q AND rl = 3 AND coalesce(ind, false)) AS confirmed, bool_or(is_k AND coalesce(ind, false)) AS paired,
    bool_or(is_k AND sr = 'A' AND coalesce(ind_a, false)) AS paired_a, bool_or(limits2) AS limited, bool_or(blocks) AS signalled, min(CASE WHEN is_q THEN published END) AS first_q,
    max(CASE WHEN limits3 THEN published END) AS last_limit, bool_or(is_k AND sr IN ('A', 'B') AND coalesce(ind, false)) AS strong_pair, bool_or(is_k AND sr IN ('A', 'B')) AS strong,
    count(*) FILTER (WHERE is_k AND sr = 'C') AS n_c
  FROM ranked LEFT JOIN pair USING (item_key) WHERE citable GROUP BY 1
), r AS (
  SELECT d.vendor_id, complete, f.* EXCLUDE (vendor_id), CASE WHEN last_limit >= first_q THEN 'a' WHEN confirmed THEN 'b' WHEN any_q OR paired THEN 'c' WHEN limited AND NOT any_q AND NOT any_k THEN 'd'
    WHEN complete AND NOT coalesce(signalled, false) THEN 'e' ELSE 'f' END AS rule FROM done d LEFT JOIN f ON d.vendor_id = f.vendor_id
)
SELECT vendor_id, rule, CASE rule WHEN 'a' THEN 'Inconclusive (conflict)' WHEN 'b' THEN 'Yes (confirmed)' WHEN 'c' THEN 'Yes (probable)' WHEN 'd' THEN 'No (affirmed)' WHEN 'e' THEN 'No (not detected)' ELSE 'Inconclusive' END AS verdict,
  CASE rule WHEN 'b' THEN CASE WHEN paired_a THEN 'almost certain' ELSE 'very likely' END WHEN 'c' THEN 'likely' WHEN 'd' THEN 'very unlikely' WHEN 'e' THEN 'unlikely'
    ELSE CASE WHEN coalesce(signalled, false) THEN 'roughly even chance' ELSE 'unlikely' END END AS likelihood,
  CASE WHEN rule = 'a' OR NOT complete THEN 'Low' WHEN rule IN ('b', 'c', 'd') AND strong_pair THEN 'High' WHEN coalesce(strong, false) OR coalesce(n_c, 0) >= 2 OR rule = 'e' THEN 'Moderate' ELSE 'Low' END AS confidence
FROM r
""")
def vendor_verdicts(spark, sf_dir):
    return verdict.verdicts(items(spark, sf_dir), runs.complete(_plan(spark, sf_dir), runs.family_status(derived(spark, sf_dir, COVERAGE))).drop("missing"))


@query(_GRADED.replace("WITH items", "WITH RECURSIVE items") + f""", w AS (SELECT vendor_id, item_key, cluster_id, publisher || family AS outlet, row_number() OVER (PARTITION BY vendor_id ORDER BY {_BEST_FIRST}) AS p FROM ranked WHERE is_k),
f AS (SELECT vendor_id, p, item_key, true AS kept, [cluster_id] AS clusters, [outlet] AS outlets FROM w WHERE p = 1
  UNION ALL SELECT w.vendor_id, w.p, w.item_key, NOT (list_contains(clusters, cluster_id) OR list_contains(outlets, outlet)),
    CASE WHEN list_contains(clusters, cluster_id) OR list_contains(outlets, outlet) THEN clusters ELSE list_append(clusters, cluster_id) END,
    CASE WHEN list_contains(clusters, cluster_id) OR list_contains(outlets, outlet) THEN outlets ELSE list_append(outlets, outlet) END FROM f JOIN w ON f.vendor_id = w.vendor_id AND w.p = f.p + 1)
SELECT vendor_id, item_key, CAST(row_number() OVER (PARTITION BY vendor_id ORDER BY p) AS INT) AS place FROM f WHERE kept
""")
def distinct_sources(spark, sf_dir):
    return verdict.distinct_sources(items(spark, sf_dir))


_TIER = """greatest(CASE WHEN {s} >= 80 THEN 3 WHEN {s} >= 50 THEN 2 WHEN {s} >= 25 THEN 1 ELSE 0 END, CASE WHEN {o} >= 4 THEN 3 ELSE 0 END, CASE WHEN {p} >= 3 AND {o} >= 3 THEN 3 ELSE 0 END,
  CASE WHEN {d} >= 4 AND {v} >= 3 THEN 2 ELSE 0 END, CASE WHEN {x} THEN 2 ELSE 0 END, CASE WHEN {d} >= 3 THEN 1 ELSE 0 END, CASE WHEN {d} >= 4 AND {v} >= 3 AND {o} >= 3 THEN 3 ELSE 0 END)"""
_BASE_TIER = _TIER.format(s="(7 * o + 6 * d + 5 * p + 4 * r + 3 * v)", o="o", d="d", p="p", v="v", x="d3p")


@query(f"WITH p AS ({PROFILES}) SELECT vendor_id, 7 * o + 6 * d + 5 * p + 4 * r + 3 * v AS score, ['Low', 'Medium', 'High', 'Critical'][1 + {_BASE_TIER}] AS tier FROM p")
def criticality_score(spark, sf_dir):
    return scoring.criticality(derived(spark, sf_dir, PROFILES)).select("vendor_id", "score", "tier")


def _variants() -> str:
    out = []
    for f in "odprv":
        for step in (-1, 1):
            level = {x: f"least(greatest({x} + {step}, 0), 4)" if x == f else x for x in "odprv"}
            total = " + ".join(f"{w} * {level[x]}" for x, w in zip("odprv", (7, 6, 5, 4, 3), strict=True))
            out.append(_TIER.format(s=f"({total})", o=level["o"], d=level["d"], p=level["p"], v=level["v"], x="false" if f == "d" else "d3p"))
            total = " + ".join(f"{w + (step if x == f else 0)} * {x}" for x, w in zip("odprv", (7, 6, 5, 4, 3), strict=True))
            out.append(_TIER.format(s=f"({total})", o="o", d="d", p="p", v="v", x="d3p"))
    return ", ".join(out)


@query(f"""
WITH p AS ({PROFILES}), x AS (SELECT vendor_id, {_BASE_TIER} AS base, [{_variants()}] AS ranks FROM p)
SELECT vendor_id, ['Low', 'Medium', 'High', 'Critical'][1 + base] AS tier, CAST(len(ranks) AS INT) AS variants, CAST(len(list_filter(ranks, lambda r: r <> base)) AS INT) AS changed,
  len(list_filter(ranks, lambda r: r <> base)) = 0 AS stable FROM x
""")
def criticality_sensitivity(spark, sf_dir):
    return scoring.sensitivity(derived(spark, sf_dir, PROFILES), "vendor_id")


#: The policy once more, written apart from the operator's.
_POLICY = """
('Critical', 'LEG', true, 40, 40), ('Critical', 'REG', true, 80, 80), ('Critical', 'PRD', true, 150, 150), ('Critical', 'JOB', true, 120, 120), ('Critical', 'DNS', true, 40, 40), ('Critical', 'IND', true, 30, 30), ('Critical', 'HIST', true, 30, 30), ('Critical', 'EXEC', false, 0, 0),
('High', 'LEG', true, 40, 40), ('High', 'REG', true, 40, 80), ('High', 'PRD', true, 100, 150), ('High', 'JOB', true, 60, 120), ('High', 'DNS', true, 40, 40), ('High', 'IND', true, 20, 30), ('High', 'HIST', false, 0, 30), ('High', 'EXEC', false, 0, 0),
('Medium', 'LEG', true, 15, 40), ('Medium', 'REG', true, 5, 80), ('Medium', 'PRD', true, 20, 150), ('Medium', 'JOB', true, 15, 120), ('Medium', 'DNS', true, 20, 40), ('Medium', 'IND', false, NULL, 30), ('Medium', 'HIST', false, NULL, 30), ('Medium', 'EXEC', false, NULL, 0),
('Low', 'LEG', true, 3, 40), ('Low', 'REG', false, NULL, 80), ('Low', 'PRD', true, 1, 150), ('Low', 'JOB', false, NULL, 120), ('Low', 'DNS', true, 10, 40), ('Low', 'IND', false, NULL, 30), ('Low', 'HIST', false, NULL, 30), ('Low', 'EXEC', false, NULL, 0)
"""


@query(f"""
WITH p AS ({PROFILES}), t AS (SELECT *, ['Low', 'Medium', 'High', 'Critical'][1 + {_BASE_TIER}] AS tier FROM p), pol(tier, family, mandatory, cap, deepest) AS (VALUES {_POLICY}), j AS (
  SELECT vendor_id, family, mandatory, cap, deepest, (NOT registered AND mandatory AND family = 'REG') AS replaced,
    (d >= 4 AND t.tier <> 'Critical' AND family IN ('LEG', 'HIST')) OR (d3p AND family = 'IND') OR (NOT registered AND t.tier <> 'Low' AND family IN ('LEG', 'HIST')) AS raised
  FROM t JOIN pol ON t.tier = pol.tier)
SELECT vendor_id, family, (mandatory OR raised) AND NOT replaced AS mandatory, CAST(CASE WHEN replaced THEN NULL WHEN raised THEN greatest(coalesce(cap, 0), deepest) ELSE cap END AS INT) AS cap, replaced AS not_applicable FROM j
""")
def depth_plan(spark, sf_dir):
    return scoring.depth_plan(scoring.criticality(derived(spark, sf_dir, PROFILES)))


def _risk_rows(spark, sf_dir):
    marks = F.array_compact(F.array(F.when(F.col("x3"), F.lit("X3")), F.when(F.col("x6"), F.lit("X6"))))
    return derived(spark, sf_dir, PROFILES).withColumn("escalators", marks)


def _steps(e: str, k: str, tg: str, v: str, esc: str) -> str:
    arp = f"(2 * {e} + 2 * {k} + tier_points + {tg})"
    cls = f"CASE WHEN {arp} >= 14 THEN 3 WHEN {arp} >= 10 THEN 2 WHEN {arp} >= 6 THEN 1 ELSE 0 END"
    gate = f"({e} >= 2 OR {k} >= 2)"
    gated = f"CASE WHEN {gate} THEN {cls} ELSE least({cls}, 1) END"
    return f"CASE WHEN {esc} AND {gate} AND {v} IN ('Confirmed', 'Probable') THEN greatest({gated}, 2) ELSE {gated} END"


def _cap(v: str, before: str) -> str:
    return f"CASE WHEN {v} IN ('Affirmed', 'Not detected') THEN -1 WHEN {v} = 'Inconclusive' THEN least({before}, 1) WHEN {v} = 'Probable' THEN least({before}, 2) ELSE {before} END"


_NAMED = "CASE WHEN {0} < 0 THEN 'None identified' ELSE ['Low', 'Medium', 'High', 'Critical'][1 + {0}] END"
_RISK = f"""
p AS ({PROFILES}), g AS (SELECT *, CASE WHEN missing <= 1 THEN 0 WHEN missing <= 3 THEN 1 WHEN missing <= 5 THEN 2 ELSE 3 END AS tg, x3 OR x6 AS esc FROM p), s AS (
  SELECT *, {_steps('e', 'k', 'tg', 'verdict', 'esc')} AS before, {_cap('verdict', _steps('e', 'k', 'tg', 'verdict', 'esc'))} AS after, {_steps('3', '3', '3', "'Confirmed'", 'true')} AS worst,
    {_cap('verdict', _steps('least(e + 1, 3)', 'k', 'tg', 'verdict', 'esc'))} AS up_e, {_cap('verdict', _steps('e', 'least(k + 1, 3)', 'tg', 'verdict', 'esc'))} AS up_k,
    {_steps('e', 'k', 'tg', "'Confirmed'", 'esc')} AS sure FROM g
), risk AS (
  SELECT vendor_id, 2 * e + 2 * k + tier_points + tg AS arp, tg, (e >= 2 OR k >= 2) AS gate_met, {_NAMED.format('before')} AS before_cap, {_NAMED.format('after')} AS risk_class, {_NAMED.format('worst')} AS ceiling,
    concat_ws(',', CASE WHEN up_e > after THEN 'exposure up' END, CASE WHEN up_k > after THEN 'decision up' END, CASE WHEN sure > after THEN 'confirmed' END) AS flips FROM s
)"""


@query(f"WITH {_RISK} SELECT * FROM risk")
def risk_steps(spark, sf_dir):
    return scoring.risk(_risk_rows(spark, sf_dir))


@query(f"""
WITH p AS ({PROFILES})
SELECT vendor_id, concat_ws(',', CASE WHEN e >= 2 THEN 'RT1' END, CASE WHEN missing >= 2 OR x6 THEN 'RT2' END, CASE WHEN k >= 2 OR missing >= 4 THEN 'RT3' END, CASE WHEN k >= 3 OR x3 THEN 'RT4' END,
  CASE WHEN ai_type IN ('genai_llm', 'agentic') THEN 'RT5' END, CASE WHEN ai_type = 'predictive_ml' THEN 'RT6' END) AS themes FROM p
""")
def risk_themes(spark, sf_dir):
    rows = _risk_rows(spark, sf_dir)
    return rows.select("vendor_id", F.array_join(scoring.themes(F.col("e"), F.col("k"), F.col("missing"), F.col("escalators"), F.col("ai_type")), ",").alias("themes"))


@query(f"""
WITH {_RISK}, t AS (SELECT vendor_id, verdict, ['Low', 'Medium', 'High', 'Critical'][1 + {_BASE_TIER}] AS tier FROM p), a AS (
  SELECT vendor_id, tier, ceiling, CASE WHEN risk_class = 'None identified' THEN CASE WHEN tier IN ('Critical', 'High') THEN 'none-high' ELSE 'none-low' END WHEN verdict = 'Inconclusive' THEN 'provisional'
    WHEN risk_class = 'Critical' THEN 'critical' WHEN risk_class = 'High' THEN 'high' ELSE 'standard' END AS playbook FROM t JOIN risk USING (vendor_id))
SELECT vendor_id, playbook, CASE playbook WHEN 'critical' THEN 15 WHEN 'high' THEN CASE WHEN tier = 'Critical' THEN 15 ELSE 30 END WHEN 'provisional' THEN CASE WHEN ceiling IN ('High', 'Critical') THEN 15 ELSE 30 END
  WHEN 'standard' THEN CASE WHEN tier = 'Critical' THEN 15 ELSE 30 END END AS deadline_days FROM a
""")
def action_plans(spark, sf_dir):
    rows = scoring.criticality(_risk_rows(spark, sf_dir))
    return scoring.actions(scoring.risk(rows).join(rows.select("vendor_id", "tier", "verdict"), "vendor_id"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_event_wins(spark, sf_dir):
    return runs.latest(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""
WITH e AS (SELECT *, event_type = 'purchase' AS fresh, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
i AS (SELECT *, CAST(sum(CASE WHEN fresh THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS idle FROM e)
SELECT event_id, idle, coalesce(max(idle) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 8, false) AS stopped FROM i
""")
def saturation_stop(spark, sf_dir):
    return runs.saturation(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", 8).select("event_id", "idle", "stopped")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS INT) AS nth, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 2 AS granted FROM events")
def host_budget_gate(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return runs.within_budget(events, ["user_id", "day"], ["ts", "event_id"], F.lit(2)).select("event_id", "nth", "granted")


@query("""
SELECT event_type, CAST(CAST(json_extract_string(props, '$.k') AS INT) % 5 AS INT) AS bucket, count(*) AS n, round(sum(value), 2) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2
""")
def json_histogram(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k INT")["k"])
    return rows.groupBy("event_type", (F.col("k") % 5).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.count_distinct("user_id").alias("users"))


@query("""
SELECT user_id, event_type, arg_min(event_id, ts) AS event_id, count(*) AS n FROM events GROUP BY 1, 2
""")
def first_outcomes(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    first = runs.first_outcomes(events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")
    return first.join(events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")), ["user_id", "event_type"])


@query("SELECT sha256(coalesce(text, '')) AS sha, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, sf_dir):
    return evaluation.duplicate_groups(read(spark, sf_dir, "documents"))


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


@query(f"""
SELECT page_id, {_HOST} AS host,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '#.*$', ''), '^[a-z][a-z0-9+.-]*://', ''), '^www[.]', ''), '/+$', '') AS page_key,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')) || regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '#.*$', ''), '/+$', '') AS match_key,
  array_to_string(list_slice(string_split({_HOST}, '.'), greatest(1, len(string_split({_HOST}, '.')) - 1), len(string_split({_HOST}, '.'))), '.') AS registrable FROM pages
""")
def page_key_hosts(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", E.host(url).alias("host"), E.page_key(url).alias("page_key"), E.match_key(url).alias("match_key"), E.registrable(E.host(url)).alias("registrable"))


_PATH = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1))"
_SCORE = f"""CASE WHEN regexp_matches({_PATH}, '[.](png|jpe?g|gif|svg|css|js|ico|zip|mp4|woff2?)$') THEN 0 ELSE CASE WHEN regexp_matches({_PATH}, 'privacy|terms|legal|policy|subprocessor') THEN 5 ELSE 0 END
 + CASE WHEN regexp_matches({_PATH}, 'security|trust|compliance') THEN 4 ELSE 0 END + CASE WHEN regexp_matches({_PATH}, 'product|platform|docs|help') THEN 3 ELSE 0 END + CASE WHEN regexp_matches({_PATH}, 'blog|news|press|en/') THEN 2 ELSE 0 END END"""


@query(f"SELECT host, page_id, score FROM (SELECT {_HOST} AS host, page_id, {_SCORE} AS score, row_number() OVER (PARTITION BY {_HOST} ORDER BY {_SCORE} DESC, page_id) AS n FROM pages) WHERE n <= 3 AND score > 0")
def url_score_topk(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", E.host(F.col("url")).alias("host"), E.url_score(F.col("url")).alias("score")).where("score > 0")
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("score"), "page_id"))
    return rows.withColumn("n", place).where("n <= 3").select("host", "page_id", "score")


_TERMS = [("example.com", "allowed", 1.0), ("example.net", "limited", 1.0), ("example.org", "none", 1.0), ("tionsh.example.net", "allowed", 0.0), ("m.thther.example.org", "manual", 1.0)]


@query(f"""
WITH h AS (SELECT page_id, {_HOST} AS host, page_id % 3 = 0 AS seeded FROM pages), t(domain, automation, rps) AS (VALUES {', '.join(f"('{d}', '{a}', {r})" for d, a, r in _TERMS)}),
b AS (SELECT host, arg_max(domain, length(domain)) AS domain FROM (SELECT DISTINCT host FROM h) JOIN t ON host = domain OR ends_with(host, '.' || domain) GROUP BY 1)
SELECT page_id, h.host, b.domain, CASE WHEN h.host = '' THEN 'no_host' WHEN b.domain IS NULL THEN 'unknown' WHEN automation = 'manual' THEN 'manual' WHEN automation = 'none' THEN 'blocked_tou'
  WHEN automation = 'limited' AND NOT seeded THEN 'seeds_only' WHEN rps <= 0 THEN 'blocked_rate' ELSE 'allow' END AS decision FROM h LEFT JOIN b ON h.host = b.host LEFT JOIN t ON t.domain = b.domain
""")
def access_gate(spark, sf_dir):
    requests = read(spark, sf_dir, "pages").select("page_id", E.host(F.col("url")).alias("host"), (F.col("page_id") % 3 == 0).alias("seeded"))
    terms = spark.createDataFrame(_TERMS, "domain string, automation string, rps double")
    return runs.access(requests, terms).select("page_id", "host", "domain", "decision")


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}')) AS with_email FROM documents GROUP BY 1")
def email_redaction_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").rlike(E.EMAIL)).alias("with_email"))


_RUNS = "list_transform(range(1, greatest(0, len(w) - 5) + 1), lambda i: array_to_string(list_slice(w, i, i + 5), ' '))"


@query(f"""
WITH b AS (SELECT DISTINCT unnest({_RUNS}) AS s FROM (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark)),
d AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest({_RUNS}) AS s FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)))
SELECT doc_id, count(*) AS n_blocked FROM d JOIN b USING (s) GROUP BY 1
""")
def shingle_blocklist(spark, sf_dir):
    return evaluation.blocked_shingles(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), 6)


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def gold_excerpt_hits(spark, sf_dir):
    return evaluation.excerpt_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE hit) AS located, round(100.0 * count(*) FILTER (WHERE hit) / count(*), 1) AS percent FROM (SELECT item_id, EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text)) AS hit FROM benchmark b)")
def gold_excerpt_recall(spark, sf_dir):
    docs, marks = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return evaluation.recall(marks, evaluation.excerpt_hits(docs, marks))


@query("SELECT quality AS expected, n_chars >= 500 AS found, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def label_confusion(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").withColumn("long", F.col("n_chars") >= 500)
    return evaluation.confusion(rows, "quality", "long")


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE (toxic = 1) = (quality = 0)) AS agree, round(100.0 * count(*) FILTER (WHERE (toxic = 1) = (quality = 0)) / count(*), 1) AS percent FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def label_agreement(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return evaluation.agreement(rows, F.col("toxic") == 1, F.col("quality") == 0, "lang")


@query(f"""
WITH i AS ({ITEMS}) SELECT CAST(12 * (2001 - year(published)) + 10 - month(published) - CASE WHEN day(published) > 15 THEN 1 ELSE 0 END AS INT) AS months, strftime(CAST(published - INTERVAL 6 MONTH AS DATE), '%Y-%m-%d') AS earlier, strftime(published, '%Y-%m-%d') AS iso, count(*) AS n FROM i GROUP BY 1, 2, 3
""")
def date_rules(spark, sf_dir):
    rows = items(spark, sf_dir).select(E.months_apart(F.col("published"), F.lit("2001-10-15").cast("date")).alias("months"), E.months_before(F.col("published"), 6).cast("string").alias("earlier"), F.date_format("published", "yyyy-MM-dd").alias("iso"))
    return rows.groupBy("months", "earlier", "iso").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT doc_id, substring(sha256(concat_ws('|', CAST(doc_id AS VARCHAR), '0', CAST(n_chars AS VARCHAR))), 1, 16) AS passage_id, sha256(concat_ws('|', source, sha256(text))) AS item_key FROM documents
""")
def content_keys(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", E.passage_id(F.col("doc_id"), F.lit(0), F.col("n_chars")).alias("passage_id"), E.item_key(F.col("source"), F.col("text")).alias("item_key"))


_SPANS = {
    "orders": "SELECT o_orderkey AS id, o_orderkey % 300 AS doc_id, (o_orderkey * 37 + o_custkey * 11) % 5000 AS start, (o_orderkey * 37 + o_custkey * 11) % 5000 + 20 + o_custkey % 90 AS end_at FROM orders",
    "customer": "SELECT c_custkey AS id, c_custkey % 300 AS doc_id, (c_custkey * 53) % 5000 AS start, (c_custkey * 53) % 5000 + 10 + c_custkey % 400 AS end_at FROM customer",
}


def _spans(spark, sf_dir, name: str) -> DataFrame:
    return derived(spark, sf_dir, _SPANS[name]).withColumnRenamed("end_at", "end")


@query(f"""
WITH a AS ({_SPANS['orders']}), b AS ({_SPANS['customer']}), j AS (SELECT a.id AS left_id, b.id AS right_id, least(a.end_at, b.end_at) - greatest(a.start, b.start) AS shared FROM a JOIN b ON a.doc_id = b.doc_id AND a.start < b.end_at AND b.start < a.end_at)
SELECT left_id, right_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY shared DESC, right_id) AS n FROM j) WHERE n = 1
""")
def span_overlap_best(spark, sf_dir):
    return spans.best_overlap(spans.overlaps(_spans(spark, sf_dir, "orders"), _spans(spark, sf_dir, "customer")))


@query(f"""
WITH a AS ({_SPANS['orders']}), o AS (SELECT *, CASE WHEN max(end_at) OVER (PARTITION BY doc_id ORDER BY start, end_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start THEN 0 ELSE 1 END AS opens FROM a),
i AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY start, end_at ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT doc_id, min(start) AS start, max(end_at) AS "end", count(*) AS n FROM i GROUP BY doc_id, island
""")
def span_overlap_merge(spark, sf_dir):
    return spans.islands(_spans(spark, sf_dir, "orders"))


@query(f"""
WITH RECURSIVE a AS ({_SPANS['orders']}), w AS (SELECT doc_id, id, start, end_at, row_number() OVER (PARTITION BY doc_id ORDER BY end_at - start DESC, id) AS p FROM a),
f AS (SELECT doc_id, p, id, start, end_at, true AS kept, [{{'s': start, 'e': end_at}}] AS spans FROM w WHERE p = 1
  UNION ALL SELECT w.doc_id, w.p, w.id, w.start, w.end_at, len(list_filter(spans, lambda x: x.s < w.end_at AND w.start < x.e)) = 0,
    CASE WHEN len(list_filter(spans, lambda x: x.s < w.end_at AND w.start < x.e)) = 0 THEN list_append(spans, {{'s': w.start, 'e': w.end_at}}) ELSE spans END FROM f JOIN w ON f.doc_id = w.doc_id AND w.p = f.p + 1)
SELECT doc_id, id, start, end_at AS "end" FROM f WHERE kept
""")
def span_greedy_keep(spark, sf_dir):
    return spans.keep_greedily(_spans(spark, sf_dir, "orders"), "doc_id", [(F.col("end") - F.col("start")).desc(), F.col("id")])


@query("""
WITH RECURSIVE e AS (SELECT o_orderkey AS a, CASE WHEN o_orderkey % 16 < 12 THEN o_orderkey + 4 ELSE o_orderkey - 1 END AS b FROM orders), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, reach) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.reach = u.a)
SELECT node, min(reach) AS root FROM r GROUP BY 1
""")
def origin_clusters(spark, sf_dir):
    key = F.col("o_orderkey")
    return components.components(read(spark, sf_dir, "orders").select(key.alias("a"), F.when(key % 16 < 12, key + 4).otherwise(key - 1).alias("b")))


@query("""
WITH t AS (SELECT doc_id, coalesce(nullif(regexp_extract(text, '^[^.]*'), ''), '') AS title FROM documents), k AS (
  SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+'))), ' ') AS k, len(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+'))) AS n FROM t)
SELECT k AS title_key, count(*) AS n, min(doc_id) AS first_id FROM k WHERE n >= 4 GROUP BY 1 HAVING count(*) > 1
""")
def shared_titles(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", r"^[^.]*", 0).alias("title"))
    keys = rows.select("doc_id", F.get(F.array_distinct(F.transform(F.array(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9]+"), F.lit(0))))), lambda w: F.when(F.size(w) >= 4, F.array_join(w, " ")))), F.lit(0)).alias("title_key"))
    return keys.where("title_key IS NOT NULL").groupBy("title_key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(f"""
WITH i AS ({ITEMS}), t AS (SELECT vendor_id, 'Prov' || publisher AS provider FROM i WHERE family = 'IND'), o AS (SELECT vendor_id, 'PROV' || n_providers AS provider FROM i WHERE family = 'LEG')
SELECT vendor_id, lower(provider) AS provider_key, min(provider) AS provider FROM t WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.vendor_id = t.vendor_id AND lower(o.provider) = lower(t.provider)) GROUP BY 1, 2
""")
def third_party_providers(spark, sf_dir):
    rows = items(spark, sf_dir)
    third = rows.where("family = 'IND'").select("vendor_id", F.concat(F.lit("Prov"), "publisher").alias("provider"))
    own = rows.where("family = 'LEG'").select("vendor_id", F.concat(F.lit("PROV"), "n_providers").alias("provider"))
    return scoring.one_sided(third, own)


@query(f"""
WITH i AS ({ITEMS}), a AS (SELECT vendor_id, family, count(*) AS n FROM i WHERE sr = 'A' GROUP BY 1, 2), b AS (SELECT vendor_id, family, count(*) AS n FROM i WHERE review = 'rejected' GROUP BY 1, 2)
SELECT vendor_id, family, a.n AS left_value, b.n AS right_value, CASE WHEN b.n IS NULL THEN 'left' WHEN a.n IS NULL THEN 'right' ELSE 'both' END AS side
FROM a FULL JOIN b USING (vendor_id, family) WHERE a.n IS DISTINCT FROM b.n
""")
def table_differences(spark, sf_dir):
    rows = items(spark, sf_dir)
    side = lambda where: rows.where(where).groupBy("vendor_id", "family").agg(F.count(F.lit(1)).alias("n"))
    return runs.differences(side("sr = 'A'"), side("review = 'rejected'"), ["vendor_id", "family"], "n")


@query("SELECT DISTINCT l_partkey + l_suppkey AS cited FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey + l_suppkey)")
def dangling_citations(spark, sf_dir):
    cited = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") + F.col("l_suppkey")).alias("cited")).distinct()
    return runs.dangling(cited, read(spark, sf_dir, "part").select(F.col("p_partkey").alias("cited")), "cited")


@query("""
SELECT o_custkey % 50 AS key, o_custkey % 50 % 3 <> 2 OR bool_or(o_orderstatus = 'F') AS from_cache, arg_min(m, r) AS model FROM (
  SELECT o_custkey, o_orderstatus, o_orderkey % 3 AS r, ['m0', 'm1', 'm2'][1 + CAST(o_orderkey % 3 AS INT)] AS m FROM orders) WHERE o_orderstatus = 'F' GROUP BY 1
""")
def response_cache(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    cache = orders.select((F.col("o_custkey") % 50).alias("key"), F.concat(F.lit("m"), F.col("o_orderkey") % 3).alias("model"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("error").alias("status"), F.lit("-").alias("response"))
    calls = cache.select("key").distinct()
    return runs.cached(calls, cache, ["m0", "m1", "m2"]).where("from_cache").select("key", "from_cache", "model")


@query("""
WITH b AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM benchmark), bs AS (SELECT DISTINCT array_to_string(w[i:i + 5], ' ') AS s FROM b, unnest(range(1, len(w) - 4)) t(i)),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents), held AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, array_to_string(w[i:i + 5], ' ') AS s FROM d, unnest(range(1, len(w) - 4)) t(i)) JOIN bs USING (s))
SELECT doc_id, CASE WHEN regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----|\\b(AKIA|ASIA)[0-9A-Z]{16}\\b|\\b(ghp|gho|ghs|sk|pk|xoxb|xoxp)[_-][A-Za-z0-9_-]{16,}|(?i)\\b(api[_-]?key|secret|password|passwd|token)\\b\\s*[:=]\\s*[^\\s]{6,}') THEN 'secret'
  WHEN regexp_matches(text, '[^\\s@<>()\\[\\],;:"'']+@([0-9A-Za-z-]+[.])+[A-Za-z]{2,}') THEN 'email' WHEN held.doc_id IS NOT NULL THEN 'shingle' WHEN source = 'src3' THEN 'host' END AS reason FROM documents LEFT JOIN held USING (doc_id)
""")
def payload_guard(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rows = docs.join(evaluation.blocked_shingles(docs, read(spark, sf_dir, "benchmark"), 6), "doc_id", "left")
    return evaluation.guard(rows, F.col("source") != "src3").select("doc_id", "reason")


@query()
def passages_by_source(spark, sf_dir):
    found = spans.passages(read(spark, sf_dir, "documents"), TERMS, carry=("source", "lang"))
    return found.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("passages"), F.count_distinct("doc_id").alias("documents"), F.sum(F.size("hits")).alias("hits"))


@query()
def sentence_context(spark, sf_dir):
    return spans.in_context(spans.sentences(read(spark, sf_dir, "documents"))).select("doc_id", "ordinal", "start", "end", F.length("before").alias("before"), F.length("after").alias("after"))


_PLAIN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '</?[a-zA-Z][^>]*>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"


@query(r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '\s+', ' ', 'g') AS body, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages),
b AS (SELECT page_id, """ + _PLAIN.format(x="regexp_replace(body, '</?(p|h1|br)>', chr(10), 'g')") + r""" AS body, """ + _PLAIN.format(x="title") + r""" AS title FROM a),
c AS (SELECT page_id, title, array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, trim(regexp_replace(title, '\s+', ' ', 'g')) AS title, CAST(length(text) AS INT) AS n_chars FROM c
""")
def html_main_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", udfs.title(F.col("html")).alias("title"), F.length(udfs.main_text(F.col("html"))).alias("n_chars"))


@query(r"""
SELECT conv_id, turn, role, CASE WHEN regexp_matches(substr(text, 5, 40), '^\s*$') THEN -1 ELSE CAST(strpos(text, substr(text, 5, 40)) - 1 AS INT) END AS start FROM conversations
""")
def located_quotes(spark, sf_dir):
    talk = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.substring("text", 5, 40).alias("quote"), "text")
    return talk.select("conv_id", "turn", "role", udfs.located(F.col("quote"), F.col("text")).alias("start"))


@query()
def redacted_texts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(udfs.redacted(F.col("text")), 256).alias("redacted_sha"))
