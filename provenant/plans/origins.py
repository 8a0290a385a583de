"""Queries of origins: equal keys, clusters, duplicates, corroboration marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.operators import grading, origins
from provenant.plans import evidence
from provenant.plans.tables import ITEMS, derived, items, query

#: Items with documents, pages and titles that some of them share; a seventh are DNS records.
_SOURCES = """
SELECT o_orderkey AS item_key, o_custkey % 40 AS vendor_id, '' || (o_orderkey % 4001) AS doc_id, 'https:/' || '/www.Site' || (o_custkey % 90) || '.org/p' || (o_orderkey % 2003) || '/#top' AS url,
  CASE WHEN o_orderkey % 5 = 0 THEN 'The long story ' || (o_orderkey % 1201) || ' – Site ' || (o_custkey % 3) WHEN o_orderkey % 5 = 1 THEN 'Short title' ELSE 'Site ' || (o_custkey % 7) || ' | Report number ' || (o_orderkey % 1999) || ' of many' END AS title,
  'x' || o_orderkey AS excerpt, CASE WHEN o_orderkey % 7 = 0 THEN 'provider:p' || (o_orderkey % 1009) ELSE '' END AS dns FROM orders
"""
_KEYS = f"""
s AS ({_SOURCES}), k AS (
  SELECT vendor_id, item_key, 'dns:' || dns AS key FROM s WHERE dns <> ''
  UNION SELECT vendor_id, item_key, 'doc:' || doc_id FROM s WHERE dns = ''
  UNION SELECT vendor_id, item_key, 'page:' || regexp_replace(regexp_replace(lower(url), '#.*$', ''), '^https://www[.]|/$', '', 'g') FROM s WHERE dns = ''
  UNION SELECT vendor_id, item_key, 'title:' || t FROM (SELECT vendor_id, item_key, unnest(list_distinct(list_transform(list_append(string_split_regex(lower(title), ' [|–] '), lower(title)), lambda p: array_to_string(regexp_extract_all(p, '[a-z0-9]+'), ' ')))) AS t FROM s WHERE dns = '')
  WHERE len(string_split(t, ' ')) >= 4
), l AS (SELECT vendor_id, key, item_key AS a, min(item_key) OVER (PARTITION BY vendor_id, key) AS b FROM k)
"""


@query(f"WITH {_KEYS} SELECT vendor_id, key, a, b FROM l WHERE a <> b")
def same_origin_links(spark, sf_dir):
    return origins.equal_links(derived(spark, sf_dir, _SOURCES))


@query(f"""
WITH RECURSIVE {_KEYS}, e AS (SELECT DISTINCT a, b FROM l WHERE a <> b UNION SELECT DISTINCT b, a FROM l WHERE a <> b), r(node, root) AS (SELECT item_key, item_key FROM s UNION SELECT r.node, e.b FROM r JOIN e ON r.root = e.a)
SELECT s.vendor_id, s.item_key, CAST(min(root) AS VARCHAR) AS cluster_id FROM r JOIN s ON node = s.item_key GROUP BY 1, 2
""")
def item_origins(spark, sf_dir):
    return origins.clustered(derived(spark, sf_dir, _SOURCES)).select("vendor_id", "item_key", "cluster_id")


_MARKED = evidence._GRADED + """, lim AS (SELECT vendor_id, max(published) AS d FROM ranked WHERE citable AND u = 8 AND sr IN ('A', 'B') AND rl = 3 GROUP BY 1),
backed AS (SELECT DISTINCT q.item_key FROM ranked q JOIN ranked k ON q.vendor_id = k.vendor_id AND q.cluster_id <> k.cluster_id AND (q.publisher <> k.publisher OR q.family <> k.family) WHERE (q.is_q OR q.is_k) AND k.is_k)
SELECT r.item_key, CASE WHEN u <= 4 AND coalesce(d >= published, false) THEN 5 WHEN b.item_key IS NOT NULL THEN 1 ELSE CASE WHEN family = 'DNS' THEN 2 WHEN rc = 0 OR sr IN ('E', 'F') THEN 6 WHEN sp <= 1 THEN 3 WHEN sr IN ('C', 'D') THEN 4 ELSE 2 END END AS ic
FROM ranked r LEFT JOIN lim ON r.vendor_id = lim.vendor_id LEFT JOIN backed b ON r.item_key = b.item_key
"""


@query(_MARKED)
def corroboration_marks(spark, sf_dir):
    return origins.marked(items(spark, sf_dir), grading.credibility(F.col("family") == "DNS")).select("item_key", "ic")


@query(evidence._GRADED.replace("WITH items", "WITH RECURSIVE items") + """, i AS (SELECT *, mask % 11 AS doc, item_key % 701 AS k, (item_key * 37) % 3000 AS a, (item_key * 37) % 3000 + 25 + mask % 200 AS z FROM ranked),
w AS (SELECT vendor_id, k, doc, a, z, row_number() OVER (PARTITION BY vendor_id ORDER BY NOT citable, s_rank, CASE method WHEN 'manual' THEN 0 WHEN 'rules' THEN 1 ELSE 2 END, a - z, k, doc, a) AS p FROM i),
f AS (SELECT vendor_id, p, k, doc, a, true AS kept, [k] AS keys, [{'d': doc, 'a': a, 'z': z}] AS spans FROM w WHERE p = 1
  UNION ALL SELECT w.vendor_id, w.p, w.k, w.doc, w.a, NOT (list_contains(keys, w.k) OR len(list_filter(spans, lambda x: x.d = w.doc AND x.a < w.z AND w.a < x.z)) > 0),
    CASE WHEN list_contains(keys, w.k) OR len(list_filter(spans, lambda x: x.d = w.doc AND x.a < w.z AND w.a < x.z)) > 0 THEN keys ELSE list_append(keys, w.k) END,
    CASE WHEN list_contains(keys, w.k) OR len(list_filter(spans, lambda x: x.d = w.doc AND x.a < w.z AND w.a < x.z)) > 0 THEN spans ELSE list_append(spans, {'d': w.doc, 'a': w.a, 'z': w.z}) END FROM f JOIN w ON f.vendor_id = w.vendor_id AND w.p = f.p + 1)
SELECT vendor_id, k AS item_key, doc AS doc_id, a AS start, kept FROM f
""")
def deduplicated_items(spark, sf_dir):
    rows = items(spark, sf_dir).withColumns({"doc_id": F.col("mask") % 11, "start": (F.col("item_key") * 37) % 3000, "end": (F.col("item_key") * 37) % 3000 + 25 + F.col("mask") % 200})
    return origins.dedupe(rows.withColumn("item_key", F.col("item_key") % 701))
