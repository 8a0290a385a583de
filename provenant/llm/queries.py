"""The queries of the ten operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm import gru_lm, html_template, iblt, mixing, mpeg, packing, simhash, toxicity, url_tree, warc
from provenant.llm.common import table, written


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by its host's template."""
    return html_template.extract(table(spark, sf_dir, "pages")).drop("content")


#: Not the method: the pages of these tables have one article, whose text patterns can take out. What the templates find must be that.
OP1_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '\s+', ' ', 'g') AS body FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?(p|h1|ul|li|div|section)( [^>]*)?>', chr(10), 'g'), '<br>', ' ', 'g') AS body FROM a),
c AS (SELECT page_id, url, regexp_replace(body, '</?[a-zA-Z][^>]*>', '', 'g') AS body FROM b),
d AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS body FROM c),
e AS (SELECT page_id, url, array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM d)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM e
"""


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page: the rules', else the path tree's."""
    return url_tree.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


#: The rules in SQL. In these tables every url that a rule's neighbours could condemn has a rule itself, so the tree allows the others.
OP2_SQL = """
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, '.' || host AS below FROM b),
d AS (SELECT page_id, host, path, CASE WHEN ends_with(below, '.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8' WHEN ends_with(below, '.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
  WHEN ends_with(below, '.com') AND starts_with(path, '/en/') THEN 'com/en/' WHEN ends_with(below, '.net') AND starts_with(path, '/de/') THEN 'net/de/' WHEN ends_with(below, '.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/de/8', 'com/en/', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict FROM d
"""


def op3_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an MPEG audio stream, and what the stored bytes read back to, with the offset of each frame."""
    return mpeg.features(mpeg.stored(table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of each category for every text, and whether it is rejected."""
    judged = toxicity.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.drop("text").withColumnRenamed("tox_rejected", "rejected")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every text in one piece of one sequence."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every text."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages read back to."""
    found = warc.read(written(warc.archives(table(spark, sf_dir, "pages")), "warc"), with_payload=False)
    return found.where("kind = 'record'").select(
        F.expr(warc.page_of("record_id")).alias("page_id"),
        "payload_bytes",
        F.col("payload_sha1").alias("payload_digest"),
        "record_type",
        F.expr(warc.page_of("refers_to")).alias("refers_to"),
    )


OP7_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), t AS (
  SELECT payload_digest AS digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM p LEFT JOIN t ON payload_digest = digest AND payload_bytes >= 1000
"""


def op8_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every text by the network trained on those that are not held out."""
    return gru_lm.score(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every text."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), s AS (
  SELECT skey, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * CAST(sum(size) AS DOUBLE) AS lim,
         CASE (row_number() OVER (ORDER BY skey) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY skey
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
             - coalesce(sum(lim) OVER (ORDER BY lim / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY lim / w, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev,
         row_number() OVER (ORDER BY lim / w, skey) AS place
  FROM s
), f AS (
  SELECT arg_min(lev, place) AS lev FROM l WHERE lev <= lim / w
), t AS (
  SELECT skey, source_size, CASE WHEN (SELECT lev FROM f) IS NULL THEN lim ELSE least(lim, (SELECT lev FROM f) * w) END AS target FROM l
), r AS (
  SELECT d.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(sum(size) OVER (PARTITION BY d.skey ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
  FROM d JOIN t ON d.skey = t.skey
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM r
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(greatest(budget - epochs * source_size - start, 0), size) AS BIGINT) AS taken
FROM e
"""

def op10_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited one, and what their difference tells."""
    return iblt.compare(table(spark, sf_dir, "documents")).drop("added", "removed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_urls": op2_urls,
    "op3_mpeg": op3_mpeg,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_warc": op7_warc,
    "op8_gru": op8_gru,
    "op9_mixing": op9_mixing,
    "op10_iblt": op10_iblt,
}
ORACLES: dict[str, str] = {"op1_html": OP1_SQL, "op2_urls": OP2_SQL, "op7_warc": OP7_SQL, "op9_mixing": OP9_SQL}
