"""Evidence tables derived from the star schema, as SQL that Spark and DuckDB read alike: inputs of queries and oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ITEMS = """
SELECT o_orderkey AS item_key, o_custkey % 40 AS vendor_id, o_orderkey % 977 AS cluster_id, CAST(o_custkey % 12 AS INT) AS publisher,
  substring('LEGREGPRDJOBDNSIND', CAST(1 + 3 * (o_orderkey % 6) AS INT), 3) AS family,
  substring('ABCDEF', CAST(1 + (o_custkey + o_orderkey) % 6 AS INT), 1) AS sr,
  CAST((o_orderkey % 7) % 4 AS INT) AS sp, CAST((o_custkey + 2 * o_orderkey) % 4 AS INT) AS rl, CAST((o_orderkey % 13) % 4 AS INT) AS rc,
  CAST(1 + (o_orderkey + 3 * o_custkey) % 8 AS INT) AS u, CAST(o_custkey % 5 AS INT) AS n_providers,
  CASE (o_orderkey + o_custkey) % 10 WHEN 0 THEN 'service_feature' WHEN 1 THEN 'vendor_addon' WHEN 2 THEN 'delivery_ops' WHEN 3 THEN 'sdlc'
    WHEN 4 THEN 'corporate_internal' WHEN 5 THEN 'relationship' WHEN 6 THEN 'affiliate_inferred' WHEN 7 THEN 'platform_supplier' WHEN 8 THEN 'unknown'
    ELSE 'commentary' END AS locus,
  CASE WHEN o_orderkey % 19 = 0 THEN 'not_ai' WHEN o_orderkey % 3 = 0 THEN 'genai_llm' ELSE 'predictive_ml' END AS ai_type,
  CASE WHEN o_orderkey % 5 = 0 THEN 'llm' ELSE 'rules' END AS method,
  CASE WHEN o_orderkey % 17 = 0 THEN 'rejected' WHEN o_orderkey % 4 = 0 THEN 'accepted' ELSE 'pending' END AS review,
  CASE WHEN o_orderkey % 11 = 0 THEN 'planned' ELSE 'in_production' END AS temporal,
  CAST(o_orderdate AS DATE) AS published, o_orderkey * 31 + o_custkey * 7 AS mask
FROM orders
"""

#: Codes present by divisibility, so that both engines can make the array or test a bit.
CODES = {"G1": 2, "G2": 3, "G3": 5, "G5": 7, "G6": 11, "M2": 4, "M3": 13, "M4": 6}

COVERAGE = """
SELECT o_custkey % 40 AS vendor_id, substring('LEGREGPRDJOBDNSIND', CAST(1 + 3 * (o_orderkey % 6) AS INT), 3) AS family,
  CASE ((o_custkey % 40) * 5 + (o_orderkey % 6) * 2 + (o_orderkey // 6) % 2) % 9 WHEN 0 THEN 'done' WHEN 1 THEN 'done_manual' WHEN 2 THEN 'not_applicable' WHEN 3 THEN 'stopped' WHEN 4 THEN 'pending'
    WHEN 5 THEN 'blocked_tou' WHEN 6 THEN 'blocked_bot' WHEN 7 THEN 'error' ELSE 'descoped' END AS status,
  o_orderkey % 9 AS requests, CAST(10 + o_custkey % 30 AS INT) AS cap, o_orderkey % 4 AS documents,
  substring('abcdefgh', CAST(1 + o_custkey % 8 AS INT), 1) AS collector
FROM orders
"""

PROFILES = """
SELECT c_custkey AS vendor_id, CAST(c_custkey % 5 AS INT) AS o, CAST((c_custkey // 3) % 5 AS INT) AS d, CAST((c_custkey // 7) % 5 AS INT) AS p,
  CAST((c_custkey // 11) % 5 AS INT) AS r, CAST((c_custkey // 2) % 5 AS INT) AS v, c_custkey % 23 = 0 AS d3p, c_custkey % 6 <> 0 AS registered,
  c_custkey % 8 AS missing, CAST(c_custkey % 4 AS INT) AS e, CAST((c_custkey // 4) % 4 AS INT) AS k, CAST((c_custkey // 5) % 4 AS INT) AS tier_points,
  CASE c_custkey % 5 WHEN 0 THEN 'Confirmed' WHEN 1 THEN 'Probable' WHEN 2 THEN 'Inconclusive' WHEN 3 THEN 'Affirmed' ELSE 'Not detected' END AS verdict,
  c_custkey % 9 = 0 AS x3, c_custkey % 14 = 0 AS x6,
  CASE c_custkey % 3 WHEN 0 THEN 'agentic' WHEN 1 THEN 'predictive_ml' ELSE 'aiops' END AS ai_type
FROM customer
"""


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the tables above: its SQL over the Parquet table it names."""
    name = re.search(r"\bFROM (\w+)", sql)[1]
    return spark.sql(re.sub(r"\bFROM \w+", "FROM {" + name + "}", sql).replace("//", "DIV"), **{name: read(spark, sf_dir, name)})


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array_compact(F.array(*[F.when(F.col("mask") % n == 0, F.lit(c)) for c, n in CODES.items()]))
    return derived(spark, sf_dir, ITEMS).withColumn("codes", codes)
