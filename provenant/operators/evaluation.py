"""Evaluation against labels and excerpts, agreement, histograms, guards."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions import expressions as E


def confusion(rows: DataFrame, expected: str, found: str) -> DataFrame:
    return rows.groupBy(F.col(expected).alias("expected"), F.col(found).alias("found")).agg(F.count(F.lit(1)).alias("n"))


def agreement(rows: DataFrame, one: Column, other: Column, by: str) -> DataFrame:
    """by -> n, agree, percent."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(one == other).alias("agree"), F.round(100.0 * F.count_if(one == other) / F.count(F.lit(1)), 1).alias("percent"))


def excerpt_hits(docs: DataFrame, excerpts: DataFrame, n: int = 6) -> DataFrame:
    """item_id, doc_id: documents that contain an excerpt verbatim.

    Documents and excerpts meet on the first run of n of the excerpt's inner words, by equality, and only what meets is compared
    whole; one pass over the documents gives the runs of all lengths. Inner words are whole words of a document that has the excerpt; the first and the last can be parts of words.
    Shorter runs meet on all inner words; excerpts of one or two words, or none, are compared with every document.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[^\s]+"), F.lit(0))
    probe = excerpts.where("text IS NOT NULL").select("item_id", F.col("text").alias("excerpt"), words.alias("words"))
    short = probe.where(F.size("words") < 3).select("item_id", "excerpt")
    probe = probe.where(F.size("words") >= 3).withColumn("words", F.expr("slice(words, 2, size(words) - 2)"))
    sizes = [r[0] for r in probe.select(F.least(F.size("words"), F.lit(n)).alias("n")).distinct().collect()]  # at most n values
    hits = short.join(docs.select("doc_id", "text"), F.contains("text", "excerpt")).select("item_id", "doc_id")
    if not sizes:
        return hits
    inner = probe.select("item_id", "excerpt", F.xxhash64(F.array_join(F.slice("words", 1, n), " ")).alias("probe_hash"))

    def runs(size: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
        return F.when(F.size("words") >= size, F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice("words", i, size), " ")))).otherwise(F.array().cast("array<bigint>"))

    body = docs.select("doc_id", words.alias("words"))
    own = body.select("doc_id", F.explode(F.array_distinct(F.concat(*[runs(size) for size in sorted(sizes)]))).alias("probe_hash"))
    met = own.join(inner, "probe_hash").select("item_id", "doc_id", "excerpt").distinct()
    return hits.union(met.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "excerpt")).select("item_id", "doc_id"))


def recall(excerpts: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: excerpts, located, percent."""
    found = hits.select("item_id").distinct().withColumn("hit", F.lit(1))
    rows = excerpts.select("item_id").join(found, "item_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("located"), F.round(100.0 * F.count("hit") / F.count(F.lit(1)), 1).alias("percent"))


def blocked_shingles(texts: DataFrame, blocklist: DataFrame, n: int) -> DataFrame:
    """doc_id, n_blocked: how many of a text's word shingles are on the list; an equality join on shingles."""
    listed = blocklist.select(F.explode(E.word_shingles(F.col("text"), n)).alias("shingle")).distinct()
    own = texts.select("doc_id", F.explode(E.word_shingles(F.col("text"), n)).alias("shingle"))
    return own.join(listed, "shingle").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocked"))


def guard(rows: DataFrame, host_allowed: Column, hard: Column | None = None, team: str | None = None) -> DataFrame:
    """Rows with the first reason to withhold them, or null: a hard block (a column), the team's name, a secret, e-mail, a shingle or
    short whole value of the blocklist (n_blocked, n_whole), a volume phrase (n_volume), the host. Counts that rows lack are 0."""
    has = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0 if c in rows.columns else F.lit(False)
    secret = F.lit(False)
    for pattern in E.SECRETS.values():
        secret = secret | F.col("text").rlike(pattern)
    named = F.col("text").rlike(rf"(?i)(?<![\p{{L}}\p{{N}}]){re.escape(team)}(?![\p{{L}}\p{{N}}])") if team else F.lit(False)
    reason = F.when(hard if hard is not None else F.lit(False), "hard").when(named, "team").when(secret, "secret").when(F.col("text").rlike(E.EMAIL), "email").when(has("n_blocked"), "shingle").when(has("n_whole"), "whole").when(has("n_volume"), "volume").when(~host_allowed, "host")
    return rows.withColumn("reason", reason)


def blocked_wholes(texts: DataFrame, values: DataFrame, least: int = 4, most: int = 5) -> DataFrame:
    """doc_id, n_whole: how many listed values of `least` to `most` words a text has as a run of words. Shorter values never block,
    longer ones do by their shingles. One pass: runs of each length meet the values by equality."""
    found = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0))
    listed = values.select(found("text").alias("w")).where(F.size("w").between(least, most)).select(F.array_join("w", " ").alias("run")).distinct()
    runs = F.concat(*[E.word_shingles(F.col("text"), n) for n in range(least, most + 1)])
    return texts.select("doc_id", F.explode(runs).alias("run")).join(listed, "run").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_whole"))


def audit_violations(log: DataFrame, models: list[str], hosts: list[str]) -> DataFrame:
    """Log rows that may not leave: an unknown model or host, text in the log, or no status. Must be empty to release."""
    found = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("model").isin(*models), F.lit(False)), "model"),
        F.when(~F.coalesce(F.col("host").isin(*hosts), F.lit(False)), "host"),
        F.when(F.length(F.coalesce("payload", F.lit(""))) > 0, "text"),
        F.when(F.col("status").isNull(), "status"),
    ))
    return log.withColumn("violations", found).where(F.size("violations") > 0)


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """sha, n, first: texts that occur more than once."""
    return docs.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")
