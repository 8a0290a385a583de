"""Verification of quotes against texts: locating, gates, re-verification of stored items, merging of proposals."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenant.functions import text
from provenant.functions import expressions as E
from provenant.operators import spans

LEAST, MOST = 25, 600


def check(quote: str, body: str, names: list[str], indicators: list[str]) -> tuple[list[str], int, int, list[str], list[str]]:
    """(failed gates, start, end, names found, indicators found).

    V2 the quote can't be located, V3 it has an ellipsis or an odd length, V4 an indicator's words, V5 a name isn't in it.
    Only V2 and V3 block; what V4 and V5 miss is taken out.
    """
    failed = []
    found = text.locate(quote, body)
    if not found:
        failed.append("V2")
    if "..." in quote or "…" in quote or not LEAST <= len(quote) <= MOST:
        failed.append("V3")
    excerpt = body[slice(*found)] if found else ""
    kept_names = [n for n in names if text.has_name(n, excerpt)]
    kept = [i for i in indicators if text.fold(i) in text.fold(excerpt)]
    if len(kept) < len(indicators):
        failed.append("V4")
    if len(kept_names) < len(names):
        failed.append("V5")
    start, end = found or (-1, -1)
    return failed, start, end, kept_names, kept


def verify(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """claim_id, doc_id, quote, names, indicators met with their documents -> gates, span, what is kept, ok.

    V1: a document that isn't there. V9: of equal spans of a document the smallest claim_id stays.
    """
    rows = claims.join(docs.select("doc_id", F.col("text").alias("body")), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for claim, doc, quote, names, codes, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append((claim, doc, *((["V1"], -1, -1, [], []) if body is None else check(quote or "", body, names or [], codes or []))))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())]
            columns = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["claim_id", "doc_id", "failures", "start", "end", "names", "indicators"])

    checked = rows.select("claim_id", "doc_id", "quote", "names", "indicators", "body").mapInArrow(run, "claim_id long, doc_id long, failures array<string>, start int, end int, names array<string>, indicators array<string>")
    same = Window.partitionBy("doc_id", "start", "end").orderBy("claim_id")
    again = (F.row_number().over(same) > 1) & (F.col("start") >= 0)
    checked = checked.withColumn("failures", F.when(again, F.concat("failures", F.array(F.lit("V9")))).otherwise(F.col("failures")))
    return checked.withColumn("ok", ~F.arrays_overlap("failures", F.array(*map(F.lit, ("V1", "V2", "V3", "V9")))))


def reverify(items: DataFrame, docs: DataFrame) -> DataFrame:
    """item_key, url, doc_id, start, end, excerpt, text_sha -> problems of stored items against the texts they cite."""
    rows = items.join(docs.select("doc_id", F.col("text").alias("body")), "doc_id", "left")
    cut = F.expr("substring(body, start + 1, end - start)")
    found = F.array_compact(F.array(
        F.when(F.col("body").isNull(), "document"),
        F.when(F.sha2("body", 256) != F.col("text_sha"), "text"),
        F.when(cut != F.col("excerpt"), "slice"),
        F.when(E.item_key(F.col("url"), F.col("excerpt")) != F.col("item_key"), "key"),
    ))
    return rows.select("item_key", "doc_id", found.alias("problems"))


def merge(proposals: DataFrame, items: DataFrame) -> DataFrame:
    """proposal id -> item id that absorbs it (the one that shares most), or null: it stays a proposal of its own."""
    best = spans.best_overlap(spans.overlaps(proposals, items))
    return proposals.select(F.col("id").alias("left_id")).join(best, "left_id", "left").select(F.col("left_id").alias("proposal_id"), F.col("right_id").alias("item_id"))


def fuzzy_recall(excerpts: DataFrame, docs: DataFrame, least: float = 90.0) -> DataFrame:
    """item_id, doc_id, excerpt -> how it is found in its document (exact, anchors, fuzzy, null) and how well."""
    rows = excerpts.join(docs.select("doc_id", "text"), "doc_id").withColumn("exact", F.contains("text", "excerpt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, how, score = [], [], []
            for item, excerpt, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = text.locate_excerpt(excerpt, body, least)
                ids.append(item)
                how.append(found and found[0])
                score.append(found and found[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(how, pa.string()), pa.array(score, pa.float64())], ["item_id", "how", "score"])

    exact = rows.where("exact").select("item_id", F.lit("exact").alias("how"), F.lit(100.0).alias("score"))  # only misses reach Python
    return exact.union(rows.where("NOT exact").select("item_id", "excerpt", "text").mapInArrow(run, "item_id long, how string, score double"))


def gates(checked: DataFrame, subjects: DataFrame, sent: DataFrame) -> DataFrame:
    """What verify found, with the gates that need other tables: V6, a claim on another party (subjects: doc_id, vendor_id, corroborated)
    and V7, a claim on a passage that was not sent (sent: claim_id). Both block. Documents without a subject row are of no known party."""
    known = subjects.groupBy("doc_id").agg(F.bool_or("corroborated").alias("ours"))
    was = sent.select("claim_id").distinct().withColumn("was_sent", F.lit(True))
    rows = checked.join(known, "doc_id", "left").join(was, "claim_id", "left")
    more = F.array_compact(F.array(F.when(~F.coalesce("ours", F.lit(False)), "V6"), F.when(F.col("was_sent").isNull(), "V7")))
    return rows.withColumn("failures", F.concat("failures", more)).withColumn("ok", F.col("ok") & (F.size(more) == 0)).drop("ours", "was_sent")


def absorbed(proposals: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """id, method, review, rule_labels, llm_labels, differing: items with the labels of the best proposal that they absorb kept beside
    their own, and proposals that no item absorbs, which wait for a review. Rows have id, doc_id, start, end, labels (map)."""
    best = spans.best_overlap(spans.overlaps(proposals, items))
    told = best.join(proposals.select(F.col("id").alias("left_id"), F.col("labels").alias("llm_labels")), "left_id")
    taken = told.groupBy("right_id").agg(F.max_by("llm_labels", F.struct("shared", -F.col("left_id"))).alias("llm_labels"))
    none = F.create_map().cast("map<string,string>")
    own = items.join(taken, F.col("id") == F.col("right_id"), "left").select("id", F.lit("rules").alias("method"), F.lit("accepted").alias("review"), F.col("labels").alias("rule_labels"), F.coalesce("llm_labels", none).alias("llm_labels"))
    loose = proposals.join(best.select(F.col("left_id").alias("id")), "id", "left_anti").select("id", F.lit("llm").alias("method"), F.lit("pending").alias("review"), none.alias("rule_labels"), F.col("labels").alias("llm_labels"))
    return own.union(loose).withColumn("differing", E.disagreements(F.col("rule_labels"), F.col("llm_labels"), keys))
