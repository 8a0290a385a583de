"""Spans of texts: overlap joins by bins, merging, greedy keeping, headings, sentences with their neighbours."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.functions import text, udfs
from provenant.operators import folds

#: Characters of a bin: spans meet in the bins they touch.
BIN = 1024


def _binned(spans: DataFrame) -> DataFrame:
    last = F.greatest(F.col("start"), F.col("end") - 1)
    return spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor(last / BIN))))


def overlaps(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs (left_id, right_id, shared characters) of spans of one text that overlap; spans have id, key, start, end.

    An equality join on text and bin, so a long text is dealt to many tasks; a pair counts in the first bin both touch.
    """
    a, b = _binned(left).alias("a"), _binned(right).alias("b")
    first = F.floor(F.greatest("a.start", "b.start") / BIN)
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.bin") == F.col("b.bin")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")) & (F.col("a.bin") == first)
    shared = F.least("a.end", "b.end") - F.greatest("a.start", "b.start")
    return a.join(b, on).select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), shared.alias("shared"))


def best_overlap(pairs: DataFrame) -> DataFrame:
    """Of each left span, the right one that shares most, the smallest id of equals."""
    return pairs.groupBy("left_id").agg(F.max_by(F.struct("right_id", "shared"), F.struct("shared", -F.col("right_id"))).alias("best")).select("left_id", "best.*")


def islands(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans of a text that overlap or touch, as one: key, start, end, n."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("opens", F.when(reached.isNull() | (F.col("start") > reached), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("island")


def keep_greedily(spans: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Best first, a span stays if it overlaps none that stays: each text's ranked spans are streamed past those that stay."""

    def step(state: tuple[list, list], row: tuple) -> tuple | None:
        starts, ends = state  # of disjoint spans, both ascending
        number, start, end = row
        at = bisect_left(ends, start + 1)
        if at < len(starts) and starts[at] < end:
            return None
        starts.insert(at, start)
        ends.insert(at, end)
        return number, start, end

    longs = [("long", pa.int64())] * 3
    cast = spans.withColumns({c: F.col(c).cast("long") for c in ("id", "start", "end")})
    return folds.streamed(cast, [key], order, ["id", "start", "end"], lambda: ([], []), step, ["id", "start", "end"], longs)


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, ordinal, start, end, sentence."""
    return udfs.spans(docs, lambda t: [(a, b, t[a:b]) for a, b in text.sentences(t)], "start int, end int, sentence string", ["start", "end", "sentence"])


def in_context(rows: DataFrame) -> DataFrame:
    """Sentences with the one before and after."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    return rows.withColumn("before", F.lag("sentence").over(w)).withColumn("after", F.lead("sentence").over(w))


def passages(docs: DataFrame, terms: Sequence[str], suppress: Sequence[str] = (), most: int = 700, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, ordinal, start, end, passage, hits: sentences with a term, their neighbours, merged up to `most` characters.

    Columns to carry come along. Suppressed phrases are masked first. A cheap pattern in the JVM keeps texts without any term from Python.
    """
    whole = "|".join(sorted(r"\s+".join(map(re.escape, t.lower().split())) for t in terms if t.split()))
    likely = docs.where(F.lower("text").rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{whole})")) if whole else docs.where("false")
    terms, suppress = list(terms), list(suppress)

    def find(body: str) -> list[tuple]:
        pattern, masked = text.phrase_pattern(terms), text.mask(body, suppress) if suppress else body
        parts = text.sentences(body)
        out: list[list] = []
        for i, (a, b) in enumerate(parts):
            hits = sorted({m[0].lower() for m in pattern.finditer(masked, a, b)})
            if not hits:
                continue
            start, end = parts[max(0, i - 1)][0], parts[min(len(parts) - 1, i + 1)][1]
            if end - start > most:
                start, end = a, min(b, a + most)
            if out and start <= out[-1][1] and max(end, out[-1][1]) - out[-1][0] <= most:
                out[-1][1], out[-1][2] = max(end, out[-1][1]), sorted({*out[-1][2], *hits})
            else:
                out.append([max(start, out[-1][1] if out else 0) if a >= (out[-1][1] if out else 0) else a, end, hits])
        return [(a, b, body[a:b], hits) for a, b, hits in out if b > a]

    return udfs.spans(likely, find, "start int, end int, passage string, hits array<string>", ["start", "end", "passage", "hits"], carry=carry)


def with_heading(hits: DataFrame, lines: DataFrame, reach: int = 3000, longest: int = 140) -> DataFrame:
    """Hits (id, doc_id, start) with the nearest heading above them: the last line of that shape, of at most so many characters, that
    ends before the hit's line and begins within reach of it; null without one.

    lines: doc_id, start, end, line, shape. Hits and headings of a document are ordered together once; no pair of them is made.
    """
    own = lines.where((F.col("shape") == "heading") & (F.length(F.trim("line")) <= longest)).select("doc_id", F.col("end").cast("long").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.struct(F.col("start").cast("long").alias("start"), F.trim("line").alias("line")).alias("heading"))
    asked = hits.select("doc_id", F.col("start").cast("long").alias("at"), F.lit(1).alias("kind"), F.col("id").cast("long"), F.lit(None).cast("struct<start: bigint, line: string>").alias("heading"))
    above = Window.partitionBy("doc_id").orderBy("at", "kind", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = own.unionByName(asked).withColumn("last", F.last("heading", ignorenulls=True).over(above)).where("kind = 1")
    near = F.col("at") - F.col("last.start") <= reach
    return rows.select("id", "doc_id", F.col("at").alias("start"), F.when(near, F.col("last.line")).alias("heading"))


def traced(passages: DataFrame, docs: DataFrame, captures: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Passages with their document, capture and text; and those that miss one of them, with what is missing first.

    passages: doc_id and more; docs: doc_id, capture_id, text_sha; captures: capture_id and more; texts: text_sha, text.
    """
    mark = lambda df, name: df.withColumn(f"has_{name}", F.lit(True))
    rows = passages.join(mark(docs, "doc"), "doc_id", "left").join(mark(captures, "capture"), "capture_id", "left").join(mark(texts, "text"), "text_sha", "left")
    missing = F.when(F.col("has_doc").isNull(), "document").when(F.col("has_capture").isNull(), "capture").when(F.col("has_text").isNull(), "text")
    rows = rows.withColumn("missing", missing).drop("has_doc", "has_capture", "has_text")
    return rows.where("missing IS NULL").drop("missing"), rows.where("missing IS NOT NULL").select(*passages.columns, "missing")
