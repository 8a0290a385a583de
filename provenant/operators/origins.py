"""Origins: which items repeat one source, the clusters that follow, and what repetition and contradiction do to an item."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.functions import expressions as E
from provenant.functions import udfs
from provenant.operators import folds, grading, verdict
from provenant.operators.components import components

#: The likeness (0 to 100) from which two excerpts are one, and the order of methods for duplicates.
LIKE = 90.0
METHODS = ("manual", "rules", "llm")
#: Excerpts are compared if they share this part of the words of the one that has fewer.
SHARED = 0.5


def origin_keys() -> Column:
    """What an item's origin is known by. A DNS record is one origin per provider or record, never per page; other items are of one
    origin if they share the document, the page or a title's words."""
    known = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}:"), value))
    titles = F.transform(F.coalesce(E.title_keys(F.col("title")), F.array().cast("array<string>")), lambda t: F.concat(F.lit("title:"), t))
    own = F.concat(F.array(known("doc", F.col("doc_id").cast("string")), known("page", E.page_key(F.col("url")))), titles)
    return F.array_compact(F.when(F.coalesce("dns", F.lit("")) != "", F.array(known("dns", F.col("dns")))).otherwise(own))


def equal_links(items: DataFrame) -> DataFrame:
    """vendor_id, key, a, b: each item of a key, and the key's smallest item; a star, so a key's items cost one row each."""
    keyed = items.select("vendor_id", "item_key", F.explode(origin_keys()).alias("key")).distinct()
    least = keyed.groupBy("vendor_id", "key").agg(F.min("item_key").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return keyed.join(least, ["vendor_id", "key"]).where("item_key <> b").select("vendor_id", "key", F.col("item_key").alias("a"), "b")


def _words() -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower("excerpt"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def similar_links(items: DataFrame, like: float = LIKE, shared: float = SHARED) -> DataFrame:
    """vendor_id, a, b: items of a vendor whose excerpts' token set ratio is at least `like`; DNS records are not compared.

    Words are ordered by how many of the vendor's items have them. A pair that shares the part `shared` of the shorter one's words
    has one of that one's first words in common, so what a whole vendor repeats makes no pairs. Excerpts that share fewer are not
    compared; equal excerpts are one. Null and wordless excerpts are like nothing.
    """
    rows = items.where("coalesce(dns, '') = ''").groupBy("vendor_id", F.lower("excerpt").alias("excerpt")).agg(F.min("item_key").alias("item_key"))
    rows = rows.select("vendor_id", "item_key", "excerpt", _words().alias("words")).where(F.size("words") > 0)
    held = rows.select("vendor_id", "item_key", F.size("words").alias("n"), F.explode("words").alias("word"))
    often = held.groupBy("vendor_id", "word").agg(F.count(F.lit(1)).alias("items")).where("items > 1")
    held = held.join(often, ["vendor_id", "word"])
    by_item = Window.partitionBy("vendor_id", "item_key").orderBy("items", "word")
    alone = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("vendor_id", "item_key"))  # words that no other item has come first
    held = held.withColumn("place", alone + F.row_number().over(by_item))
    first = held.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * shared) + 1).alias("x")
    other = held.alias("y")
    smaller = (F.col("x.n") < F.col("y.n")) | (F.col("x.n") == F.col("y.n")) & (F.col("x.item_key") < F.col("y.item_key"))
    met = first.join(other, (F.col("x.vendor_id") == F.col("y.vendor_id")) & (F.col("x.word") == F.col("y.word")) & smaller)
    met = met.select(F.col("x.vendor_id").alias("vendor_id"), F.col("x.item_key").alias("a"), F.col("y.item_key").alias("b")).distinct()
    one, two = (rows.select("vendor_id", F.col("item_key").alias(k), F.col("excerpt").alias(f"{k}_excerpt")) for k in "ab")
    both = met.join(one, ["vendor_id", "a"]).join(two, ["vendor_id", "b"])
    return both.where(udfs.set_ratio("a_excerpt", "b_excerpt") >= like).select("vendor_id", "a", "b")


def clustered(items: DataFrame, like: float = LIKE) -> DataFrame:
    """Items (vendor_id, item_key, doc_id, url, title, excerpt, dns) with cluster_id: the smallest item key, as text of at most twelve
    characters, that links of one origin reach. Items of different vendors never share one, though the text may be equal."""
    same = Window.partitionBy("vendor_id", F.lower("excerpt"))
    equal = items.where("coalesce(dns, '') = '' AND coalesce(excerpt, '') <> ''").withColumn("b", F.min("item_key").over(same)).where("item_key <> b")
    links = equal_links(items).select("vendor_id", "a", "b").union(similar_links(items, like)).union(equal.select("vendor_id", "item_key", "b"))
    node = lambda c: F.struct("vendor_id", F.col(c).alias("item_key"))
    reached = components(links.select(node("a").alias("a"), node("b").alias("b")))
    roots = reached.select(F.col("node.vendor_id").alias("vendor_id"), F.col("node.item_key").alias("item_key"), F.col("root.item_key").alias("root_key"))
    out = items.join(roots, ["vendor_id", "item_key"], "left")
    return out.withColumn("cluster_id", F.substring(F.coalesce("root_key", "item_key").cast("string"), 1, 12)).drop("root_key")


def dedupe(items: DataFrame) -> DataFrame:
    """vendor_id, item_key, doc_id, start, kept: best first (citable, strength, method, longer excerpt, key) an item stays unless one
    that stays has its key, or overlaps it in the same document of the vendor. Repeated rows: the first stays."""
    method = F.coalesce(grading.position(F.col("method"), METHODS), F.lit(len(METHODS)))
    ranked = items.withColumn("strength_rank", grading.position(grading.strength(), grading.STRENGTHS))
    order = [F.when(grading.citable(), 0).otherwise(1), F.col("strength_rank"), method, (F.col("end") - F.col("start")).desc(), F.col("item_key"), F.col("doc_id"), F.col("start")]

    def step(state: tuple[set, dict], row: tuple) -> tuple:
        keys, spans = state
        key, doc, start, end = row
        own = spans.setdefault(doc, ([], []))  # starts and ends of disjoint spans, both ascending
        at = bisect_left(own[1], start + 1)
        if key in keys or at < len(own[0]) and own[0][at] < end:
            return key, doc, start, False
        keys.add(key)
        own[0].insert(at, start)
        own[1].insert(at, end)
        return key, doc, start, True

    longs = [("long", pa.int64())] * 2
    cast = ranked.withColumns({c: F.col(c).cast("long") for c in ("doc_id", "start", "end")})
    key_type = ("long", pa.int64()) if items.schema["item_key"].dataType.simpleString() in ("bigint", "int") else ("string", pa.string())
    return folds.streamed(cast, ["vendor_id"], order, ["item_key", "doc_id", "start", "end"], lambda: (set(), {}), step, ["item_key", "doc_id", "start", "kept"], [key_type, *longs, ("boolean", pa.bool_())])


def marked(items: DataFrame, initial: Column) -> DataFrame:
    """Items with ic: 5 if a limiting statement of the vendor is as late as this use, else 1 if an independent item corroborates it,
    else `initial`. Counted from aggregates, so no pair of items is made."""
    limits = items.where(grading.citable() & grading.limiting_link()).groupBy("vendor_id").agg(F.max("published").alias("last_limit"))
    rows = verdict.independent_count(items, grading.corroborating(), "backed").join(limits, "vendor_id", "left")
    target = grading.corroborating() | grading.qualifying()
    against = (F.col("u") <= 4) & F.coalesce(F.col("last_limit") >= F.col("published"), F.lit(False))
    return rows.withColumn("ic", F.when(against, 5).when(target & (F.col("backed") > 0), 1).otherwise(initial)).drop("backed", "last_limit")
