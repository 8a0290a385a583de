"""Independence, corroboration, and the verdict of a vendor from flags of its items and its coverage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.operators import folds, grading

_SAME = {"cluster": ["vendor_id", "cluster_id"], "outlet": ["vendor_id", "publisher", "family"], "both": ["vendor_id", "cluster_id", "publisher", "family"], "vendor": ["vendor_id"]}


def independent_count(items: DataFrame, of: Column, name: str) -> DataFrame:
    """items with `name`: how many items for which `of` holds are independent of each item.

    Independent is of another origin, and of another publisher or family. Counted by inclusion and exclusion from four small
    aggregates, so no pair of items is ever made. An item is of its own origin, so it never counts itself.
    """
    chosen = items.where(of)
    for label, keys in _SAME.items():
        sums = chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{label}"))
        items = items.join(sums, keys, "left")
    n = {label: F.coalesce(f"n_{label}", F.lit(0)) for label in _SAME}
    return items.withColumn(name, n["vendor"] - n["cluster"] - n["outlet"] + n["both"]).drop(*[f"n_{label}" for label in _SAME])


def corroboration(items: DataFrame) -> DataFrame:
    """vendor_id, item_key, n_corroborating: of each qualifying item, how many independent corroborating ones there are.

    Counts only; corroboration_classes has who they are, by class instead of by pair.
    """
    rows = independent_count(items, grading.corroborating(), "n_corroborating").where(grading.qualifying())
    return rows.where("n_corroborating > 0").select("vendor_id", "item_key", "n_corroborating")


def corroboration_classes(items: DataFrame) -> DataFrame:
    """vendor_id, cluster_id, publisher, family, n_q, n_k, best: items that cannot tell themselves apart when it comes to
    independence. Two items are independent if their classes differ in the cluster, and in the publisher or the family."""
    q, k = grading.qualifying(), grading.corroborating()
    return items.where(q | k).groupBy(*_SAME["both"]).agg(F.count_if(q).alias("n_q"), F.count_if(k).alias("n_k"), F.min("item_key").alias("best"))


def verdicts(items: DataFrame, coverage: DataFrame) -> DataFrame:
    """Per vendor: rule a to f, verdict, likelihood, confidence. coverage has vendor_id, complete.

    a conflict: a limiting statement on the exact service, dated no earlier than a qualifying item. b an exact qualifying item and
    an independent corroborating one. c any qualifying item, or two independent corroborating ones. d a limiting
    statement and neither. e complete coverage and nothing that points to use. f else.
    """
    own = items.where(grading.citable())
    own = independent_count(own, grading.corroborating(), "independent")
    a_sources = grading.corroborating() & (F.col("sr") == "A")
    own = independent_count(own, a_sources, "independent_a")
    q, k = grading.qualifying(), grading.corroborating()
    flags = own.groupBy("vendor_id").agg(
        F.bool_or(q).alias("any_q"),
        F.bool_or(k).alias("any_k"),
        F.bool_or(q & (F.col("rl") == 3) & (F.col("independent") > 0)).alias("confirmed"),
        F.bool_or(k & (F.col("independent") > 0)).alias("paired"),
        F.bool_or(a_sources & (F.col("independent_a") > 0)).alias("paired_a"),
        F.bool_or(grading.limiting(2)).alias("limited"),
        F.bool_or(grading.blocks_not_detected()).alias("signalled"),
        F.min(F.when(q, F.col("published"))).alias("first_q"),
        F.max(F.when(grading.limiting(3), F.col("published"))).alias("last_limit"),
        F.bool_or(k & F.col("sr").isin("A", "B") & (F.col("independent") > 0)).alias("strong_pair"),
        F.bool_or(k & F.col("sr").isin("A", "B")).alias("strong"),
        F.count_if(k & (F.col("sr") == "C")).alias("n_c"),
    )
    rows = coverage.join(flags, "vendor_id", "left")
    yes = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("any_q", "any_k", "confirmed", "paired", "paired_a", "limited", "signalled", "strong", "strong_pair")}
    rule = (
        F.when(F.coalesce(F.col("last_limit") >= F.col("first_q"), F.lit(False)), "a")
        .when(yes["confirmed"], "b")
        .when(yes["any_q"] | yes["paired"], "c")
        .when(yes["limited"] & ~yes["any_q"] & ~yes["any_k"], "d")
        .when(F.col("complete") & ~yes["signalled"], "e")
        .otherwise("f")
    )
    rows = rows.withColumn("rule", rule)
    names = {"a": "Inconclusive (conflict)", "b": "Yes (confirmed)", "c": "Yes (probable)", "d": "No (affirmed)", "e": "No (not detected)", "f": "Inconclusive"}
    verdict = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("rule")]
    likelihood = (
        F.when(F.col("rule") == "b", F.when(yes["paired_a"], "almost certain").otherwise("very likely"))
        .when(F.col("rule") == "c", "likely")
        .when(F.col("rule") == "d", "very unlikely")
        .when(F.col("rule") == "e", "unlikely")
        .otherwise(F.when(yes["signalled"], "roughly even chance").otherwise("unlikely"))
    )
    confidence = (
        F.when((F.col("rule") == "a") | ~F.col("complete"), "Low")
        .when(F.col("rule").isin("b", "c", "d") & yes["strong_pair"], "High")
        .when(yes["strong"] | (F.coalesce("n_c", F.lit(0)) >= 2) | (F.col("rule") == "e"), "Moderate")
        .otherwise("Low")
    )
    return rows.select("vendor_id", "rule", verdict.alias("verdict"), likelihood.alias("likelihood"), confidence.alias("confidence"))


def distinct_sources(items: DataFrame) -> DataFrame:
    """vendor_id, item_key, place: greedy independent sources of a vendor, best first; an item stays if it is independent of all
    that stay.

    Only the best item of each (cluster, publisher, family) can stay, so these are streamed, not all items. What stays has
    clusters of its own, and each pair another publisher or family, so an item is judged by two lookups.
    """
    best = Window.partitionBy("vendor_id", "cluster_id", "publisher", "family").orderBy(*grading.rank_order())
    few = items.where(grading.corroborating()).withColumn("nth", F.row_number().over(best)).where("nth = 1")

    def step(state: tuple[set, set], row: tuple) -> tuple | None:
        clusters, outlets = state
        key, cluster, publisher, family = row
        if cluster in clusters or (publisher, family) in outlets:
            return None
        clusters.add(cluster)
        outlets.add((publisher, family))
        return key, len(clusters)

    return folds.streamed(few, ["vendor_id"], grading.rank_order(), ["item_key", "cluster_id", "publisher", "family"], lambda: (set(), set()), step, ["item_key", "place"], [("long", pa.int64()), ("int", pa.int32())])
