"""Grades of evidence items: predicates, specificity, relevance, recency, credibility, strength and the rank of items.

Items have columns u (1-8), sr ('A'-'F'), sp, rl, rc (0-3), locus, ai_type, method, review, temporal, codes (array). Every
function is a column expression, so grading is one projection however many items there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the grading scheme.
STRENGTHS = (
    "Negative", "Strong", "Moderate", "Context - relationship only", "Context - platform supplier", "Context - inferred affiliate", "Marketing only", "Weak",
)
QUALIFYING_LOCI = ("service_feature", "vendor_addon", "delivery_ops", "sdlc")
LOCI = ("service_feature", "vendor_addon", "delivery_ops", "sdlc", "corporate_internal", "relationship", "affiliate_inferred", "platform_supplier", "unknown", "commentary")


def citable() -> Column:
    """Not rejected, not something else than AI, and no proposal that waits for its review."""
    return (F.col("review") != "rejected") & (F.col("ai_type") != "not_ai") & ~((F.col("method") == "llm") & (F.col("review") == "pending"))


def _use() -> Column:
    return (F.col("sp") >= 2) & (F.col("rl") >= 2) & (F.col("rc") >= 1) & (F.col("u") <= 4)


def qualifying() -> Column:
    return citable() & F.col("sr").isin("A", "B") & _use() & F.col("locus").isin(*QUALIFYING_LOCI)


def corroborating() -> Column:
    return citable() & F.col("sr").isin("A", "B", "C") & _use()


def blocks_not_detected() -> Column:
    return (F.col("sp") >= 1) & (F.col("rl") >= 2) & (F.col("rc") >= 1) & F.col("u").isin(1, 2, 3, 4, 7)


def may_decide() -> Column:
    return (F.col("rc") >= 1) & (F.col("rl") >= 1) & (F.col("locus") != "commentary") & ~F.col("sr").isin("E", "F")


def limiting(least_relevance: int) -> Column:
    """For the verdict; linking items takes relevance 3 and any recency: limiting_link."""
    return (F.col("u") == 8) & F.col("sr").isin("A", "B") & (F.col("rl") >= least_relevance) & (F.col("rc") >= 1)


def limiting_link() -> Column:
    return (F.col("u") == 8) & F.col("sr").isin("A", "B") & (F.col("rl") == 3)


def _any(*codes: str) -> Column:
    return F.arrays_overlap(F.col("codes"), F.array(*map(F.lit, codes)))


def specificity(named: Column, temporal: Column) -> Column:
    genuine = _any("G2", "G3", "G4", "G8", "G11")
    return (
        F.when((temporal == "planned") | (_any("M2", "M3") & ~genuine), 0)
        .when(_any("G1", "G5", "G6", "G7") & _any("G2", "G3"), 3)
        .when(_any("G2", "G4", "G5", "G8", "G11") & named & ~_any("M4"), 2)
        .otherwise(1)
    )


def relevance(service: Column, family: Column) -> Column:
    """From the locus, and whether terms of the service or of its family are named."""
    locus = F.col("locus")
    return (
        F.when(locus == "commentary", 0)
        .when(locus.isin("platform_supplier", "affiliate_inferred"), 1)
        .when(locus == "relationship", 2)
        .when(service & locus.isin("service_feature", "vendor_addon"), 3)
        .when(family | locus.isin("delivery_ops", "sdlc"), 2)
        .otherwise(1)
    )


def credibility(dns: Column) -> Column:
    return F.when(dns, 2).when((F.col("rc") == 0) | F.col("sr").isin("E", "F"), 6).when(F.col("sp") <= 1, 3).when(F.col("sr").isin("C", "D"), 4).otherwise(2)


def strength() -> Column:
    return (
        F.when(F.col("u") == 8, STRENGTHS[0])
        .when(qualifying() & (F.col("rl") == 3), STRENGTHS[1])
        .when(qualifying() | corroborating(), STRENGTHS[2])
        .when(F.col("locus") == "relationship", STRENGTHS[3])
        .when(F.col("locus") == "platform_supplier", STRENGTHS[4])
        .when(F.col("locus") == "affiliate_inferred", STRENGTHS[5])
        .when((F.col("u") == 7) | (F.col("sp") == 0), STRENGTHS[6])
        .otherwise(STRENGTHS[7])
    )


def position(value: Column, order: tuple[str, ...]) -> Column:
    """Place in a fixed order, from 0."""
    return F.array_position(F.array(*map(F.lit, order)), value).cast("int") - 1


def rank_order() -> list[Column]:
    """Best first: strength, source, relevance, recency, class, locus, specificity, genuine codes, providers, key."""
    genuine = F.size(F.array_distinct(F.filter("codes", lambda c: c.startswith("G"))))
    return [
        position(strength(), STRENGTHS), F.col("sr"), F.desc("rl"), F.desc("rc"), F.col("u"), position(F.col("locus"), LOCI),
        F.desc("sp"), genuine.desc(), F.desc("n_providers"), F.col("item_key"),
    ]


def tag_string() -> Column:
    return F.concat_ws(
        " · ", F.concat(F.lit("U"), "u"), F.concat(F.lit("SR:"), "sr"), F.concat(F.lit("SP:S"), "sp"), F.concat(F.lit("RL:R"), "rl"), F.concat(F.lit("RC:T"), "rc"),
        F.concat(F.lit("locus="), "locus"),
    )


def graded(items: DataFrame) -> DataFrame:
    flags = {"citable": citable(), "is_q": qualifying(), "is_k": corroborating(), "blocks": blocks_not_detected(), "decides": may_decide(), "limits2": limiting(2), "limits3": limiting(3)}
    return items.withColumns(flags | {"strength": strength()})


def best_per_cluster(items: DataFrame, most: int, prefer: Column | None = None) -> DataFrame:
    """The best item of each origin, preferred ones first, and the best `most` of a vendor. Two windows; the first deals by vendor
    and cluster, so a large vendor's items are ranked in parts before its few winners meet."""
    first = [] if prefer is None else [F.when(F.coalesce(prefer, F.lit(False)), 0).otherwise(1)]
    order = rank_order()
    own = Window.partitionBy("vendor_id", "cluster_id").orderBy(*first, *order)
    firsts = items.where(citable()).withColumn("place", F.row_number().over(own)).where("place = 1").drop("place")
    return firsts.withColumn("place", F.row_number().over(Window.partitionBy("vendor_id").orderBy(*order))).where(F.col("place") <= most)


#: Roles in the order of the evidence log.
ROLES = ("Primary", "Supporting", "Indicator", "Counter-evidence", "Negative", "Context", "Logged")


def evidence_ids(items: DataFrame) -> DataFrame:
    """V-E-0001 and so on, in the order of role, strength, source, relevance, recency, url, start and key.

    Numbered in slices of a vendor, one for each value of the leading keys, whose sizes are summed up before: no vendor's items are
    sorted in one task unless all are alike in these. Items without a role count as logged.
    """
    role = F.coalesce(position(F.col("role"), ROLES), F.lit(len(ROLES) - 1))
    slices = ["vendor_id", "slice"]
    rows = items.withColumn("slice", F.struct(role.alias("a"), position(strength(), STRENGTHS).alias("b"), F.col("sr").alias("c"), (-F.col("rl")).alias("d"), (-F.col("rc")).alias("e")))
    sizes = rows.groupBy(*slices).agg(F.count(F.lit(1)).alias("in_slice"))
    before = Window.partitionBy("vendor_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("base", F.coalesce(F.sum("in_slice").over(before), F.lit(0))).drop("in_slice")
    nth = F.row_number().over(Window.partitionBy(*slices).orderBy("url", "start", "item_key"))
    numbered = rows.withColumn("nth", nth).join(sizes, slices)
    number = F.lpad((F.col("base") + F.col("nth")).cast("string"), 4, "0")
    return numbered.withColumn("evidence_id", F.concat(F.lit("V"), F.col("vendor_id").cast("string"), F.lit("-E-"), number)).drop("slice", "nth", "base")


def top_scored(items: DataFrame, points: Column, key: list[str], order: list[Column], most: int) -> DataFrame:
    """The `most` rows of a key with most points, those without any left out; ties in the given order."""
    rows = items.withColumn("points", points).where("points > 0")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("points"), *order))).where(F.col("nth") <= most).drop("nth")


def newest_first(rows: DataFrame, key: list[str], day: str, order: list[str], most: int) -> DataFrame:
    """The newest rows of a key, undated ones last, at most so many."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc_nulls_last(day), *order))
    return rows.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")
