"""Criticality, depth plans, risk and actions: scores, floors, tiers, what-if sweeps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions.storage import small

# Fixed values of the scoring scheme.
WEIGHTS = {"o": 7, "d": 6, "p": 5, "r": 4, "v": 3}
TIERS = ("Low", "Medium", "High", "Critical")
CLASSES = ("Low", "Medium", "High", "Critical")
FAMILIES = ("LEG", "REG", "PRD", "JOB", "DNS", "IND", "HIST", "EXEC")
#: Request caps by family in the order above; null: not searched. Then discretionary requests, calls, saturation.
DEPTH = {
    "Critical": ((40, 80, 150, 120, 40, 30, 30, 0), 100, 40, 10),
    "High": ((40, 40, 100, 60, 40, 20, 0, 0), 50, 20, 6),
    "Medium": ((15, 5, 20, 15, 20, None, None, None), 0, 6, 4),
    "Low": ((3, None, 1, None, 10, None, None, None), 0, 2, 3),
}
OPTIONAL = {"Critical": {"EXEC"}, "High": {"HIST", "EXEC"}, "Medium": {"IND", "HIST", "EXEC"}, "Low": {"REG", "JOB", "IND", "HIST", "EXEC"}}


def score(level: Mapping[str, Column], weights: Mapping[str, int] = WEIGHTS) -> Column:
    """The weighted sum of factor levels, 0 to 100 with the fixed weights."""
    total = F.lit(0)
    for factor, weight in weights.items():
        total = total + level[factor] * weight
    return total


def tier_rank(points: Column, level: Mapping[str, Column], d3p: Column) -> Column:
    """0 to 3: by score at 25, 50 and 80, raised by the floors that fire."""
    by_score = F.when(points >= 80, 3).when(points >= 50, 2).when(points >= 25, 1).otherwise(0)
    o, d, p, v = (level[x] for x in "odpv")
    floor = lambda fires, rank: F.when(fires, rank).otherwise(0)
    return F.greatest(
        by_score, floor(o >= 4, 3), floor((p >= 3) & (o >= 3), 3), floor((d >= 4) & (v >= 3), 2), floor(d3p, 2), floor(d >= 3, 1),
        floor((d >= 4) & (v >= 3) & (o >= 3), 3),
    )


def named(rank: Column, names: Sequence[str] = TIERS) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), rank + 1)


def criticality(profiles: DataFrame) -> DataFrame:
    """Columns o, d, p, r, v (levels) and d3p -> score and tier."""
    level = {x: F.col(x) for x in WEIGHTS}
    points = score(level)
    return profiles.withColumn("score", points).withColumn("tier", named(tier_rank(points, level, F.col("d3p"))))


def sensitivity(profiles: DataFrame, key: str) -> DataFrame:
    """key, variants, stable: rescored with each factor a level up and down, and each weight one more and less.

    The variants are a constant array, so this is a projection and no join. A moved data factor loses its special anchor.
    """
    variants = []
    for factor in WEIGHTS:
        for step in (-1, 1):
            moved = {x: F.least(F.greatest(F.col(x) + step, F.lit(0)), F.lit(4)) if x == factor else F.col(x) for x in WEIGHTS}
            variants.append(tier_rank(score(moved), moved, F.col("d3p") & F.lit(factor != "d")))
            level = {x: F.col(x) for x in WEIGHTS}
            variants.append(tier_rank(score(level, WEIGHTS | {factor: WEIGHTS[factor] + step}), level, F.col("d3p")))
    level = {x: F.col(x) for x in WEIGHTS}
    base = tier_rank(score(level), level, F.col("d3p"))
    rows = profiles.select(key, base.alias("base"), F.array(*variants).alias("ranks"))
    return rows.select(key, named(F.col("base")).alias("tier"), F.size("ranks").alias("variants"), F.size(F.filter("ranks", lambda x: x != F.col("base"))).alias("changed"), F.forall("ranks", lambda x: x == F.col("base")).alias("stable"))


def depth_plan(vendors: DataFrame) -> DataFrame:
    """vendor_id, tier, d, d3p, registered -> a row per family: mandatory, cap. Modifiers raise caps to the deepest tier's.

    D4 below the highest tier deepens LEG and HIST; the special anchor IND; a vendor known not to be registered has LEG and
    HIST deepened in place of REG.
    """
    spark = vendors.sparkSession
    policy = [(t, f, f not in OPTIONAL[t], caps[i], DEPTH["Critical"][0][i]) for t, (caps, *_) in DEPTH.items() for i, f in enumerate(FAMILIES)]
    table = spark.createDataFrame(policy, "tier string, family string, mandatory boolean, cap int, deepest int")
    rows = vendors.join(small(table), "tier")  # a row per tier and family
    replaced = ~F.col("registered") & F.col("mandatory") & (F.col("family") == "REG")
    no_reg = ~F.col("registered") & F.col("tier").isin("Critical", "High", "Medium")
    raised = (
        ((F.col("d") >= 4) & (F.col("tier") != "Critical") & F.col("family").isin("LEG", "HIST"))
        | (F.col("d3p") & (F.col("family") == "IND"))
        | (no_reg & F.col("family").isin("LEG", "HIST"))
    )
    cap = F.when(replaced, F.lit(None)).when(raised, F.greatest(F.coalesce("cap", F.lit(0)), "deepest")).otherwise(F.col("cap"))
    return rows.select("vendor_id", "family", ((F.col("mandatory") | raised) & ~replaced).alias("mandatory"), cap.cast("int").alias("cap"), replaced.alias("not_applicable"))


def gap_points(missing: Column) -> Column:
    """Points for missing transparency checks: 0-1 none, 2-3 one, 4-5 two, 6 three."""
    return F.when(missing <= 1, 0).when(missing <= 3, 1).when(missing <= 5, 2).otherwise(3)


def class_rank(arp: Column) -> Column:
    return F.when(arp >= 14, 3).when(arp >= 10, 2).when(arp >= 6, 1).otherwise(0)


def stepped(e: Column, k: Column, tier_points: Column, gap: Column, verdict: Column, escalated: Column) -> tuple[Column, Column, Column, Column]:
    """(points, gate, before the cap, after): 2E + 2K + tier + gap, then the gate, the floor, and the verdict's cap."""
    arp = 2 * e + 2 * k + tier_points + gap
    gate = (e >= 2) | (k >= 2)
    gated = F.when(gate, class_rank(arp)).otherwise(F.least(class_rank(arp), F.lit(1)))
    floored = F.when(escalated & gate & verdict.isin("Confirmed", "Probable"), F.greatest(gated, F.lit(2))).otherwise(gated)
    capped = F.when(verdict.isin("Affirmed", "Not detected"), F.lit(-1)).when(verdict == "Inconclusive", F.least(floored, F.lit(1))).when(verdict == "Probable", F.least(floored, F.lit(2))).otherwise(floored)
    return arp, gate, floored, capped


def risk(rows: DataFrame) -> DataFrame:
    """vendor_id, e, k, tier_points, missing, verdict, escalators (array) -> points, gate, class, ceiling, flip."""
    gap = gap_points(F.col("missing"))
    args = F.col("tier_points"), gap, F.col("verdict"), F.size("escalators") > 0
    arp, gate, before, after = stepped(F.col("e"), F.col("k"), *args)
    *_, worst = stepped(F.lit(3), F.lit(3), F.col("tier_points"), F.lit(3), F.lit("Confirmed"), F.lit(True))
    flips = F.array(*[F.struct(F.lit(name).alias("what"), stepped(e, k, *args[:2], v, args[3])[3].alias("rank")) for name, e, k, v in (
        ("exposure up", F.least(F.col("e") + 1, F.lit(3)), F.col("k"), F.col("verdict")),
        ("decision up", F.col("e"), F.least(F.col("k") + 1, F.lit(3)), F.col("verdict")),
        ("confirmed", F.col("e"), F.col("k"), F.lit("Confirmed")),
    )])
    label = lambda rank: F.when(rank < 0, "None identified").otherwise(named(F.greatest(rank, F.lit(0)), CLASSES))
    flip = F.transform(F.filter(flips, lambda f: f["rank"] > after), lambda f: f["what"])
    return rows.select(
        "vendor_id", arp.alias("arp"), gap.alias("tg"), gate.alias("gate_met"), label(before).alias("before_cap"), label(after).alias("risk_class"),
        label(worst).alias("ceiling"), F.array_join(flip, ",").alias("flips"),
    )


def themes(e: Column, k: Column, missing: Column, escalators: Column, ai_type: Column) -> Column:
    has = lambda *codes: F.arrays_overlap(escalators, F.array(*map(F.lit, codes)))
    flags = [("RT1", e >= 2), ("RT2", (missing >= 2) | has("X1", "X6")), ("RT3", (k >= 2) | (missing >= 4)), ("RT4", (k >= 3) | has("X3")), ("RT5", ai_type.isin("genai_llm", "agentic")), ("RT6", ai_type == "predictive_ml"), ("RT7", has("X5"))]
    return F.array_compact(F.array(*[F.when(f, F.lit(name)) for name, f in flags]))


def actions(rows: DataFrame) -> DataFrame:
    """vendor_id, risk_class, tier, ceiling, verdict -> playbook and deadline in business days."""
    top = F.col("tier") == "Critical"
    none = F.col("risk_class") == "None identified"
    playbook = (
        F.when(none & F.col("tier").isin("Critical", "High"), "none-high")
        .when(none, "none-low")
        .when(F.col("verdict") == "Inconclusive", "provisional")
        .when(F.col("risk_class") == "Critical", "critical")
        .when(F.col("risk_class") == "High", "high")
        .otherwise("standard")
    )
    rows = rows.withColumn("playbook", playbook)
    days = (
        F.when(F.col("playbook") == "critical", 15)
        .when(F.col("playbook") == "high", F.when(top, 15).otherwise(30))
        .when(F.col("playbook") == "provisional", F.when(F.col("ceiling").isin("High", "Critical"), 15).otherwise(30))
        .when(F.col("playbook") == "standard", F.when(top, 15).otherwise(30))
    )
    return rows.select("vendor_id", "playbook", days.alias("deadline_days"))


def one_sided(third_party: DataFrame, own: DataFrame) -> DataFrame:
    """Providers that only third parties name: vendor_id, provider without a like provider of the vendor's own."""
    key = lambda df: df.select("vendor_id", F.lower("provider").alias("provider_key"), "provider")
    only = key(third_party).join(key(own).drop("provider"), ["vendor_id", "provider_key"], "left_anti")
    return only.groupBy("vendor_id", "provider_key").agg(F.min("provider").alias("provider"))
