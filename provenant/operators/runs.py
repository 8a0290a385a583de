"""Collection runs, coverage, reviews, gates and budgets: latest rows, precedence, running counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A family's one status is the first of these that occurs; the complete ones.
PRECEDENCE = ("done_manual", "stopped", "done", "pending", "blocked_tou", "blocked_robots", "blocked_bot", "error", "descoped", "not_applicable")
COMPLETE = ("done", "done_manual", "not_applicable", "stopped")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: one aggregate that combines map-side, no window over a key's whole history."""
    rest = [c for c in rows.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*key).agg(last.alias("last")).select(*key, "last.*")


def latest_run(runs: DataFrame, as_of: Column) -> DataFrame:
    """Of each vendor the newest run that is no later than a day, by day, creation and id."""
    return latest(runs.where(F.col("as_of") <= as_of), ["vendor_id"], ["as_of", "created_at", "run_id"])


def family_status(coverage: DataFrame) -> DataFrame:
    """vendor_id, family -> status by precedence, sums, and whether it is complete."""
    rank = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("status"))
    return coverage.groupBy("vendor_id", "family").agg(
        F.min_by("status", rank).alias("status"),
        F.sum("requests").alias("requests"),
        F.max("cap").alias("cap"),
        F.sum("documents").alias("documents"),
        F.array_join(F.array_sort(F.collect_set("collector")), "+").alias("collectors"),
        F.count(F.lit(1)).alias("n_rows"),
        F.min_by("collector", F.struct(rank, "collector")).alias("decided_by"),
    )


def complete(plan: DataFrame, statuses: DataFrame) -> DataFrame:
    """vendor_id -> complete, missing: every mandatory family has a complete status; none counts as missing."""
    rows = plan.where("mandatory").join(statuses.select("vendor_id", "family", "status"), ["vendor_id", "family"], "left")
    done = F.coalesce(F.col("status").isin(*COMPLETE), F.lit(False))
    gaps = F.array_join(F.array_sort(F.collect_list(F.when(~done, F.col("family")))), ",")
    return rows.groupBy("vendor_id").agg(F.bool_and(done).alias("complete"), gaps.alias("missing"))


def reviewed(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Items with their last review's value, else pending."""
    last = latest(reviews, ["item_key"], ["seq"]).select("item_key", F.col("value").alias("reviewed"))
    return items.join(last, "item_key", "left").withColumn("review", F.coalesce("reviewed", F.lit("pending"))).drop("reviewed")


def adjudicated(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Items with the last review of each: status, and the labels (sp, rl, u, locus, ai_type; null: as they are) that it sets. An
    item whose labels are set is adjudicated; its grades are to be computed again from the new labels."""
    labels = ("sp", "rl", "u", "locus", "ai_type")
    last = latest(reviews, ["item_key"], ["seq"]).select("item_key", F.col("value").alias("said"), *[F.col(c).alias(f"new_{c}") for c in labels])
    rows = items.join(last, "item_key", "left")
    changed = F.coalesce(*[F.col(f"new_{c}").cast("string") for c in labels]).isNotNull()
    rows = rows.withColumn("method", F.when(changed, "adjudicated").otherwise(F.col("method"))).withColumn("review", F.coalesce("said", F.lit("pending")))
    return rows.withColumns({c: F.coalesce(f"new_{c}", c) for c in labels}).drop("said", *[f"new_{c}" for c in labels])


def access(requests: DataFrame, terms: DataFrame) -> DataFrame:
    """host, seeded -> decision by the terms of the longest domain that the host is under; what the terms don't allow in so many
    words is refused.

    terms: domain, automation (allowed, limited, none, manual), rps. A host's domains are exploded and met by equality, so
    there is no join by pattern.
    """
    from provenant.functions import expressions as E

    hosts = requests.select("host").distinct()
    own = hosts.select("host", F.explode(E.suffixes(F.col("host"))).alias("domain")).join(terms, "domain")
    best = own.groupBy("host").agg(F.max_by(F.struct("domain", "automation", "rps"), F.struct(F.length("domain"), "domain")).alias("t"))
    rows = requests.join(best, "host", "left")
    decision = (
        F.when(F.col("host") == "", "no_host")
        .when(F.col("t").isNull(), "unknown")
        .when(F.col("t.automation") == "manual", "manual")
        .when(F.col("t.automation") == "none", "blocked_tou")
        .when((F.col("t.automation") == "limited") & ~F.coalesce("seeded", F.lit(False)), "seeds_only")
        .when(~F.coalesce(F.col("t.automation").isin("allowed", "limited"), F.lit(False)), "unknown")
        .when(F.col("t.rps").isNull(), "blocked_rate")
        .when(F.col("t.rps") <= 0, "blocked_rate")
        .otherwise("allow")
    )
    return rows.withColumn("domain", F.col("t.domain")).withColumn("decision", decision).drop("t")


def within_budget(requests: DataFrame, key: list[str], order: list[str], cap: Column) -> DataFrame:
    """The requests of a key, numbered, and whether they are within its cap."""
    return requests.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).withColumn("granted", F.col("nth") <= cap)


def spent(requests: DataFrame, key: list[str], order: list[str], cap: Column, refunded: Column) -> DataFrame:
    """Requests with granted and spent: refused ones (refunded) use nothing up, so a request is granted while fewer than cap before
    it were made. A repeated address (url, accept) has the outcome of the first and is not counted again."""
    first = F.row_number().over(Window.partitionBy(*key, "url", "accept").orderBy(*order)) == 1
    rows = requests.withColumn("first", first).withColumn("costs", F.when(first & ~F.coalesce(refunded, F.lit(False)), 1).otherwise(0))
    before = F.coalesce(F.sum("costs").over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("granted", before < cap).withColumn("spent", F.least(before, cap))
    reused = F.first("granted").over(Window.partitionBy(*key, "url", "accept").orderBy(*order))
    return rows.withColumn("granted", reused).drop("costs")


def saturation(steps: DataFrame, key: list[str], order: list[str], fresh: Column, most: int) -> DataFrame:
    """Steps with idle, the steps in a row without anything new, and whether the run had stopped before."""
    w = Window.partitionBy(*key).orderBy(*order)
    island = F.sum(F.when(fresh, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = steps.withColumn("island", island).withColumn("fresh", fresh)
    own = Window.partitionBy(*key, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("idle", F.sum(F.when(F.col("fresh"), 0).otherwise(1)).over(own))
    earlier = F.max("idle").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("stopped", F.coalesce(earlier >= most, F.lit(False))).drop("island", "fresh")


def first_outcomes(fetches: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first outcome of each address in a run counts."""
    rest = [c for c in fetches.columns if c not in key]
    return fetches.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first")).select(*key, "first.*")


def cached(calls: DataFrame, cache: DataFrame, chain: list[str]) -> DataFrame:
    """call key -> the response of the first model of the chain that has one; only ok responses are kept."""
    order = F.array_position(F.array(*map(F.lit, chain)), F.col("model"))
    kept = cache.where((F.col("status") == "ok") & F.col("model").isin(*chain)).groupBy("key").agg(F.min_by(F.struct("model", "response"), order).alias("hit"))
    return calls.join(kept, "key", "left").select(*[c for c in calls.columns], F.col("hit").isNotNull().alias("from_cache"), F.col("hit.model").alias("model"), F.col("hit.response").alias("response"))


def differences(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys whose value differs between two tables, or that one lacks: side is both, left or right."""
    joined = left.select(*key, F.col(value).alias("left_value"), F.lit(True).alias("in_left")).join(right.select(*key, F.col(value).alias("right_value"), F.lit(True).alias("in_right")), key, "full_outer")
    side = F.when(F.col("in_right").isNull(), "left").when(F.col("in_left").isNull(), "right").otherwise("both")
    return joined.withColumn("side", side).where((F.col("side") != "both") | ~F.col("left_value").eqNullSafe(F.col("right_value"))).drop("in_left", "in_right")


def dangling(cited: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Cited keys that no evidence has: must be empty."""
    return cited.join(evidence.select(key), key, "left_anti")


def publishers(hosts: DataFrame, named: DataFrame) -> DataFrame:
    """host -> publisher: the name listed (domain, publisher) for the longest domain that the host is under, else the host itself
    without www.; met by equality of domains."""
    from provenant.functions import expressions as E

    own = hosts.select("host").distinct().select("host", F.explode(E.suffixes(F.col("host"))).alias("domain")).join(named, "domain")
    best = own.groupBy("host").agg(F.max_by("publisher", F.struct(F.length("domain"), "domain")).alias("listed"))
    return hosts.join(best, "host", "left").withColumn("publisher", F.coalesce("listed", F.regexp_replace("host", r"^www\.", ""))).drop("listed")


def ordered_union(groups: Sequence[DataFrame], key: str) -> DataFrame:
    """The rows of all groups, of each key only those of the first group that has it, with that group's number; no order is left to
    chance, as the number is a column. Keys repeated inside a group are one row: the least of them."""
    every = None
    for number, group in enumerate(groups):
        own = group.withColumn("of_group", F.lit(number))
        every = own if every is None else every.unionByName(own)
    rest = [c for c in every.columns if c not in (key, "of_group")]
    return every.groupBy(key).agg(F.min(F.struct("of_group", *rest)).alias("first")).select(key, *[f"first.{c}" for c in ("of_group", *rest)])


def unknown(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Asked-for keys that there are none of, each once: must be empty before a run selects by them."""
    return asked.where(F.col(key).isNotNull()).select(key).distinct().join(known.select(key), key, "left_anti")
