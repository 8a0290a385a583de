"""Risk inputs from items, host policy for release, batches under budgets, cell texts, edits."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions import expressions as E
from provenant.operators import folds, grading, runs


def exposure() -> Column:
    """0 to 3 by locus: the service and its add-ons by the data's level, delivery and development by cues; others null.

    Columns: locus, rl, data_level, privileged, external (a provider outside with data), customer_data, artefacts, production_data.
    """
    exact = F.col("rl") == 3
    sensitive = (F.col("data_level") >= 4) | F.col("privileged") | F.col("external")
    service = F.when(sensitive, F.when(exact, 3).otherwise(2)).when(F.col("data_level") == 3, 2).otherwise(1)
    delivery = F.when(F.col("customer_data"), F.when(exact, 3).otherwise(2)).when(F.col("artefacts"), 2).otherwise(1)
    return (
        F.when(F.col("locus").isin("service_feature", "vendor_addon"), service)
        .when(F.col("locus") == "delivery_ops", delivery)
        .when(F.col("locus") == "sdlc", F.when(F.col("production_data"), 2).otherwise(1))
        .when(F.col("locus") == "corporate_internal", 0)
    )


def decision() -> Column:
    """0 to 3 by action level; unknown is null. target: the action is on credit, holds and the like."""
    return F.when(F.col("action") == "automated_action", F.when(F.col("target"), 3).otherwise(2)).when(F.col("action") == "human_reviewed_decision", 2).when(F.col("action") == "advisory", 1).when(F.col("action") == "none", 0)


def risk_inputs(items: DataFrame, vendors: DataFrame) -> DataFrame:
    """vendor_id -> e, k and the first item that reaches each; what stays unknown is assumed from the vendor's levels.

    vendors: vendor_id, data_level, privileged, process_level, customer_facing, verdict. A negative verdict gives 0.
    """
    rows = items.join(vendors.select("vendor_id", "data_level", "privileged"), "vendor_id").where(grading.citable())
    rows = rows.withColumn("e_item", exposure()).withColumn("k_item", decision())
    best = lambda value: F.max_by(F.struct(F.col(value).alias("level"), "item_key"), F.struct(value, -F.col("item_key")))
    found = rows.groupBy("vendor_id").agg(best("e_item").alias("e_best"), best("k_item").alias("k_best"))
    top = (F.col("data_level") >= 4) | F.col("privileged")
    e_guess = F.when(top, 3).when(F.col("data_level") == 3, 2).otherwise(1)
    k_guess = F.when((F.col("process_level") >= 3) | F.col("privileged"), 3).when((F.col("process_level") >= 2) | F.col("customer_facing"), 2).otherwise(1)
    no, open_ = F.col("verdict").startswith("No"), F.col("verdict").startswith("Inconclusive")
    out = vendors.join(found, "vendor_id", "left")
    level = lambda best_, guess: F.when(no, 0).when(open_, F.greatest(F.coalesce(best_["level"], F.lit(0)), guess)).otherwise(F.coalesce(best_["level"], guess))
    return out.select("vendor_id", level(F.col("e_best"), e_guess).alias("e"), level(F.col("k_best"), k_guess).alias("k"), F.col("e_best.item_key").alias("e_item"), F.col("k_best.item_key").alias("k_item"))


def host_policy(hosts: DataFrame, register: DataFrame, signals: DataFrame) -> DataFrame:
    """host -> release decision and its basis: the register's word for the longest domain, else the host's own directives."""
    own = hosts.select("host", F.explode(E.suffixes(F.col("host"))).alias("domain")).join(register, "domain")
    best = own.groupBy("host").agg(F.max_by("allowed", F.struct(F.length("domain"), "domain")).alias("registered"))
    said = signals.groupBy("host").agg(F.bool_and(~F.col("refuses")).alias("unrefused"))
    rows = hosts.join(best, "host", "left").join(said, "host", "left")
    basis = F.when(F.col("registered").isNotNull(), "register").when(F.col("unrefused").isNotNull(), "directive").otherwise("default")
    return rows.select("host", F.coalesce("registered", "unrefused", F.lit(True)).alias("allowed"), basis.alias("basis"))


def batches(items: DataFrame, key: str, order: Sequence[Column], most: int, budget: int) -> DataFrame:
    """key, item_key, batch: items in order, a new batch when the count or the characters would be too many; only ids and sizes
    are streamed, not the items' texts."""

    def step(state: dict, row: tuple) -> tuple:
        item, size = row
        if state["n"] and (state["n"] >= most or state["chars"] + size > budget):
            state.update(batch=state["batch"] + 1, n=0, chars=0)
        state.update(n=state["n"] + 1, chars=state["chars"] + size)
        return item, state["batch"]

    rows = items.withColumn("size", F.col("size").cast("long"))
    return folds.streamed(rows, [key], order, ["item_key", "size"], lambda: {"batch": 0, "n": 0, "chars": 0}, step, ["item_key", "batch"], [("long", pa.int64()), ("int", pa.int32())])


def fitted(parts: Column, budget: int, gap: int = 1) -> Column:
    """Parts (struct of rank, place, body) that fit a budget, taken by rank, a too long one left out; joined by place."""
    start = F.struct(F.lit(0).alias("used"), F.slice(parts, 1, 0).alias("kept"))

    def add(state: Column, x: Column) -> Column:
        more = F.length(x["body"]) + F.when(F.size(state["kept"]) > 0, gap).otherwise(0)
        return F.when(state["used"] + more <= budget, F.struct((state["used"] + more).alias("used"), F.concat(state["kept"], F.array(x)).alias("kept"))).otherwise(state)

    kept = F.aggregate(F.array_sort(parts), start, add, lambda s: s["kept"])
    by_place = F.array_sort(F.transform(kept, lambda x: F.struct(x["place"].alias("place"), x["body"].alias("body"))))
    return F.array_join(F.transform(by_place, lambda x: x["body"]), " ")


def usage_text(budget: int = 1670) -> Column:
    """A cell's text from verdict, likelihood, confidence and counts; columns n_q, n_k, missing."""
    signals = F.when(F.col("n_q") + F.col("n_k") == 0, "no qualifying evidence").otherwise(F.concat(F.col("n_q").cast("string"), F.lit(" qualifying and "), F.col("n_k").cast("string"), F.lit(" corroborating items")))
    gaps = F.when(F.col("missing") == "", "Coverage is complete.").otherwise(F.concat(F.lit("Not covered: "), F.regexp_replace("missing", ",", ", "), F.lit(".")))
    return E.clip(F.concat_ws(" ", F.concat("verdict", F.lit(":"), F.lit(" AI use is "), "likelihood", F.lit(" ("), F.lower("confidence"), F.lit(" confidence), from "), signals, F.lit(".")), gaps), budget)


def criticality_text(budget: int = 1050) -> Column:
    """A cell's text from tier, score and the levels o, d, p, r, v; the shorter form without levels if the longer does not fit."""
    head = F.concat("tier", F.lit(" criticality ("), F.col("score").cast("string"), F.lit(" of 100)"))
    levels = F.concat_ws(", ", *[F.concat(F.lit(f"{name} "), F.col(c).cast("string")) for name, c in (("operations", "o"), ("data", "d"), ("process", "p"), ("regulation", "r"), ("volume", "v"))])
    return E.first_fit(F.array(F.concat(head, F.lit(": "), levels, F.lit(".")), F.concat(head, F.lit("."))), budget)


def depth_text(plan: DataFrame, budget: int = 1050) -> DataFrame:
    """vendor_id -> depth: the families to search with their caps, those that are optional and those that do not apply."""
    capped = F.concat("family", F.lit(" "), F.col("cap").cast("string"))
    listed = lambda chosen, shown: F.array_join(F.array_sort(F.collect_list(F.when(chosen, shown))), ", ")
    rows = plan.groupBy("vendor_id").agg(
        listed(F.col("mandatory") & F.col("cap").isNotNull(), capped).alias("must"), listed(~F.col("mandatory") & F.col("cap").isNotNull(), capped).alias("may"), listed(F.col("not_applicable"), F.col("family")).alias("no")
    )
    part = lambda c, label: F.when(F.col(c) != "", F.concat(F.lit(label), F.col(c), F.lit(".")))
    return rows.select("vendor_id", E.clip(F.concat_ws(" ", part("must", "Search "), part("may", "Optional: "), part("no", "Not applicable: ")), budget).alias("depth"))


def risk_text(budget: int = 1390) -> Column:
    """A cell's text from risk_class, arp, before_cap, ceiling and flips (what would raise the class)."""
    head = F.concat("risk_class", F.lit(" risk, "), F.col("arp").cast("string"), F.lit(" points"))
    held = F.when(F.col("risk_class") != F.col("before_cap"), F.concat(F.lit(" (held from "), "before_cap", F.lit(")"))).otherwise("")
    raises = F.when(F.col("flips") == "", "Nothing found would raise it.").otherwise(F.concat(F.lit("Raised by: "), F.regexp_replace("flips", ",", ", "), F.lit(".")))
    return E.clip(F.concat(head, held, F.lit("; at most "), "ceiling", F.lit(". "), raises), budget)


def action_text(budget: int = 1480) -> Column:
    """A cell's text from playbook, deadline_days and gaps (array); no deadline if there is none."""
    due = F.when(F.col("deadline_days").isNotNull(), F.concat(F.lit(" within "), F.col("deadline_days").cast("string"), F.lit(" business days"))).otherwise("")
    asks = F.when(F.size("gaps") > 0, F.concat(F.lit(" Ask about "), E.serial_list(F.col("gaps")), F.lit("."))).otherwise("")
    return E.clip(F.concat(F.lit("Follow the "), "playbook", F.lit(" playbook"), due, F.lit("."), asks), budget)


def edited(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """Cells (vendor_id, column, value) with the last edit of each, if any."""
    last = runs.latest(edits, ["vendor_id", "column"], ["seq"]).select("vendor_id", "column", F.col("value").alias("edit"))
    rows = cells.join(last, ["vendor_id", "column"], "left")
    return rows.select("vendor_id", "column", F.coalesce("edit", "value").alias("value"), F.col("edit").isNotNull().alias("edited"))


def isolated(rows: DataFrame, check: Column, *columns: str) -> DataFrame:
    """Rows whose check fails keep their key and say why; the others keep their columns: one bad row stops nothing."""
    return rows.withColumns({c: F.when(check.isNull(), F.col(c)) for c in columns}).withColumn("error", check)
