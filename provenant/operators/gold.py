"""Evaluation against prior findings: their shape, what was captured, which item answers each, agreement, and the report's rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions import expressions as E
from provenant.functions import udfs
from provenant.operators import grading

#: The least length of an excerpt's segment, and the likeness from which it answers.
SEGMENT, LIKE = 12, 90.0


def problems(rows: DataFrame, expects: Sequence[str]) -> DataFrame:
    """Rows of prior findings with what is wrong with their shape; must be empty to evaluate. Null and blank are missing alike."""
    blank = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) == "" for c in ("vendor_id", "url", "family")}
    odd = F.array_compact(F.array(*[F.when(b, F.lit(f"no {c}")) for c, b in blank.items()], F.when(~F.coalesce(F.col("expect").isin(*expects), F.lit(False)), F.lit("unknown expect"))))
    return rows.withColumn("problems", odd).where(F.size("problems") > 0)


def _places(rows: DataFrame) -> DataFrame:
    """Rows (vendor_id, url and more) once for their page (basis 'url') and once for the name their address asks for ('dns domain'), as `at`."""
    page, name = E.match_key(E.archived(F.col("url"))), E.dns_name(F.col("url"))
    places = F.array(F.struct(F.lit("url").alias("basis"), page.alias("at")), F.struct(F.lit("dns domain").alias("basis"), F.nullif(name, F.lit("")).alias("at")))
    return rows.select("*", F.inline(places)).drop("url").where("at IS NOT NULL")


def _asking(gold: DataFrame) -> DataFrame:
    """Findings with what they ask: vendor_id, url and dns, whether the name in the address counts too, instead of the family."""
    return gold.withColumn("dns", F.coalesce(F.col("family") == "DNS", F.lit(False))).drop("family")


def _placed(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Askings with the columns of the place (basis, at and more of known, whose rows are each a vendor's place once) that they are looked
    up at: their page if it is known, else, for DNS findings, the name asked for; nulls if neither is. Places are met, not what lies
    there, so no pairs are made; findings that ask alike are one asking, so few are dealt."""
    own = asked.withColumns({"page": E.match_key(E.archived(F.col("url"))), "name": F.when(F.col("dns"), E.dns_name(F.col("url")))})
    for basis, key in (("url", "page"), ("dns domain", "name")):
        there = known.where(F.col("basis") == basis).select("vendor_id", F.col("at").alias(key), F.struct(*[c for c in known.columns if c != "vendor_id"]).alias(f"by_{key}"))
        own = own.join(there, ["vendor_id", key], "left")
    return own.withColumn("met", F.coalesce("by_page", "by_name")).select(*asked.columns, "met.*")


def captured(gold: DataFrame, captures: DataFrame) -> DataFrame:
    """finding_id -> n_captures, basis ('url', 'dns domain' or null). gold: finding_id, vendor_id, family, url; captures: vendor_id, capture_id, url."""
    known = _places(captures.select("vendor_id", "url", "capture_id")).groupBy("vendor_id", "basis", "at").agg(F.count_distinct("capture_id").alias("n_captures"))
    own, asking = _asking(gold.select("finding_id", "vendor_id", "family", "url")), ["vendor_id", "url", "dns"]
    found = own.join(_placed(own.select(*asking).distinct(), known), asking, "left")
    return found.select("finding_id", F.coalesce("n_captures", F.lit(0)).alias("n_captures"), "basis")


def answered(gold: DataFrame, items: DataFrame, like: float = LIKE, carry: Sequence[str] = ()) -> DataFrame:
    """finding_id -> item_key, overlap, basis of the item that answers it best, null without any item at its page; then columns of
    gold to carry.

    Of the items there: those whose excerpt overlaps enough come first, then citable ones, the larger overlap, strength, key. The
    overlap is 100 if one excerpt is in the other, else how well the shorter one fits into the longer; only these meet in Python.
    Items with one excerpt at one place overlap alike, so the best of them stands for all; findings that ask alike are answered once.
    """
    said = lambda c: F.when(F.length(F.trim(c)) >= SEGMENT, F.lower(F.trim(c))).otherwise("")
    rank = grading.position(grading.strength(), grading.STRENGTHS)
    graded = items.select("vendor_id", "url", said("excerpt").alias("found"), F.struct((~grading.citable()).alias("b"), rank.alias("d"), F.col("item_key").alias("e")).alias("order"), F.struct("item_key", grading.strength().alias("strength"), (F.col("ai_type") == "not_ai").alias("trap")).alias("item"))
    there = _places(graded).groupBy("vendor_id", "basis", "at", "found").agg(F.min("order").alias("order"), F.min_by("item", "order").alias("item"))
    rows, asking = _asking(gold.select("finding_id", "vendor_id", "family", "url", said("excerpt").alias("said"), *carry)), ["vendor_id", "url", "dns", "said"]
    own = _placed(rows.select(*asking).distinct(), _places(items.select("vendor_id", "url")).distinct())
    place = ["vendor_id", "basis", "at"]
    both = own.where("at IS NOT NULL").select(*place, "said").distinct().join(there, place)
    short, inside = (F.col("found") == "") | (F.col("said") == ""), F.contains("found", "said") | F.contains("said", "found")
    longer = F.length("found") >= F.length("said")
    apart = lambda one, other: F.when(~(short | inside), F.when(longer, F.col(one)).otherwise(F.col(other)))
    scored = both.withColumn("part", udfs.part_ratio(apart("said", "found"), apart("found", "said"))).withColumn("overlap", F.when(short, 0.0).when(inside, 100.0).otherwise(F.col("part")))
    order = F.struct((F.col("overlap") < like).alias("a"), F.col("order.b").alias("b"), (-F.col("overlap")).alias("c"), F.col("order.d").alias("d"), F.col("order.e").alias("e"))
    chosen = F.struct("item.item_key", "overlap", F.when(F.col("overlap") >= like, "excerpt").otherwise("url").alias("basis"), "item.strength", "item.trap")
    best = scored.groupBy(*place, "said").agg(F.min_by(chosen, order).alias("best"))
    found = own.join(best, [*place, "said"]).select(*asking, "best")
    return rows.join(found, asking, "left").select("finding_id", "best.*", *carry)


def strength_agreement(gold: DataFrame, answers: DataFrame, expected: Mapping[str, Sequence[str]]) -> DataFrame:
    """finding_id -> label, agree: whether the item's strength is among those that the finding expects; a trap agrees with nothing and
    a finding without an item has no label. Answers that carry the column expect need not meet their findings again."""
    rows = answers if "expect" in answers.columns else gold.select("finding_id", "expect").join(answers, "finding_id", "left")
    agree = F.lit(None).cast("boolean")
    for name, strengths in expected.items():
        agree = F.when(F.col("expect") == name, F.col("strength").isin(*strengths)).otherwise(agree)
    return rows.select("finding_id", F.when(F.col("trap"), "trap").otherwise(F.col("strength")).alias("label"), F.when(F.col("trap"), F.lit(None)).otherwise(agree).alias("agree"))


def inside_passages(located: DataFrame, passages: DataFrame) -> DataFrame:
    """Located spans (id, doc_id, start, end) that overlap a passage of their document: a semi join by bins, so each stays once."""
    from provenant.operators import spans

    met = spans.overlaps(located, passages).select(F.col("left_id").alias("id")).distinct()
    return located.join(met, "id", "left_semi")


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """Documents that have no passage: what whole-page rules look at."""
    return docs.join(passages.select("doc_id").distinct(), "doc_id", "left_anti")


def report(gold: DataFrame, captures: DataFrame, answers: DataFrame, agreement: DataFrame) -> DataFrame:
    """section, metric, value (double): the rows of the gold report, each an aggregate."""
    n = F.count(F.lit(1)).cast("double")
    percent = lambda hits: F.round(100.0 * hits / F.greatest(F.count(F.lit(1)), F.lit(1)), 1)

    def rows(df: DataFrame, section: str, **metrics: Column) -> DataFrame:
        return df.agg(*[m.cast("double").alias(k) for k, m in metrics.items()]).select(F.lit(section).alias("section"), F.explode(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*metrics))).alias("metric", "value"))

    hit, by_excerpt, known = F.count_if(F.col("n_captures") > 0), F.count_if(F.col("basis") == "excerpt"), F.count("agree")
    return (
        rows(captures, "url recall", findings=n, captured=hit, percent=percent(hit))
        .union(rows(answers, "passage recall", findings=n, by_excerpt=by_excerpt, without_item=F.count_if(F.col("item_key").isNull()), percent=percent(by_excerpt)))
        .union(rows(agreement, "strength", judged=known, agreeing=F.count_if("agree"), traps=F.count_if(F.col("label") == "trap")))
    )
