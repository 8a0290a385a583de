"""From text to graded items: indicators, counts, anchors, the vendor's own disclosures, escalators, roles, open gaps."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions import expressions as E
from provenant.operators import grading, scoring

# The order of indicator codes, the checks, the open gaps, loci and sources that are not the vendor's own words.
CODES = ("G1", "G2", "G3", "G4", "G5", "G6", "G7", "G8", "G9", "G10", "G11", "M1", "M2", "M3", "M4", "M5", "M6", "M7")
CHECKS = ("t1", "t2", "t3", "t4", "t5", "t6")
GAPS = ("SUB", "TRAIN", "LOC", "EXPL", "AGENT", "PI", "GOV", "INC", "CONC", "MRM")
THIRD_PARTY_LOCI = ("platform_supplier", "affiliate_inferred", "commentary")

_LETTER = r"[\p{L}\p{N}_-]"


def phrases(words: Sequence[str]) -> str:
    """A pattern for whole phrases, the longest first, in any case; one that fits nothing for no phrase."""
    bodies = [r"\s+".join(re.escape(w) for w in p.split()) for p in sorted(set(words), key=lambda p: (-len(p), p)) if p.split()]
    return rf"(?iu)(?<!{_LETTER})(?:{'|'.join(bodies)})(?!{_LETTER})" if bodies else r"(?!)"


def masked(text: Column, words: Sequence[str]) -> Column:
    """text with phrases overwritten by as many spaces, so that places stay."""
    for phrase in sorted(set(words), key=lambda p: (-len(p), p)):
        text = F.regexp_replace(text, phrases([phrase]), " " * len(phrase))
    return text


def indicators(text: Column, lexicon: Mapping[str, Sequence[str]], legal: Column, filing: Column, terms: Sequence[str], ml_words: Sequence[str] = ()) -> Column:
    """array(struct(start, rank, code, span)): each code's phrases in a text, one of each (code, span), in the order of the text.

    G6 and G7 come from the source: their span is the first term. M4 (automation called intelligent) counts only in a text without
    any word of ml_words. Null texts have none.
    """
    body = F.coalesce(text, F.lit(""))

    def hits(code: str, found: Column) -> Column:
        return F.transform(F.array_distinct(found), lambda span: F.struct(F.instr(body, span).alias("start"), F.lit(CODES.index(code)).alias("rank"), F.lit(code).alias("code"), span.alias("span")))

    none = F.array().cast("array<string>")
    every = []
    for code, words in lexicon.items():
        found = F.regexp_extract_all(body, F.lit(phrases(words)), F.lit(0))
        if code == "M4" and ml_words:
            found = F.when(body.rlike(phrases(ml_words)), none).otherwise(found)
        every.append(hits(code, found))
    first = F.slice(F.regexp_extract_all(body, F.lit(phrases(terms)), F.lit(0)), 1, 1)
    for code, flag in (("G6", legal), ("G7", filing)):
        every.append(hits(code, F.when(F.coalesce(flag, F.lit(False)), first).otherwise(none)))
    return F.array_sort(F.concat(*every))


def affirmed(text: Column, pattern: str) -> Column:
    """Whether a pattern fits text that its clause does not negate before it."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\b(?:no|not|never|without|neither|nor|cannot)\b[^.;:!?\n]*?(?=[.;:!?\n]|,?\s+but\b|,\s+(?:and|while)\b|$)", " ")
    return kept.rlike(pattern)


def anchor(fields: Sequence[Column], anchors: Sequence[tuple[int, str, str]], default: int, empty: int | None = None) -> Column:
    """struct(level, anchor, note): the highest of (level, name, pattern) that a field affirms, the first on a tie; without one the
    default, or, if all fields are empty, the level for that."""
    whole = F.concat_ws("\n", *[F.coalesce(f, F.lit("")) for f in fields])
    met = F.array_compact(F.array(*[F.when(affirmed(whole, p), F.struct(F.lit(level).alias("level"), F.lit(-i).alias("turn"), F.lit(name).alias("anchor"))) for i, (level, name, p) in enumerate(anchors)]))
    best = F.array_max(met)
    note = F.when(F.exists(met, lambda m: m["level"] == best["level"] - 1), "a level below fits too; the higher is taken").otherwise("")
    blank = (F.trim(whole) == "") & F.lit(empty is not None)
    fallback = F.when(blank, F.struct(F.lit(empty or 0).alias("level"), F.lit("").alias("anchor"), F.lit("the field is empty").alias("note"))).otherwise(
        F.struct(F.lit(default).alias("level"), F.lit("").alias("anchor"), F.lit("no anchor; to confirm").alias("note"))
    )
    return F.when(F.size(met) > 0, F.struct(best["level"].alias("level"), best["anchor"].alias("anchor"), note.alias("note"))).otherwise(fallback)


_NUMBER = r"(?<![\w.,])(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)(?:\s*(thousand|million|billion|mn|bn|k|m)\b)?"
# Factors of number words, and times a year.
_TIMES = {"thousand": 1_000, "k": 1_000, "million": 1_000_000, "mn": 1_000_000, "m": 1_000_000, "billion": 1_000_000_000, "bn": 1_000_000_000}
_A_YEAR = {"day": 365, "week": 52, "month": 12, "year": 1, "annum": 1}


def _factor(word: Column, table: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for name, times in table.items():
        out = F.when(F.lower(word) == name, times).otherwise(out)
    return out


def volume_level(text: Column, nouns: Sequence[str], thresholds: Sequence[int], vetoes: Sequence[str] = ("times", "daily", "weekly", "monthly", "hours", "minutes")) -> Column:
    """struct(level, trigger) of the best count before one of the nouns, the first on a tie; null without one that counts.

    At most three plain words stand between the number and the noun, none of the vetoes; 'per month' and the like make it yearly.
    The level is how many thresholds the count reaches.
    """
    pattern = rf"(?i){_NUMBER}\s+((?:[A-Za-z][\w'-]*\s+){{0,3}}?)(?:{'|'.join(map(re.escape, nouns))})\b(?:\s+(?:a|an|per|each|every)\s+({'|'.join(_A_YEAR)})\b)?"
    body = F.coalesce(text, F.lit(""))
    part = lambda i: F.regexp_extract_all(body, F.lit(pattern), F.lit(i))
    found = F.arrays_zip(part(0).alias("trigger"), part(1).alias("number"), part(2).alias("times"), part(3).alias("gap"), part(4).alias("per"))

    def graded(m: Column, i: Column) -> Column:
        count = F.regexp_replace(m["number"], ",", "").cast("double") * _factor(m["times"], _TIMES) * _factor(m["per"], _A_YEAR)
        level = F.lit(0)
        for least in thresholds:
            level = level + F.when(count >= least, 1).otherwise(0)
        vetoed = F.arrays_overlap(F.split(F.lower(F.trim(m["gap"])), r"\s+"), F.array(*map(F.lit, vetoes)))
        return F.struct(F.when(vetoed, 0).otherwise(level).alias("level"), (-i).alias("turn"), F.trim(m["trigger"]).alias("trigger"))

    best = F.array_max(F.filter(F.transform(found, graded), lambda g: g["level"] > 0))
    return F.when(best.isNotNull(), F.struct(best["level"].alias("level"), best["trigger"].alias("trigger")))


def volume(text: Column, customers: Sequence[str], records: Sequence[str], entire: str, zero: str) -> Column:
    """The level of customers and records served: the larger; 'the entire base' is 4; without a customer count a zero phrase is 0."""
    own = F.coalesce(volume_level(text, customers, (1, 10_000, 100_000, 1_000_000))["level"], F.lit(0))
    own = F.greatest(own, F.when(affirmed(text, entire), 4).otherwise(0))
    held = F.coalesce(volume_level(text, records, (1, 100_000, 1_000_000, 10_000_000))["level"], F.lit(0))
    return F.when(own > 0, F.greatest(own, held)).when(F.coalesce(text, F.lit("")).rlike(zero), 0).otherwise(held)


def disclosing() -> Column:
    """First-party voice for disclosures: neither a DNS record nor a third party's page or place, and a source of grade A to C."""
    return ~F.col("locus").isin(*THIRD_PARTY_LOCI) & ~F.col("family").isin("DNS", "IND") & F.col("sr").isin("A", "B", "C")


def speaking() -> Column:
    """First-party voice for names: of any grade of source, but no limiting statement."""
    return ~F.col("locus").isin(*THIRD_PARTY_LOCI) & ~F.col("family").isin("DNS", "IND") & (F.col("u") != 8)


def transparency(items: DataFrame) -> DataFrame:
    """vendor_id -> t1 to t6 (whether a citable disclosure of the vendor's own closes the check), missing, tg (points).

    Items have cue_data_use, cue_boilerplate, cue_oversight, cue_governance, cue_notification and action. Marketing and postings
    close neither t3 to t6, boilerplate neither t4 to t6. A vendor without items isn't in the result.
    """
    own, practice = disclosing(), disclosing() & (F.col("u") != 7) & (F.col("family") != "JOB")
    plain = practice & ~F.col("cue_boilerplate")
    closes = {
        "t1": own & F.col("sr").isin("A", "B") & (F.col("rl") == 3) & (F.col("u") <= 4),
        "t2": own & speaking() & (F.col("n_providers") > 0),
        "t3": practice & (F.col("family") == "LEG") & F.array_contains("codes", "G3") & F.col("cue_data_use"),
        "t4": plain & ((F.col("action") == "human_reviewed_decision") | F.col("cue_oversight")),
        "t5": plain & F.col("cue_governance"),
        "t6": plain & F.col("cue_notification"),
    }
    said = items.groupBy("vendor_id").agg(*[F.coalesce(F.bool_or(grading.citable() & c), F.lit(False)).alias(t) for t, c in closes.items()])
    missing = sum((F.when(F.col(t), 0).otherwise(1) for t in CHECKS), F.lit(0))
    return said.withColumn("missing", missing).withColumn("tg", scoring.gap_points(F.col("missing")))


def escalators(items: DataFrame, names: DataFrame, vendors: DataFrame, as_of: Column) -> DataFrame:
    """vendor_id -> x1 to x6.

    items: see grading, with cue_training, cue_no_training, cue_privileged, cue_production, cue_credit, cue_incident, action and k
    (the decision level). names: vendor_id, provider, foundation (a maker of models), third_party (said by one, not the vendor).
    vendors: vendor_id, e, e_assumed, k, k_assumed, privileged, tier. Vendors without items or names have none.
    """
    used = grading.citable()
    pathway = used & (grading.qualifying() | grading.corroborating())
    own = ~F.col("locus").isin(*THIRD_PARTY_LOCI) & (F.col("u") != 8)
    rows = items.join(vendors.select("vendor_id", "privileged"), "vendor_id")
    recent = E.months_apart(F.col("published"), as_of) <= 24
    flags = rows.groupBy("vendor_id").agg(
        F.bool_or(used & own & F.col("cue_training") & ~F.col("cue_no_training")).alias("trains"),
        F.bool_or(pathway & (F.col("action") == "automated_action") & ((F.col("ai_type") == "agentic") | F.col("privileged") | F.col("cue_privileged")) & F.col("cue_production")).alias("acts"),
        F.bool_or(pathway & (F.col("k") == 3) & F.col("cue_credit")).alias("credit"),
        F.bool_or(used & own & ~F.array_contains("codes", "M3") & F.col("cue_incident") & F.coalesce(recent, F.lit(False))).alias("incident"),
    )
    only = scoring.one_sided(names.where("third_party"), names.where("NOT third_party")).select("vendor_id").distinct().withColumn("apart", F.lit(True))
    makers = names.where("foundation AND NOT third_party").groupBy("vendor_id").agg(F.count_distinct(F.lower("provider")).alias("makers"))
    out = vendors.join(flags, "vendor_id", "left").join(only, "vendor_id", "left").join(makers, "vendor_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    exposed = (F.col("e") >= 2) & ~F.col("e_assumed")
    decides = (F.col("k") >= 3) & ~F.col("k_assumed")
    found = {
        "x1": exposed & yes("apart"), "x2": exposed & yes("trains"), "x3": yes("acts"), "x4": decides & yes("credit"), "x5": yes("incident"),
        "x6": (F.col("tier") == "Critical") & (F.coalesce("makers", F.lit(0)) == 1),
    }
    return out.select("vendor_id", *[c.alias(x) for x, c in found.items()])


def roles(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Items with role. verdicts: vendor_id, usage (Yes, No, Inconclusive). Decisive are, of a Yes, the qualifying and corroborating
    items, the first by rank being Primary; of others those that block a negative or limit use. An item of a vendor without a verdict
    is judged as of an Inconclusive one."""
    from pyspark.sql import Window

    rows = items.join(verdicts.select("vendor_id", "usage"), "vendor_id", "left").withColumn("usage", F.coalesce("usage", F.lit("Inconclusive")))
    q_or_k = grading.qualifying() | grading.corroborating()
    order = Window.partitionBy("vendor_id").orderBy(F.when(grading.citable() & q_or_k & (F.col("u") != 8), 0).otherwise(1), *grading.rank_order())
    rows = rows.withColumn("nth", F.row_number().over(order))
    role = (
        F.when(~grading.citable(), "Logged")
        .when(F.col("u") == 8, "Negative")
        .when((F.col("usage") == "Yes") & q_or_k, F.when(F.col("nth") == 1, "Primary").otherwise("Supporting"))
        .when((F.col("usage") != "Yes") & grading.blocks_not_detected(), F.when(F.col("usage") == "No", "Counter-evidence").otherwise("Indicator"))
        .when(grading.strength().startswith("Context"), "Context")
        .otherwise("Logged")
    )
    return rows.withColumn("role", role).drop("nth", "usage")


def reaching(items: DataFrame, level: str) -> DataFrame:
    """vendor_id, item_key, level: all items that reach their vendor's highest level; nulls reach nothing. Rows, not an array, so a
    vendor with many is no large value."""
    top = items.groupBy("vendor_id").agg(F.max(level).alias("top")).where("top IS NOT NULL")
    return items.join(top, "vendor_id").where(F.col(level) == F.col("top")).select("vendor_id", "item_key", F.col("top").alias(level))


def gap_blocks(vendors: DataFrame, items: DataFrame) -> DataFrame:
    """vendor_id -> gaps: the open ones in their order; none for a vendor whose use is denied or who has no risk class.

    vendors: vendor_id, usage, risk_class, k, t1 to t6, x6. items have cue_register, cue_region, action, ai_type, n_providers.
    """
    used = grading.citable()
    pool = used & (F.col("u") != 8)
    said = items.groupBy("vendor_id").agg(
        F.bool_or(used & (F.col("family") == "LEG") & F.col("cue_register")).alias("register"),
        F.bool_or(used & F.col("cue_region")).alias("region"),
        F.bool_or(pool & ((F.col("ai_type") == "agentic") | (F.col("action") == "automated_action"))).alias("agent"),
        F.bool_or(pool & F.col("ai_type").isin("genai_llm", "conversational")).alias("talks"),
        F.bool_or(pool & (F.col("ai_type") == "predictive_ml")).alias("predicts"),
        F.count_distinct(F.when(pool & (F.col("n_providers") > 0), F.col("n_providers"))).alias("named"),
    )
    rows = vendors.join(said, "vendor_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    fires = {
        "SUB": ~yes("t2") | ~yes("register"), "TRAIN": ~yes("t3"), "LOC": ~yes("region"), "EXPL": ~yes("t4"), "AGENT": yes("agent"), "PI": yes("talks"),
        "GOV": ~yes("t5"), "INC": ~yes("t6"), "CONC": yes("x6") | (F.coalesce("named", F.lit(0)) == 1), "MRM": (F.col("k") >= 2) & yes("predicts"),
    }
    gaps = F.array_compact(F.array(*[F.when(fires[g], F.lit(g)) for g in GAPS]))
    none = (F.col("risk_class") == "None identified") | (F.col("usage") == "No")
    return rows.select("vendor_id", F.when(none, F.array().cast("array<string>")).otherwise(gaps).alias("gaps"))


def rescored(items: DataFrame, reviews: DataFrame, stages: Sequence) -> DataFrame:
    """Items with their last reviews put through the later stages again: derived columns are computed anew, never carried over.

    stages are functions of a table, in order, such as grading.graded.
    """
    from provenant.operators import runs

    rows = runs.reviewed(items.drop("review", "strength"), reviews)
    for stage in stages:
        rows = stage(rows)
    return rows


def profiled(profiles: DataFrame, fields: Mapping[str, Sequence[str]], rubric: Mapping[str, Sequence[tuple[int, str, str]]], defaults: Mapping[str, tuple[int, int | None]], customers: Sequence[str], records: Sequence[str]) -> DataFrame:
    """Profiles with the levels o, d, p, r, v that their texts have, d3p, score and tier.

    fields: factor -> columns; rubric: factor -> (level, name, pattern), for o, d, p and r; defaults: factor -> (without an anchor, of an
    empty field). The anchor named D3-P is level 3 and privileged. r is 4 with customer data for 10,000 customers or more, 3 with
    privileged access or such data for fewer, 2 with confidential data, or what its own anchors say if that is more.
    """
    found = {f: anchor([F.col(c) for c in fields[f]], rubric[f], *defaults[f]) for f in "odpr"}
    whole = F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in fields["v"]])
    rows = profiles.withColumns({f"at_{f}": a for f, a in found.items()} | {"v": volume(whole, customers, records, r"(?i)entire (?:customer )?base", r"(?i)not applicable|no customer data")})
    rows = rows.withColumn("served", F.coalesce(volume_level(whole, customers, (1, 10_000, 100_000, 1_000_000))["level"], F.lit(0)))
    d, privileged = F.col("at_d.level"), F.col("at_d.anchor") == "D3-P"
    by_data = F.when((d >= 3) & ~privileged & (F.col("served") >= 2), 4).when(privileged | (d >= 3), 3).when(d == 2, 2).otherwise(0)
    rows = rows.withColumns({"o": F.col("at_o.level"), "d": d, "p": F.col("at_p.level"), "r": F.greatest(by_data, F.col("at_r.level")), "d3p": privileged})
    return scoring.criticality(rows).drop("at_o", "at_d", "at_p", "at_r", "served")


def tag_passages(passages: DataFrame, lexicon: Mapping[str, Sequence[str]], suppress: Sequence[str] = ()) -> DataFrame:
    """The best item of each passage: passages (passage_id, passage, relation, job, product, commentary, service, named) cut into
    segments, those with a term tagged, and the one that is no trap and strongest kept, with its place in the passage.

    A passage without a segment that has a term gives none.
    """
    from provenant.functions import text as kernels
    from provenant.functions import udfs
    from provenant.operators import tagging

    own = ("relation", "job", "product", "commentary", "service", "named", "sr", "rc")
    parts = udfs.spans(passages, lambda t: [(a, b, t[a:b]) for a, b in kernels.segments(t)], "start int, end int, segment string", ["start", "end", "segment"], key="passage_id", body="passage", carry=own)
    rows = tagging.tagged(tagging.cues(parts, lexicon, suppress, body="segment")).where("cue_term")
    codes = F.array_compact(F.array(F.when(F.col("cue_deployed"), "G4"), F.when(F.col("cue_data_use"), "G3"), F.when(F.col("cue_generic"), "M1"), F.when(F.col("cue_planned"), "M2")))
    rows = rows.withColumn("codes", codes).withColumns({"method": F.lit("rules"), "review": F.lit("accepted"), "n_providers": F.lit(0)})
    rows = rows.withColumn("sp", grading.specificity(F.col("named"), F.col("temporal")))
    rows = rows.withColumn("rl", grading.relevance(F.col("service"), F.col("product")))
    rows = rows.withColumns({"strength_rank": grading.position(grading.strength(), grading.STRENGTHS), "trap": F.col("ai_type") == "not_ai", "n_codes": F.size(F.filter("codes", lambda c: c.startswith("G")))})
    return tagging.best_candidate(rows).withColumn("strength", grading.strength())
