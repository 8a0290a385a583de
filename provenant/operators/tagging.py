"""Tagging: sources, relations, cues of a sentence, and the classes that follow from them.

One Arrow UDF looks for the lexicon's phrases and returns boolean cues; every class is then an ordered `when` over cue
columns in the JVM. Lexicons are data: the one here is a small synthetic example.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.functions import expressions as E
from provenant.functions import text
from provenant.functions.storage import small

#: An example lexicon: cue -> phrases.
LEXICON: dict[str, tuple[str, ...]] = {
    "term": ("machine learning", "neural network", "language model", "predictive model", "chatbot", "computer vision"),
    "deployed": ("in production", "deployed", "is live", "we use", "we run"),
    "planned": ("plan to", "will launch", "roadmap", "intend to", "may use"),
    "pilot": ("pilot", "beta", "trial"),
    "limiting": ("do not use", "does not use", "no use of", "prohibit"),
    "governance": ("risk framework", "governance", "oversight committee", "impact assessment"),
    "building": ("research team", "training our own", "data science team"),
    "generic": ("cutting edge", "transform your", "next generation"),
    "reviewed": ("human review", "analyst approves", "manual approval"),
    "automated": ("automatically", "without intervention", "autonomously"),
    "advisory": ("recommends", "suggests", "assists"),
    "sdlc": ("code review", "unit tests", "developers use"),
    "delivery": ("tickets", "incident response", "service desk"),
    "corporate": ("our staff use", "internal productivity"),
    "addon": ("optional module", "add-on", "premium feature"),
    "partner": ("partnership with", "alliance with"),
    "data_use": ("customer data", "personal data", "production data"),
    "agentic": ("agent", "agents"),
    "conversational": ("chatbot", "assistant"),
    "document": ("document extraction", "ocr"),
}
#: Phrases in which a term means something else.
SUPPRESSED = ("air conditioning", "artificial insemination")


def cues(passages: DataFrame, lexicon: Mapping[str, Sequence[str]] = LEXICON, suppress: Sequence[str] = SUPPRESSED, body: str = "passage") -> DataFrame:
    """Passages with a boolean column cue_<name> for each cue of the lexicon; suppressed phrases are masked first."""
    names = list(lexicon)
    phrases = {n: tuple(p) for n, p in lexicon.items()}
    held = tuple(suppress)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [text.phrase_pattern(phrases[n], plural=True) for n in names]
        for batch in batches:
            at = batch.schema.get_field_index(body)
            masked = [text.mask(t or "", held) for t in batch.column(at).to_pylist()]
            found = [pa.array([bool(p.search(t)) for t in masked], pa.bool_()) for p in patterns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *(f"cue_{n}" for n in names)])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in passages.schema)
    return passages.mapInArrow(run, fields + ", ".join(f"cue_{n} boolean" for n in names))


def use_state() -> Column:
    """commentary, pilot_or_beta, in_production, planned or unclear, the first that fits."""
    return (
        F.when(F.col("commentary"), "unclear").when(F.col("cue_pilot"), "pilot_or_beta").when(F.col("cue_planned") & ~F.col("cue_deployed"), "planned")
        .when(F.col("cue_deployed"), "in_production").otherwise("unclear")
    )


def action_level() -> Column:
    return F.when(F.col("cue_reviewed"), "human_reviewed_decision").when(F.col("cue_automated"), "automated_action").when(F.col("cue_advisory"), "advisory").otherwise("unknown")


def ai_type() -> Column:
    return F.when(~F.col("cue_term"), "not_ai").when(F.col("cue_agentic"), "agentic").when(F.col("cue_document"), "document_ai").when(F.col("cue_conversational"), "conversational").otherwise("unspecified")


def locus() -> Column:
    """Where the use is: what the source is to the vendor comes first, then the sentence's cues.

    relation: own, platform_supplier, affiliate_inferred or other; job: a posting; product: a page about the product.
    """
    staff = F.col("job") | ~F.col("product")
    return (
        F.when(F.col("relation").isin("platform_supplier", "affiliate_inferred"), F.col("relation"))
        .when(F.col("commentary"), "commentary")
        .when(F.col("cue_partner") & ~F.col("cue_deployed"), "relationship")
        .when(F.col("cue_sdlc") & staff, "sdlc")
        .when(F.col("cue_delivery") & staff, "delivery_ops")
        .when(F.col("cue_corporate") & staff, "corporate_internal")
        .when(F.col("job"), "corporate_internal")
        .when(F.col("cue_addon"), "vendor_addon")
        .when(F.col("relation") == "own", "service_feature")
        .otherwise("unknown")
    )


def u_class() -> Column:
    """1 to 8 from locus, temporal and cues: a limiting statement is 8; what is no use of the vendor's is 4 to 7."""
    away = F.col("locus").isin("platform_supplier", "affiliate_inferred")
    capability = F.when(F.col("cue_governance"), 6).when(F.col("cue_building"), 5)
    return (
        F.when(F.col("ai_type") == "not_ai", 7)
        .when(F.col("cue_limiting") & ~away & ~F.col("locus").isin("commentary", "relationship"), 8)
        .when(F.col("locus") == "commentary", 7)
        .when(F.col("locus") == "relationship", 4)
        .when(F.col("job") & ~away, F.when(F.col("cue_deployed") & ~F.col("cue_building"), 3).when(F.col("cue_governance"), 6).otherwise(5))
        .when(away, F.when(F.col("cue_generic"), 7).otherwise(2))
        .when(F.col("cue_generic"), F.coalesce(capability, F.lit(7)))
        .when(F.col("locus") == "service_feature", F.when(F.col("service"), 1).otherwise(2))
        .when(F.col("locus") == "vendor_addon", 2)
        .when(F.col("locus").isin("delivery_ops", "sdlc", "corporate_internal"), F.when(F.col("temporal") == "unclear", F.coalesce(capability, F.lit(3))).otherwise(3))
        .otherwise(F.coalesce(capability, F.lit(7)))
    )


def tagged(rows: DataFrame) -> DataFrame:
    """Rows with cues, relation, job, product, commentary and service -> temporal, action, ai_type, locus, u."""
    return rows.withColumn("temporal", use_state()).withColumn("action", action_level()).withColumn("ai_type", ai_type()).withColumn("locus", locus()).withColumn("u", u_class())


def source_types(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """doc_id, host, url, family -> source_type, sr: the first rule that fits, else unknown and F.

    rules: ordinal, domain (null: any), family (null: any), pattern (null: any; on the url), source_type, sr. Rules with a
    domain meet by equality on the host's domains; the few without one are broadcast, as they are policy of a fixed size.
    """
    by_domain = rules.where("domain IS NOT NULL")
    anywhere = rules.where("domain IS NULL").drop("domain")
    own = docs.select("doc_id", "url", "family", F.explode(E.suffixes(F.col("host"))).alias("domain")).join(by_domain.withColumnRenamed("family", "rule_family"), "domain").drop("domain")
    other = docs.select("doc_id", "url", "family").join(small(anywhere.withColumnRenamed("family", "rule_family")), F.lit(True)) if not anywhere.isEmpty() else own.limit(0)
    met = own.unionByName(other).where((F.col("rule_family").isNull() | (F.col("rule_family") == F.col("family"))) & (F.col("pattern").isNull() | F.expr("url rlike pattern")))
    first = met.groupBy("doc_id").agg(F.min_by(F.struct("source_type", "sr"), "ordinal").alias("r"))
    return docs.join(first, "doc_id", "left").select(*docs.columns, F.coalesce("r.source_type", F.lit("unknown")).alias("source_type"), F.coalesce("r.sr", F.lit("F")).alias("sr"))


def relations(docs: DataFrame, domains: DataFrame) -> DataFrame:
    """doc_id, vendor_id, host -> relation by the vendor's listed domains (relation: own, supplier, affiliate), in that order."""
    order = F.array_position(F.array(*map(F.lit, ("own", "platform_supplier", "affiliate_inferred"))), F.col("relation"))
    hit = docs.select("doc_id", "vendor_id", F.explode(E.suffixes(F.col("host"))).alias("domain")).join(domains, ["vendor_id", "domain"])
    best = hit.groupBy("doc_id").agg(F.min_by("relation", order).alias("relation"))
    return docs.join(best, "doc_id", "left").withColumn("relation", F.coalesce("relation", F.lit("other")))


def known_relations(docs: DataFrame, domains: DataFrame, boards: DataFrame, filers: DataFrame) -> DataFrame:
    """Docs (doc_id, vendor_id, host, url, cik) with relation, the first of: a domain of the vendor's own, a job board's page under its
    name (boards: vendor_id, domain, slug), a filing of its id (filers: vendor_id, cik), then supplier and affiliate domains, else other."""
    placed = relations(docs, domains).withColumnRenamed("relation", "by_domain")
    slug = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1))
    on_board = docs.select("doc_id", "vendor_id", slug.alias("slug"), F.explode(E.suffixes(F.col("host"))).alias("domain")).join(boards, ["vendor_id", "domain", "slug"]).select("doc_id", F.lit(True).alias("on_board")).distinct()
    filed = docs.join(filers.distinct(), ["vendor_id", "cik"], "left_semi").select("doc_id", F.lit(True).alias("filed")).distinct()
    rows = placed.join(on_board, "doc_id", "left").join(filed, "doc_id", "left")
    own = (F.col("by_domain") == "own") | F.coalesce("on_board", F.lit(False)) | F.coalesce("filed", F.lit(False))
    return rows.withColumn("relation", F.when(own, "own").otherwise(F.col("by_domain"))).drop("by_domain", "on_board", "filed")


def guarded_hits(text: Column, term: str, context: str, reach: int = 60) -> Column:
    """How often a term that is a word of everyday life counts: only with a word of its context before or after it within so many
    characters of the sentence."""
    near = rf"[^.!?\n]{{0,{reach}}}"
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}_-])(?:(?<=(?:{context})[^.!?\n]{{0,{reach}}}){term}|{term}(?={near}(?:{context})))(?![\p{{L}}\p{{N}}_-])"), F.lit(0))
    return F.size(found)


def subjects(docs: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, vendor_id -> named, corroborated: whether a document is of its vendor.

    names: vendor_id, name, kind (name, legal, product, person, collision). Collisions are taken out of the text first. A vendor is
    corroborated by its legal name, by two of its names, or by one beside a link (docs.linked). Names meet documents by vendor.
    """
    quoted = F.regexp_replace("name", r"([^\p{L}\p{N}\s])", r"\\\\$1")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_-])"), F.regexp_replace(quoted, r"\s+", r"[\\s-]+"), F.lit(r"(?![\p{L}\p{N}_-])"))
    listed = names.withColumn("pattern", pattern).groupBy("vendor_id").agg(F.array_sort(F.collect_set(F.struct("kind", "pattern"))).alias("listed"))
    rows = docs.select("doc_id", "vendor_id", "text", "linked").join(listed, "vendor_id", "left")
    clean = F.aggregate(F.filter("listed", lambda n: n["kind"] == "collision"), F.coalesce("text", F.lit("")), lambda t, n: F.regexp_replace(t, n["pattern"], F.lit(" ")))
    rows = rows.withColumn("clean", F.coalesce(clean, "text", F.lit("")))
    met = F.filter(F.filter("listed", lambda n: n["kind"] != "collision"), lambda n: F.regexp_like(F.col("clean"), n["pattern"]))
    rows = rows.withColumn("met", F.coalesce(met, F.array().cast("array<struct<kind: string, pattern: string>>")))
    sure = F.exists("met", lambda n: n["kind"] == "legal") | (F.size("met") >= 2) | (F.size("met") >= 1) & F.coalesce("linked", F.lit(False))
    return rows.select("doc_id", "vendor_id", (F.size("met") > 0).alias("named"), sure.alias("corroborated"))


def corroborated(docs: DataFrame, name: str, aliases: Sequence[str], collisions: Sequence[str] = ()) -> DataFrame:
    """Whether a text speaks of a party: its name occurs apart from collisions, and so does another of its names."""
    spec = name, tuple(aliases), tuple(collisions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, others, masked = spec
        for batch in batches:
            named, sure = [], []
            for body in batch.column(1).to_pylist():
                clean = text.mask(body or "", masked) if masked else body or ""
                named.append(text.has_name(own, clean))
                sure.append(named[-1] and any(text.has_name(a, clean) for a in others))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.bool_()), pa.array(sure, pa.bool_())], ["doc_id", "named", "corroborated"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, named boolean, corroborated boolean")


def best_candidate(rows: DataFrame) -> DataFrame:
    """Of each passage the candidate segment that is no trap, then strongest: by rank, relevance, specificity, codes, start."""
    order = [F.col("trap"), F.least("strength_rank", F.lit(3)), F.desc("rl"), F.desc("sp"), F.col("strength_rank"), F.desc("n_codes"), F.desc("n_providers"), F.col("start")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("passage_id").orderBy(*order))).where("place = 1").drop("place")


def dns_tokens(records: DataFrame, providers: Mapping[str, str]) -> DataFrame:
    """name, record -> a row per known token at a record's start: name, token, provider."""
    spark = records.sparkSession
    table = spark.createDataFrame([(k.lower(), v) for k, v in providers.items()], "token string, provider string")
    found = records.select("name", F.lower(F.regexp_extract("record", r"^([A-Za-z0-9_.-]+)[=:]", 1)).alias("token"))
    return found.where("token <> ''").join(small(table), "token").distinct()  # a row per known token


def traps(rows: DataFrame) -> DataFrame:
    """Items with why they must not count: definition (no term at all), source (excluded reliability), entity (another party)."""
    why = F.array_compact(F.array(F.when(F.col("ai_type") == "not_ai", "definition"), F.when(F.col("sr").isin("E", "F"), "source"), F.when(F.col("locus").isin("platform_supplier", "affiliate_inferred"), "entity")))
    return rows.withColumn("traps", why)
