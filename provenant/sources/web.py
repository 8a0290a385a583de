"""Payloads of web collectors as tables: sitemaps, links, DNS answers, filings, job boards, posts, archives, robots."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.functions import html, udfs
from provenant.functions import expressions as E


def sitemap_entries(body: str) -> list[tuple[str, str, str]]:
    """(kind, address, day): 'map' for child maps, 'page' for pages; a body that is no XML has none."""
    try:
        root = ET.fromstring(re.sub(r'\sxmlns(:\w+)?="[^"]*"', "", body.strip()))
    except ET.ParseError:
        return []
    out = []
    for kind, tag in (("map", "sitemap"), ("page", "url")):
        for node in root.iter(tag):
            where = (node.findtext("loc") or "").strip()
            if where:
                out.append((kind, where, (node.findtext("lastmod") or "").strip()[:10]))
    return out


def sitemaps(bodies: DataFrame) -> DataFrame:
    """key, body -> key, ordinal, kind, url, lastmod."""
    return udfs.spans(bodies, sitemap_entries, "kind string, url string, lastmod string", ["kind", "url", "lastmod"], key="key", body="body")


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, url, html -> page_id, target: absolute links, each once a page."""
    links = udfs.links
    return pages.select("page_id", F.explode(links(F.col("html"), F.col("url"))).alias("target"))


_DOH = "Status int, Answer array<struct<name: string, type: int, TTL: int, data: string>>"


def dns_records(answers: DataFrame, record_type: int) -> DataFrame:
    """name, resolver, body -> name, resolver, records (sorted, each once), or null where the body is none.

    TXT strings lose their quotes, and parts of one string are joined.
    """
    parsed = F.from_json("body", _DOH)
    data = F.transform(F.filter(F.coalesce(parsed["Answer"], F.array().cast("array<struct<name: string, type: int, TTL: int, data: string>>")), lambda a: a["type"] == record_type), lambda a: F.regexp_replace(F.regexp_replace(a["data"], r'"\s*"', ""), r'^"|"$', ""))
    return answers.select("name", "resolver", F.when(parsed["Status"].isNotNull(), F.array_sort(F.array_distinct(data))).alias("records"))


def agreed_records(records: DataFrame) -> DataFrame:
    """name -> records, agreed: the union of what resolvers say, and whether they said the same."""
    return records.groupBy("name").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("records")))).alias("records"),
        ((F.count_distinct("records") <= 1) & (F.count("records") == F.count(F.lit(1)))).alias("agreed"),
    )


def dns_coverage(agreed: DataFrame) -> DataFrame:
    """name, records, agreed -> name, status, note: resolvers that differ are an error of coverage, though the union of what they say
    is kept; no record at all is done too."""
    return agreed.select("name", F.when(F.col("agreed"), "done").otherwise("error").alias("status"), F.when(~F.col("agreed"), "resolvers differ").otherwise("").alias("note"))


_FILINGS = "hits struct<hits: array<struct<_id: string, _source: struct<ciks: array<string>, form: string, file_date: string, display_names: array<string>>>>>"


def filings(bodies: DataFrame) -> DataFrame:
    """Search results: accession, document, form, day, url."""
    rows = bodies.select(F.explode(F.from_json("body", _FILINGS)["hits"]["hits"]).alias("h"))
    number, name = F.split("h._id", ":")[0], F.split("h._id", ":")[1]
    cik = F.regexp_replace(F.get("h._source.ciks", F.lit(0)), "^0+", "")
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik, F.lit("/"), F.regexp_replace(number, "-", ""), F.lit("/"), name)
    return rows.select(number.alias("accession"), name.alias("document"), F.col("h._source.form").alias("form"), E.iso_date(F.col("h._source.file_date")).alias("filed"), url.alias("url"))


def registrants(vendors: DataFrame, listed: DataFrame) -> DataFrame:
    """vendor_id, name with the listed id of exactly the same name, forms and punctuation apart; never a like one."""
    own = listed.select(E.compact_key(F.col("title")).alias("name_key"), "cik").groupBy("name_key").agg(F.min("cik").alias("cik"), F.count_distinct("cik").alias("n")).where("n = 1").drop("n")
    return vendors.withColumn("name_key", E.compact_key(F.col("name"))).join(own, "name_key", "left").drop("name_key")


def postings(jobs: DataFrame, titles: str, terms: str, as_of: Column, months: int = 24) -> DataFrame:
    """Jobs whose title or body has a term and whose day, if any, is no older than so many months."""
    recent = F.col("posted").isNull() | (F.col("posted") >= E.months_before(as_of, months))
    return jobs.where((F.lower("title").rlike(titles) | F.lower("body").rlike(terms)) & recent)


_WORKDAY = "jobPostings array<struct<title: string, externalPath: string, postedOn: string>>"
_ORACLE = "items array<struct<requisitionList: array<struct<Id: string, Title: string, PostedDate: string>>>>"
_WORKABLE = "jobs array<struct<title: string, shortcode: string, published_on: string>>"


def job_lists(bodies: DataFrame) -> DataFrame:
    """vendor_id, platform (workday, oracle_orc, workable), body -> vendor_id, platform, job_id, title, posted (null: not told as a
    date). Other platforms and bodies that are none of theirs give no rows."""
    kinds = {
        "workday": (F.from_json("body", _WORKDAY)["jobPostings"], "externalPath", "title", "postedOn"),
        "oracle_orc": (F.flatten(F.from_json("body", _ORACLE)["items"]["requisitionList"]), "Id", "Title", "PostedDate"),
        "workable": (F.from_json("body", _WORKABLE)["jobs"], "shortcode", "title", "published_on"),
    }
    jobs = F.array().cast("array<struct<job_id: string, title: string, posted: date>>")
    for name, (found, key, title, day) in kinds.items():
        one = F.transform(found, (lambda k, t, d: lambda j: F.struct(j[k].alias("job_id"), j[t].alias("title"), E.iso_date(j[d]).alias("posted")))(key, title, day))
        jobs = F.when(F.col("platform") == name, one).otherwise(jobs)
    return bodies.select("vendor_id", "platform", F.explode(jobs).alias("j")).select("vendor_id", "platform", "j.*").where("job_id IS NOT NULL")


def detailed(jobs: DataFrame, details: DataFrame, titles: str, terms: str, as_of: Column, seeds: DataFrame) -> DataFrame:
    """Jobs (vendor_id, job_id, title, posted) that pass the title gate or are seeds, with their detail's body, that have a term (seeds
    needn't) and are not too old (seeds as well)."""
    seeded = seeds.select("vendor_id", "job_id").distinct().withColumn("seeded", F.lit(True))
    gated = jobs.join(seeded, ["vendor_id", "job_id"], "left").withColumn("seeded", F.coalesce("seeded", F.lit(False))).where(F.col("seeded") | F.lower("title").rlike(titles))
    rows = gated.join(details.select("vendor_id", "job_id", "body"), ["vendor_id", "job_id"])
    recent = F.col("posted").isNull() | (F.col("posted") >= E.months_before(as_of, 24))
    return rows.where(recent & (F.col("seeded") | F.lower("body").rlike(terms)))


def documents(captures: DataFrame) -> DataFrame:
    """capture_id, content_type, url, body, last_modified -> capture_id, kind, title, text, published, basis: each capture read by its
    kind. PDFs have no text here; JSON is its canonical text if it is an object, else as it is; null bodies are empty."""
    body = F.coalesce("body", F.lit(""))
    kind = E.document_kind(F.col("content_type"), F.col("url"), body)
    header = F.regexp_extract(F.coalesce("last_modified", F.lit("")), r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1)
    modified = F.date_format(F.try_to_date(E.known(header), "d MMM yyyy"), "yyyy-MM-dd")
    told = udfs.mapped(lambda b: list(html.published(b)), T.ArrayType(T.StringType()))(body)
    parsed = F.to_json(F.try_parse_json(body))
    rows = captures.select("capture_id", kind.alias("kind"), body.alias("body"), parsed.alias("parsed"), told.alias("told"), modified.alias("modified"))
    text = F.when(F.col("kind") == "html", udfs.main_text(F.col("body"))).when(F.col("kind") == "json", F.coalesce("parsed", "body")).when(F.col("kind") == "pdf", F.lit("")).otherwise(F.col("body"))
    by_page = (F.col("kind") == "html") & (F.col("told")[0] != "")
    return rows.select(
        "capture_id", "kind", F.when(F.col("kind") == "html", udfs.title(F.col("body"))).otherwise("").alias("title"), text.alias("text"),
        F.when(by_page, F.col("told")[0]).otherwise(F.coalesce("modified", F.lit(""))).alias("published"), F.when(by_page, F.col("told")[1]).when(F.col("modified").isNotNull(), "last-modified").otherwise("").alias("basis"),
    )


_POSTS = "array<struct<id: bigint, date: string, link: string, title: struct<rendered: string>, content: struct<rendered: string>>>"


def posts(bodies: DataFrame) -> DataFrame:
    """A blog's REST answer: id, day, link, title and text."""
    rows = bodies.select(F.explode(F.from_json("body", _POSTS)).alias("p"))
    return rows.select("p.id", E.iso_date(F.col("p.date")).alias("day"), "p.link", udfs.main_text(F.col("p.title.rendered")).alias("title"), udfs.main_text(F.col("p.content.rendered")).alias("text"))


def snapshots(bodies: DataFrame) -> DataFrame:
    """An archive's answer for a page: closest address and its day; rows without one are left out."""
    base = "$.archived_snapshots.closest"
    day = F.try_to_date(F.substring(F.get_json_object("body", f"{base}.timestamp"), 1, 8), "yyyyMMdd")
    return bodies.select("key", F.get_json_object("body", f"{base}.url").alias("url"), day.alias("day")).where("url IS NOT NULL")


def robots_mode(status: Column) -> Column:
    """2xx: its rules count; 4xx: everything is allowed; else nothing is."""
    return F.when(status.between(200, 299), "rules").when(status.between(400, 499), "allow").otherwise("deny")


def robots_allows(body: str, path: str, agent: str) -> bool:
    """Whether a robots file lets an agent fetch a path: of the groups that name the agent (else of those for all) the longest rule
    that fits decides, an allowing one among equals; * stands for anything, $ for the end. Without a rule that fits it may."""
    groups: dict[str, list[tuple[bool, str]]] = {}
    names: list[str] = []
    open_ = False
    for line in body.lstrip("\ufeff").splitlines():
        field, sign, value = line.split("#")[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if not sign:
            continue
        if field == "user-agent":
            names = [*names, value.lower()] if open_ else [value.lower()]
            open_ = True
            groups.setdefault(value.lower(), [])
        elif field in ("allow", "disallow"):
            open_ = False
            for name in names:
                if value:
                    groups[name].append((field == "allow", value))
        else:
            open_ = open_ and field not in ("crawl-delay",)
    rules = groups.get(agent.lower(), groups.get("*", []))

    def fits(rule: str) -> bool:
        end = rule.endswith("$")
        pattern = ".*".join(map(re.escape, (rule[:-1] if end else rule).split("*")))
        return bool(re.match(pattern + ("$" if end else ""), path))

    best = max(((len(rule), allowed) for allowed, rule in rules if fits(rule)), default=(0, True))
    return best[1]


def robots_decision(requests: DataFrame, files: DataFrame, agent: str) -> DataFrame:
    """Requests (origin, path) -> allowed, by the robots file of their origin (status, body): see robots_mode; no answer denies."""
    rows = requests.join(files.select("origin", "status", "body"), "origin", "left")
    by_rules = udfs.mapped(lambda body, path: robots_allows(body, path, agent), T.BooleanType())
    mode = robots_mode(F.coalesce("status", F.lit(0)))
    allowed = F.when(mode == "rules", by_rules(F.coalesce("body", F.lit("")), F.coalesce("path", F.lit("/")))).otherwise(mode == "allow")
    return rows.withColumn("allowed", allowed).drop("status", "body")


def bot_wall(status: Column, headers: Column, body: Column) -> Column:
    """A refusal that asks for a human."""
    marks = F.lower(F.concat_ws(" ", headers, body)).rlike(r"captcha|cf-ray|challenge|are you a human|access denied|bot detection")
    return F.coalesce(status.isin(403, 503) & marks, F.lit(False))


_MADE_OF = {"array": "ARRAY", "object": "OBJECT", "string": "STRING", "number": "(BIGINT|DECIMAL|DOUBLE)", "boolean": "BOOLEAN"}


def shape_problem(body: Column, required: Mapping[str, str]) -> Column:
    """Why a JSON reply has not the top-level shape asked for, the first reason, or null: no JSON, no object, a key that is missing
    or of another type (array, object, string, number, boolean)."""
    parsed = F.try_parse_json(body)
    problem = F.when(parsed.isNull(), "no json").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "no object")
    for key, kind in required.items():
        own = F.schema_of_variant(F.try_variant_get(parsed, f"$.{key}", "variant"))
        problem = problem.when(~F.coalesce(own.rlike(f"^{_MADE_OF[kind]}"), F.lit(False)), key)
    return problem


_CLAIM = "passage_id string, quote string, claim_kind string, subject string, named_providers array<string>, data_mentioned array<string>"


def typed_claims(replies: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """reply_id, body -> reply_id, ordinal, valid, and the claim's typed columns. A claim without passage, quote or a known kind
    is not valid; blank names and names that look like addresses are taken out. A body that is no object with claims has no rows."""
    raw = replies.select("reply_id", F.posexplode(F.from_json("body", "claims array<string>")["claims"]).alias("ordinal", "raw"))
    rows = raw.select("reply_id", "ordinal", F.from_json("raw", _CLAIM).alias("c")).select("reply_id", "ordinal", "c.*")
    there = (F.coalesce("passage_id", F.lit("")) != "") & (F.coalesce("quote", F.lit("")) != "") & F.coalesce(F.col("claim_kind").isin(*kinds), F.lit(False))
    clean = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: (F.trim(x) != "") & ~x.rlike(r"(?i)^(https?://|www\.)"))
    return rows.withColumn("valid", there).withColumns({c: clean(F.col(c)) for c in ("named_providers", "data_mentioned")})
