"""Scans with explicit schemas: run files, profiles, manual inboxes, curated seeds, stores, policies."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping, Sequence
from difflib import SequenceMatcher

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.functions import expressions as E
from provenant.functions import text
from provenant.operators import runs

SCHEMAS = {
    "profiles": "vendor_id string, name string, description string, service string, category string, website string, business_process string, operational_dependency string, data_accessed string, data_volume string",
    "captures": "capture_id string, vendor_id string, family string, collector string, url_requested string, url_final string, status int, content_type string, retrieved_at timestamp, size bigint, note string",
    "docs": "doc_id string, capture_id string, vendor_id string, family string, url string, title string, kind string, published string, date_basis string, text string, pages array<int>",
    "passages": "passage_id string, doc_id string, vendor_id string, start int, end int, text string, hits array<string>",
    "coverage": "vendor_id string, family string, mandatory boolean, status string, collector string, requests int, cap int, documents int, passages int, note string",
    "reviews": "seq bigint, kind string, vendor_id string, key string, value string, reason string, analyst string, date string",
    "runs": "run_id string, vendor_id string, as_of string, created_at timestamp",
}


def jsonl(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A run's file, typed; lines that are no JSON of that kind fail the read. An empty string means unknown, so it is null; 0 is a
    value."""
    rows = spark.read.schema(SCHEMAS[kind]).option("mode", "FAILFAST").json(path)
    return rows.select(*[E.known(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in rows.schema])


def profile_issues(rows: DataFrame, key: str, wanted: Sequence[str], categories: Sequence[str] = ()) -> DataFrame:
    """ordinal key, code, what: issues of profile rows instead of errors: E03 no name or key, E04 a key that occurs twice, E05 an empty
    wanted field, E06 an unknown category, E07 a website that is no address, E08 an example row."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    again = rows.where(~blank(key)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).alias("again_key"))
    checked = rows.join(again, rows[key] == F.col("again_key"), "left")
    found = [
        F.when(blank(key), F.struct(F.lit("E03").alias("code"), F.lit(key).alias("what"))),
        F.when(F.col("again_key").isNotNull(), F.struct(F.lit("E04").alias("code"), F.col(key).alias("what"))),
        *[F.when(blank(c), F.struct(F.lit("E05").alias("code"), F.lit(c).alias("what"))) for c in wanted],
    ]
    if categories and "category" in rows.columns:
        found.append(F.when(~blank("category") & ~F.col("category").isin(*categories), F.struct(F.lit("E06").alias("code"), F.col("category").alias("what"))))
    if "website" in rows.columns:
        found.append(F.when(~blank("website") & ~F.col("website").rlike(r"(?i)^(https?://)?[a-z0-9-]+(\.[a-z0-9-]+)+(/|$)"), F.struct(F.lit("E07").alias("code"), F.col("website").alias("what"))))
    if "name" in rows.columns:
        found.append(F.when(F.lower("name").rlike(r"^\s*(example|sample)\b"), F.struct(F.lit("E08").alias("code"), F.col("name").alias("what"))))
    return checked.select(F.col(key).alias("key"), F.explode(F.array_compact(F.array(*found))).alias("i")).select("key", "i.code", "i.what")


def map_headers(found: Sequence[str], aliases: Mapping[str, Sequence[str]], least: float = 85, margin: float = 5) -> tuple[dict[str, int], list[str]]:
    """Columns by header: an exact alias first, else the most like one if it is like enough and ahead of the next; and
    what is missing."""
    def key(x: str) -> str:
        return " ".join(text.tokens(x or ""))

    mapped: dict[str, int] = {}
    for name, own in aliases.items():
        keys = {key(a) for a in (name, *own)}
        exact = [i for i, h in enumerate(found) if key(h) in keys]
        if exact:
            mapped[name] = exact[0]
    for name, own in aliases.items():
        if name in mapped:
            continue
        rated = sorted(((max(text.token_sort_ratio(key(h), key(a)) for a in (name, *own)), -i) for i, h in enumerate(found) if i not in mapped.values()), reverse=True)
        if rated and rated[0][0] >= least and (len(rated) < 2 or rated[0][0] - rated[1][0] >= margin):
            mapped[name] = -rated[0][1]
    return mapped, [n for n in aliases if n not in mapped]


def sheet(spark: SparkSession, path: str, aliases: Mapping[str, Sequence[str]], header_rows: int = 10) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Profiles from a CSV export whose header is in one of the first rows; and issues (code, what) instead of errors.

    Only the first rows come to the driver; rows below are read on the cluster. Of several files the first by name has the header;
    a file is one partition, as its cells may have line ends, so its rows are in order.
    """
    raw = spark.read.option("header", False).option("multiLine", True).csv(path)
    raw = raw.withColumn("line_", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place")))
    top = raw.orderBy("line_").limit(header_rows).collect()
    best: tuple[int, dict[str, int], list[str]] = (-1, {}, list(aliases))
    for i, row in enumerate(top):
        mapped, missing = map_headers([str(v or "") for v in row[:-1]], aliases)
        if len(mapped) > len(best[1]):
            best = i, mapped, missing
    at, mapped, missing = best
    if at < 0:
        return spark.createDataFrame([], ", ".join(f"{n} string" for n in aliases)), [("E01", "no header row")]
    issues = [("E02", f"no column for {n}") for n in missing]
    columns = [(F.trim(F.col(raw.columns[mapped[n]])) if n in mapped else F.lit(None)).cast("string").alias(n) for n in aliases]
    header = F.struct(F.lit(top[at]["line_"]["file"]).alias("file"), F.lit(top[at]["line_"]["place"]).cast("long").alias("place"))
    rows = raw.where(F.col("line_") > header).select(*columns)
    return rows.where(F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in aliases]).isNotNull()), issues


def inbox(spark: SparkSession, path: str, families: Mapping[str, str], zone: str) -> tuple[DataFrame, DataFrame]:
    """Manual captures of a CSV (vendor_id, url, captured_at, file): those that can be used, and skipped ones with reasons.

    The family follows from the first pattern that fits the url; local times become UTC.
    """
    rows = spark.read.schema("vendor_id string, url string, captured_at string, file string").option("header", True).csv(path)
    family = F.lit(None).cast("string")
    for pattern, name in reversed(list(families.items())):
        family = F.when(F.lower("url").rlike(pattern), name).otherwise(family)
    when = F.to_utc_timestamp(F.try_to_timestamp("captured_at"), zone)
    rows = rows.withColumn("family", family).withColumn("retrieved_at", when)
    reason = F.when(F.nullif("vendor_id", F.lit("")).isNull(), "no vendor").when(~F.coalesce(F.col("url").rlike("^https?://"), F.lit(False)), "no url").when(F.col("retrieved_at").isNull(), "no time").when(F.col("family").isNull(), "no family")
    rows = rows.withColumn("skipped", reason)
    return rows.where("skipped IS NULL").drop("skipped"), rows.where("skipped IS NOT NULL")


def policy(source: str, required: Mapping[str, Mapping[str, type]] | None = None) -> dict:
    """A policy file's tables; driver-side and small. required: table -> key -> type; what is missing, unknown or of another type raises
    one ValueError that names all of it."""
    found = tomllib.loads(source)
    problems = []
    for table, keys in (required or {}).items():
        own = found.get(table)
        if not isinstance(own, dict):
            problems.append(f"no table {table}")
            continue
        problems += [f"{table}.{k} is missing" for k in keys if k not in own]
        problems += [f"{table}.{k} is unknown" for k in own if k not in keys]
        problems += [f"{table}.{k} is no {keys[k].__name__}" for k in keys if k in own and (not isinstance(own[k], keys[k]) or isinstance(own[k], bool) and keys[k] is not bool)]
    if problems:
        raise ValueError("; ".join(problems))
    return found


def replayed_as_of(newest: DataFrame) -> str:
    """The one day that the newest runs agree on."""
    days = [r[0] for r in newest.select("as_of").distinct().limit(2).collect()]
    if len(days) != 1:
        raise ValueError(f"newest runs have {'no' if not days else 'different'} days")
    return days[0]


def replayed(requests: DataFrame, captures: DataFrame) -> DataFrame:
    """Requests answered by the last capture of their address: ok, blocked_bot for a stored refusal, else replay_miss."""
    last = runs.latest(captures.select("url_requested", "capture_id", "status", "retrieved_at"), ["url_requested"], ["retrieved_at", "capture_id"])
    rows = requests.join(last, requests["url"] == last["url_requested"], "left").drop("url_requested")
    outcome = F.when(F.col("capture_id").isNull(), "replay_miss").when(F.col("status").isin(403, 503), "blocked_bot").when(F.col("status").between(200, 299), "ok").otherwise("error")
    return rows.withColumn("outcome", outcome)


def store(texts: DataFrame, path: str) -> DataFrame:
    """doc_id, text -> doc_id, text_sha: each text kept once under the hash of its bytes, in folders by the hash's first digit; what
    a folder has already is not written again. A null text is the empty one."""
    rows = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_sha", F.sha2("text", 256))
    fresh = rows.select("text_sha", "text").dropDuplicates(["text_sha"])
    try:
        fresh = fresh.join(texts.sparkSession.read.parquet(path).select("text_sha"), "text_sha", "left_anti")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    fresh.withColumn("shard", F.substring("text_sha", 1, 1)).write.mode("append").partitionBy("shard").parquet(path)
    return rows.select("doc_id", "text_sha")


def stored(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """wanted (text_sha and more) with the stored text, null if there is none, and whether it still has its hash."""
    held = spark.read.parquet(path).select("text_sha", "text")
    return wanted.join(held, "text_sha", "left").withColumn("intact", F.coalesce(F.sha2("text", 256) == F.col("text_sha"), F.lit(False)))


def unvisited_seeds(seeds: DataFrame, captures: DataFrame) -> DataFrame:
    """Seeds that nobody captured by hand."""
    manual = captures.where("manual").select("vendor_id", F.col("url_final").alias("url"))
    return seeds.join(manual, ["vendor_id", "url"], "left_anti")


def with_additions(run: DataFrame, additions: DataFrame, as_of: str) -> DataFrame:
    """A run's captures and the manual ones up to a day, each once."""
    later = additions.where(F.to_date("retrieved_at") <= F.lit(as_of).cast("date"))
    return run.unionByName(later, allowMissingColumns=True).dropDuplicates(["capture_id", "url_requested", "retrieved_at"])
