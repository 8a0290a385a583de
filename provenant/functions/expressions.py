"""Column expressions: dates, urls, hashes, patterns. All run in the JVM; null in gives null out unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An e-mail address: whatever stands before an @ without a space or delimiter, then labels and a last one of letters.
EMAIL = r"""[^\s@<>()\[\],;:"']+@([0-9A-Za-z-]+\.)+[A-Za-z]{2,}"""
#: What common credentials look like.
SECRETS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "access_key": r"\b(AKIA|ASIA)[0-9A-Z]{16}\b",
    "token": r"\b(ghp|gho|ghs|sk|pk|xoxb|xoxp)[_-][A-Za-z0-9_-]{16,}",
    "assignment": r"(?i)\b(api[_-]?key|secret|password|passwd|token)\b\s*[:=]\s*[^\s]{6,}",
}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, though use may name it in a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def known(value: Column) -> Column:
    """An empty string is not known."""
    return F.nullif(value, F.lit(""))


def months_apart(earlier: Column, later: Column) -> Column:
    """Whole months, a month less if the day of the month isn't reached."""
    return F.timestamp_diff("MONTH", earlier.cast("timestamp_ntz"), later.cast("timestamp_ntz")).cast("int")


def recency(published: Column, as_of: Column) -> Column:
    """T3 within 12 months, T2 within 24, T1 within 36, else T0; the future is 0 months ago, unknown is T0."""
    age = F.greatest(months_apart(published, as_of), F.lit(0))
    return F.when(published.isNull(), "T0").when(age <= 12, "T3").when(age <= 24, "T2").when(age <= 36, "T1").otherwise("T0")


def months_before(day: Column, months: int) -> Column:
    """The same day so many months earlier, or the month's last."""
    return F.add_months(day, -months)


def iso_date(text: Column) -> Column:
    return F.try_to_date(known(F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}", 0)))


def item_date(published: Column, retrieved: Column) -> Column:
    """Published, else retrieved; dates that are none don't count."""
    return F.coalesce(F.try_to_date(known(F.substring(published, 1, 10))), F.try_to_date(known(F.substring(retrieved, 1, 10))))


def written_date(day: Column) -> Column:
    return F.date_format(day, "d MMMM yyyy")


def host(url: Column) -> Column:
    """Lower-case host without port; '' if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def page_key(url: Column) -> Column:
    """For equality of pages: no scheme, www., fragment or trailing slash, all lower case; port and query stay."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"#.*$", ""), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^www\.", ""), r"/+$", "")


def match_key(url: Column) -> Column:
    """For matching: scheme and host lower case, the path as it is, no fragment or trailing slash."""
    head = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.concat(head, F.regexp_replace(F.regexp_replace(rest, r"#.*$", ""), r"/+$", ""))


def archived(url: Column) -> Column:
    """The page that an archive's address stands for, else the address."""
    return F.coalesce(known(F.regexp_extract(url, r"/web/\d{4,14}[a-z_]*/(.+)$", 1)), url)


def under(name: Column, domain: Column) -> Column:
    """Whether a host is a domain or below it."""
    return (name == domain) | name.endswith(F.concat(F.lit("."), domain))


def suffixes(name: Column) -> Column:
    """A host's domains, itself first: a.b.c, b.c, c."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def registrable(name: Column) -> Column:
    """The last two labels, or three where the last two are a country's second level."""
    parts = F.split(name, r"\.")
    last = F.when(F.regexp_like(name, F.lit(r"\.(co|com|org|net|ac|gov|edu)\.[a-z]{2}$")), 3).otherwise(2)
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - last + 1), last), ".")


def url_score(url: Column) -> Column:
    """Legal and policy pages first, then product and news ones; media files are worth nothing."""
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    score = F.lit(0)
    for words, points in ((r"privacy|terms|legal|policy|subprocessor", 5), (r"security|trust|compliance", 4), (r"product|platform|docs|help", 3), (r"blog|news|press|en/", 2)):
        score = score + F.when(path.rlike(words), points).otherwise(0)
    return F.when(path.rlike(r"\.(png|jpe?g|gif|svg|css|js|ico|zip|mp4|woff2?)$"), 0).otherwise(score)


def sha256(*parts: Column) -> Column:
    """Of the parts joined by bars, nulls as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def passage_id(doc_id: Column, start: Column, end: Column) -> Column:
    return F.substring(sha256(doc_id, start, end), 1, 16)


def item_key(url: Column, excerpt: Column) -> Column:
    return sha256(url, F.sha2(excerpt, 256))


#: What stands between the parts of a title: a bar, a dash or two, a dot or two colons, with white space around.
_BETWEEN = r"\s+(?:\||[-–—]{1,2}|·|•|::)\s+"


def title_keys(title: Column) -> Column:
    """The words of a title, and of each of its parts, in their order, where there are four or more; null gives null."""
    wholes = F.concat(F.array(F.lower(title)), F.split(F.lower(title), _BETWEEN))
    words = F.transform(wholes, lambda p: F.regexp_extract_all(p, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.size(w) >= 4), lambda w: F.array_join(w, " ")))


def word_shingles(text: Column, n: int) -> Column:
    """Runs of n words of lower-case letters and digits, each once."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))

    def runs(words: Column) -> Column:
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(bound(found, runs))


def serial_list(parts: Column) -> Column:
    """a; a and b; a, b, and c."""
    head = F.array_join(F.slice(parts, 1, F.size(parts) - 1), ", ")
    return F.when(F.size(parts) < 1, "").when(F.size(parts) == 1, parts[0]).when(F.size(parts) == 2, F.concat(parts[0], F.lit(" and "), parts[1])).otherwise(F.concat(head, F.lit(", and "), F.element_at(parts, -1)))


def compact_key(name: Column) -> Column:
    """Letters and digits of a name, lower case, without legal forms at its end."""
    bare = F.regexp_replace(F.lower(F.trim(name)), r"([ ,.]+(inc|ltd|llc|llp|corp|co|gmbh|ag|sa|plc|bv|nv|limited|corporation|company))+\.?$", "")
    return F.regexp_replace(bare, r"[^a-z0-9]", "")


def page_number(offsets: Column, at: Column) -> Column:
    """The page, from 1, that an offset is on, given where pages start."""
    return F.size(F.filter(offsets, lambda o: o <= at))


def ordered_distinct(values: Column) -> Column:
    """Case-insensitive, first spelling, in order."""
    return bound(F.transform(values, F.lower), lambda lower: F.filter(values, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1))


def clip(text: Column, budget: int) -> Column:
    """Within the budget, cut at a word and marked."""
    cut = F.regexp_replace(F.substring(text, 1, budget - 1), r"\s+\S*$", "")
    return F.when(F.length(text) <= budget, text).otherwise(F.concat(cut, F.lit("…")))


def dns_name(url: Column) -> Column:
    """The name that a DNS-over-HTTPS address asks for, lower case, without a dot at its end; '' if it asks for none."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"[?&]name=([^&#]*)", 1)
    return F.regexp_replace(F.lower(F.trim(F.try_url_decode(raw))), r"\.+$", "")


def bare_domain(value: Column) -> Column:
    """A web address or host as a lower-case host without www., port, path and dot at its end; null stays null."""
    rest = F.regexp_replace(F.lower(F.trim(value)), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(F.regexp_replace(rest, r"^[^/?#@]*@", ""), r"^[^/?#:]*", 0), r"^www\.", ""), r"\.+$", "")


def cache_key(model: Column, prompt_sha: Column, schema_sha: Column, payload_sha: Column, seed: Column) -> Column:
    return sha256(model, prompt_sha, schema_sha, payload_sha, seed)


def run_id(prefix: Column, as_of: Column, *parts: Column) -> Column:
    """prefix, the day's digits and eight digits of the parts' hash: equal runs have equal ids."""
    return F.concat_ws("-", prefix, F.date_format(as_of, "yyyyMMdd"), F.substring(sha256(*parts), 1, 8))


def request_gap(rate: Column, crawl_delay: Column) -> Column:
    """Seconds between requests of a host: what the rate asks for, or the delay if that is longer; no rate asks for nothing."""
    return F.greatest(F.when(rate > 0, 1 / rate).otherwise(0.0), F.coalesce(crawl_delay.cast("double"), F.lit(0.0)))


def first_fit(variants: Column, budget: int) -> Column:
    """The first of some texts that is within the budget, else the last one clipped; null without any."""
    fits = F.get(F.filter(variants, lambda v: F.length(v) <= budget), F.lit(0))
    return F.coalesce(fits, clip(F.try_element_at(variants, F.lit(-1)), budget))


def key_problems(keys: Column, wanted: list[str]) -> Column:
    """struct(missing, unknown): how a set of keys differs from what it must be."""
    have = F.array(*map(F.lit, wanted))
    return F.struct(F.array_sort(F.array_except(have, keys)).alias("missing"), F.array_sort(F.array_except(keys, have)).alias("unknown"))


def disagreements(one: Column, other: Column, keys: list[str]) -> Column:
    """The keys, in their order, that both maps have with different values."""
    differ = lambda k: F.map_contains_key(one, k) & F.map_contains_key(other, k) & (F.try_element_at(one, F.lit(k)) != F.try_element_at(other, F.lit(k)))
    return F.array_compact(F.array(*[F.when(F.coalesce(differ(k), F.lit(False)), F.lit(k)) for k in keys]))


def recut(spans: Column, start: Column, end: Column, body: Column) -> Column:
    """array(struct(code, start, end)) within a span that was cut anew: those that still lie in it, with their text."""
    kept = F.filter(spans, lambda s: (s["start"] >= start) & (s["end"] <= end) & (s["start"] < s["end"]))
    return F.transform(kept, lambda s: F.struct(s["code"].alias("code"), s["start"].alias("start"), s["end"].alias("end"), F.substring(body, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).alias("span")))


def review_problem(day: Column, recorded: Column, kind: Column, key: Column, value: Column, tiers: list[str]) -> Column:
    """Why a review record is not valid, the first reason, or null: its day, its time (UTC), or an override that names no tier."""
    iso = F.coalesce(day.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(day).isNotNull(), F.lit(False))
    utc = F.coalesce(recorded.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|\+00:?00)$") & F.try_to_timestamp(recorded).isNotNull(), F.lit(False))
    override = F.coalesce(kind == "tier_override", F.lit(False))
    return F.when(~iso, "date").when(~utc, "recorded_at").when(override & ~F.coalesce(key == "tier", F.lit(False)), "key").when(override & ~F.coalesce(value.isin(*tiers), F.lit(False)), "value")


def document_kind(content_type: Column, url: Column, head: Column) -> Column:
    """How a capture is read: pdf, json, html or text, by its first bytes (as text), its type and its address."""
    kind, path = F.lower(F.coalesce(content_type, F.lit(""))), F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"\?.*$", "")
    first = F.substring(F.coalesce(head, F.lit("")), 1, 2048)
    return (
        F.when(first.startswith("%PDF-") | kind.contains("pdf") | path.endswith(".pdf"), "pdf")
        .when(kind.contains("json") | path.endswith(".json"), "json")
        .when(kind.contains("html") | kind.contains("xml") | first.rlike(r"(?i)<(html|body|p|div)\b"), "html")
        .otherwise("text")
    )


def collector_rank(seeded: Column, family: Column, mandatory: Column) -> Column:
    """The order of collectors: seeds, mandatory families, the rest, archives last."""
    return F.when(seeded, 0).when(family == "HIST", 3).when(F.coalesce(mandatory, F.lit(False)), 1).otherwise(2)


def is_tracker(name: Column) -> Column:
    """Hosts that only measure or advertise."""
    return F.lower(name).rlike(r"(^|\.)(analytics|pixel|track(er|ing)?|ads?|beacon|metrics|stats|tagmanager|doubleclick)\.")


def route(url: Column, page_host: Column, kind: Column | None = None, method: Column | None = None, main_frame: Column | None = None) -> Column:
    """What a request of a page is: refused (it would send something, or leave the site with the whole page), inline data, media that
    a capture does without, a tracker, its own site, or another site. kind: the resource's type; unknown arguments don't refuse."""
    own = registrable(host(url)) == registrable(page_host)
    sends = ~F.coalesce(F.upper(method), F.lit("GET")).isin("GET", "HEAD") if method is not None else F.lit(False)
    leaves = F.coalesce(main_frame, F.lit(False)) & ~F.coalesce(own, F.lit(False)) if main_frame is not None else F.lit(False)
    heavy = F.coalesce(kind.isin("media", "websocket", "eventsource"), F.lit(False)) if kind is not None else F.lit(False)
    return (
        F.when(url.startswith("data:"), "inline").when(host(url) == "", "none").when(sends | leaves, "refused").when(heavy, "media").when(is_tracker(host(url)), "tracker")
        .when(own, "own").otherwise("other")
    )


def canonical_json(parsed: Column) -> Column:
    """A map as JSON with sorted keys: equal content, equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(parsed))))
