"""Queries of the text kernels: texts made around each row's number, and what SQL says must come out."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.functions import expressions as E
from provenant.functions import html, text, udfs
from provenant.operators import spans
from provenant.plans.tables import query, read

_S, _L, _D = T.StringType(), T.ArrayType(T.StringType()), T.DoubleType()


def _rows(spark, sf_dir):
    """k, n: the number as text, with a letter before it where a kernel would take digits for something else."""
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("n"))


def _with(pattern: str):
    """The row's number at each @ of a pattern."""
    return F.concat_ws("", *[x for i, part in enumerate(pattern.split("@")) for x in ([F.col("n")] if i else []) + [F.lit(part)]])


def _spans(kernel, pattern):
    return F.array_join(udfs.mapped(lambda t: [f"{a}-{b}" for a, b in kernel(t)], _L)(_with(pattern)), ",")


_N = "SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS n, length(CAST(c_custkey AS VARCHAR)) AS w FROM customer"


@query(f"""SELECT k, '"a' || n || '" b-c fin ... ''x''' AS plain, 'café ' || n || ' don’t' AS repaired, 'éclair "strasse" ' || n AS folded, 'éclairsthe' || n AS key FROM ({_N})""")
def normalised_texts(spark, sf_dir):
    return _rows(spark, sf_dir).select(
        "k", udfs.normalised(_with("“a@”  b—c ﬁn … ’x’")).alias("plain"), udfs.mapped(text.repair_mojibake, _S)(_with("cafÃ© @ donâ€™t")).alias("repaired"),
        udfs.folded(_with("ÉCLAIR “Straße” @")).alias("folded"), udfs.key_of(_with("Éclair's, the @!")).alias("key"),
    )


@query(f"""SELECT k, CAST(4 AS INT) AS start, 16 + w AS "end", k % 2 = 0 AS named, CASE WHEN k % 3 = 0 THEN 'exact' WHEN k % 3 = 1 THEN 'anchors' ELSE 'none' END AS how, 'This is the first part ' || n || '|and this is the second' AS parts FROM ({_N})""")
def located_texts(spark, sf_dir):
    places = udfs.mapped(lambda q, t: list(text.locate(q, t) or ()), T.ArrayType(T.IntegerType()))(_with('said "a@" - b'), _with("He  said “a@” — b."))
    named = udfs.mapped(lambda t: text.has_name("Acme AG", t), T.BooleanType())(F.when(F.col("k") % 2 == 0, _with("by Acme  AG, @")).otherwise(_with("by ACME-AGx@")))
    body = _with("Twenty or more different characters stand here @ times, then some words in between, and twenty-four others at the end.")
    quote = F.when(F.col("k") % 3 == 0, _with("DIFFERENT characters stand here @ times")).when(F.col("k") % 3 == 1, _with("Twenty or more different characters stand here @ times [...] and twenty-four others at the end.")).otherwise(_with("Nothing like it was ever said @"))
    how = udfs.mapped(lambda q, t: (text.locate_excerpt(q, t) or ("none", 0))[0], _S)(quote, body)
    parts = udfs.mapped(text.elision_parts, _L)(_with("This is the first part @ ... and this is the second … x"))
    rows = _rows(spark, sf_dir).select("k", places.alias("p"), named.alias("named"), how.alias("how"), F.array_join(parts, "|").alias("parts"))
    return rows.select("k", F.col("p")[0].alias("start"), F.col("p")[1].cast("long").alias("end"), "named", "how", "parts")


@query(f"""SELECT k, concat_ws(',', '0-' || (12 + w), (13 + w) || '-' || (23 + w), (24 + w) || '-' || (40 + w), (41 + w) || '-' || (45 + w)) AS sentences, concat_ws(',', '0-' || (5 + w), (6 + w) || '-' || (9 + w), (11 + w) || '-' || (19 + w), (20 + w) || '-' || (28 + w)) AS segments,
  CASE k % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'prose' WHEN 2 THEN 'nav' WHEN 3 THEN 'heading' ELSE 'code' END AS shape FROM ({_N})""")
def sentence_spans(spark, sf_dir):
    k = F.col("k") % 5
    piece = F.when(k == 0, _with("Home | About | Team | @")).when(k == 1, _with("This is sentence x@ that ends here.")).when(k == 2, F.lit("About Us")).when(k == 3, _with("A heading of some words without any end")).otherwise(F.lit("x = {a: [1], b: (2)};"))
    return _rows(spark, sf_dir).select("k", _spans(text.sentences, "Mr. A went @. Then left! No. 5 e.g. this? Done").alias("sentences"), _spans(text.segments, "One @. Two\n\n- item a\n- item b").alias("segments"), udfs.shape(piece).alias("shape"))


@query(f"""SELECT k, 'Language-models,model' AS hits, repeat(' ', 17) || n || repeat(' ', 18) AS masked, 'the,company,x' || n || ',status' AS tokens, 'a b c d e f|b c d e f x' || n AS shingles FROM ({_N})""")
def phrase_hits(spark, sf_dir):
    found = udfs.mapped(lambda t: [m[0] for m in text.phrase_pattern(["model", "language model"], plural=True).finditer(t)], _L)(_with("Language-models and a model, x@; supermodel model-x"))
    masked = udfs.mapped(lambda t: text.mask(t, ["air conditioning"]), _S)(_with("air conditioning @ Air  Conditioning"))
    shingles = udfs.mapped(lambda t: text.shingles(t, 6), _L)(_with("a b c d e f x@"))
    return _rows(spark, sf_dir).select("k", F.array_join(found, ",").alias("hits"), masked.alias("masked"), F.array_join(udfs.token_list(_with("The companies' x@ status")), ",").alias("tokens"), F.array_join(shingles, "|").alias("shingles"))


@query(f"""SELECT k, (k * 1000000) || ',1400000,' || n || '.5' AS numbers, (k * 1000000) || ' customer served' AS volumes, 'customer:' || (k * 12) AS counts, CASE WHEN k % 2 = 0 THEN 'use' END AS unnegated FROM ({_N})""")
def number_forms(spark, sf_dir):
    counts = udfs.mapped(lambda t: [f"{noun}:{n}" for noun, n in text.counts(t, ["customer"])], _L)(_with("@ retail customers per month and 40 times customers"))
    said = udfs.mapped(lambda t: text.unnegated("use", t), _S)(F.when(F.col("k") % 2 == 0, _with("We do not use @, but we use it")).otherwise(_with("We never use @")))
    volumes = udfs.mapped(text.volume_phrases, _L)(_with("@ million of the customers served daily"))
    return _rows(spark, sf_dir).select("k", F.array_join(udfs.number_list(_with("@ million, 1,400,000 and @.50")), ",").alias("numbers"), F.array_join(volumes, "|").alias("volumes"), F.array_join(counts, ",").alias("counts"), said.alias("unnegated"))


@query(f"""SELECT k, round(100.0::DOUBLE * (2 + w) / (3 + w), 6) AS indel, 100.0::DOUBLE AS sorted, 100.0::DOUBLE AS by_set, 100.0::DOUBLE AS part FROM ({_N})""")
def likeness_ratios(spark, sf_dir):
    indel = udfs.mapped(text.indel_ratio, _D)(_with("@abc"), _with("@abd"))
    return _rows(spark, sf_dir).select("k", F.round(indel, 6).alias("indel"), udfs.sort_ratio(_with("b a @"), _with("a @ b")).alias("sorted"), udfs.set_ratio(_with("a b @"), _with("a b @ c d")).alias("by_set"), udfs.part_ratio(_with("x@"), _with("aa x@ bb")).alias("part"))


@query(f"""SELECT k, 'Mail [EMAIL_1] or [EMAIL_2], then [EMAIL_1]; ask [PERSON_1] at [PHONE_1]' AS redacted, true AS restored FROM ({_N})""")
def redactions(spark, sf_dir):
    body = _with("Mail jane.@@corp.org or x@@y.example, then jane.@@corp.org; ask Dr. Jane Roe at +44 20 7946 0958".replace("@@", "@\x00"))
    body = F.regexp_replace(body, "\x00", "@")
    back = udfs.mapped(lambda t: text.unredact(*text.redact(t)) == t, T.BooleanType())
    return _rows(spark, sf_dir).select("k", udfs.redacted(body).alias("redacted"), back(body).alias("restored"))


@query(f"""SELECT k, 'Blue River Systems' AS capitalised, 'Acme' || n || ' Holdings (Zeta) dba Nova|Zeta|Acme' || n || ' Holdings|Nova|Acme' || n AS names, 'é' || n AS windows, 'ü' || n AS latin, 'hi' || n AS marked FROM ({_N})""")
def party_forms(spark, sf_dir):
    capital = udfs.mapped(lambda t: text.capitalised(t, ["language model"]), _L)(_with("we met Blue River Systems @ whose language model is new"))
    names = udfs.mapped(text.party_names, _L)(_with("Acme@ Holdings (Zeta) dba Nova"))
    decoded = lambda charset, header=None: udfs.mapped(lambda t: text.decode(t.encode(charset), header)[0], _S)
    return _rows(spark, sf_dir).select(
        "k", F.array_join(capital, "|").alias("capitalised"), F.array_join(names, "|").alias("names"), decoded("cp1252")(_with("é@")).alias("windows"),
        decoded("latin-1", "text/html; charset=iso-8859-1")(_with("ü@")).alias("latin"), decoded("utf-8-sig")(_with("hi@")).alias("marked"),
    )


@query(f"""SELECT k, 'T & ' || n AS title, 'Hello & ' || n || chr(10) || 'Second block' AS main, '2024-02-0' || (1 + k % 9) AS day, CASE k % 2 WHEN 0 THEN 'json_ld' ELSE 'meta' END AS basis, 'The footer has eight words and number ' || n || ' here' AS missed, 'Just ' || n AS fragment FROM ({_N})""")
def page_texts(spark, sf_dir):
    day = F.concat(F.lit("2024-02-0"), 1 + F.col("k") % 9)
    dated = F.when(F.col("k") % 2 == 0, F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"datePublished": "'), day, F.lit('T10:00:00Z"}]}</script>'))).otherwise(F.concat(F.lit('<meta property="article:published_time" content="'), day, F.lit('">')))
    page = F.concat(F.lit("<html><head><title> T &amp; "), "n", F.lit("</title>"), dated, F.lit("</head><body><nav>Menu</nav><div><p>Hello &amp; "), "n", F.lit("<p>Second <b>block</b></div><footer>The footer has eight words and number "), "n", F.lit(" here</footer></body></html>"))
    told = udfs.mapped(lambda t: list(html.published(t)), _L)(page)
    missed = udfs.mapped(lambda t: "|".join(html.missed_blocks(t, re.compile("eight"))), _S)(page)
    return _rows(spark, sf_dir).select("k", udfs.title(page).alias("title"), udfs.main_text(page).alias("main"), told[0].alias("day"), told[1].alias("basis"), missed.alias("missed"), udfs.main_text(_with("Just <i>@</i>")).alias("fragment"))


@query(f"""SELECT k, '10-110,600-620' AS windows, CAST(2 AS INT) AS earlier, 'no' AS signal, CASE WHEN k % 3 = 0 THEN '2024-01-0' || (1 + k % 9) WHEN k % 3 = 1 THEN '2023-12-31' END AS day, CAST(17 AS INT) AS cut_start, strftime(TIMESTAMP '2024-03-01 12:00:00' + to_minutes(k % 1000), '%Y-%m-%d %H:%M') AS utc FROM ({_N})""")
def window_rules(spark, sf_dir):
    windows = udfs.mapped(lambda t: [f"{a}-{b}" for a, b in text.hit_windows([(600, 620), (100, 110), (10, 15)])], _L)(F.col("n"))
    earlier = udfs.mapped(lambda t: text.occurrence_index("a" + t[:1], f"a{t} x a{t} y a{t}", 2 * len(t) + 8), T.IntegerType())(F.col("n"))
    signal = udfs.mapped(lambda t: text.signals(t).get("ai-train"), _S)(_with("User-agent: *\nContent-Signal: search=yes, ai-train=yes # @\ncontent-signal: AI-train = no"))
    published = F.when(F.col("k") % 3 == 0, F.concat(F.lit("2024-01-0"), 1 + F.col("k") % 9, F.lit("T01:00:00Z"))).when(F.col("k") % 3 == 1, "2024-13-99").otherwise("")
    retrieved = F.when(F.col("k") % 3 == 1, "2023-12-31 10:00").otherwise("nothing")
    cut = udfs.mapped(lambda t: text.fit_excerpt(t, 17, 22)[0], T.IntegerType())(_with("Intro words. The model @ is used here in production today. End."))
    utc = F.date_format(F.to_utc_timestamp(F.timestamp_add("MINUTE", (F.col("k") % 1000).cast("int"), F.lit("2024-03-01 13:00:00").cast("timestamp")), "Europe/Paris"), "yyyy-MM-dd HH:mm")
    return _rows(spark, sf_dir).select("k", F.array_join(windows, ",").alias("windows"), earlier.alias("earlier"), signal.alias("signal"), E.item_date(published, retrieved).cast("string").alias("day"), cut.alias("cut_start"), utc.alias("utc"))


_HAS = r"regexp_matches(lower(text), '(^|[^\p{L}\p{N}_-])(the|und|que)($|[^\p{L}\p{N}_-])')"


@query(rf"""
WITH p AS (SELECT doc_id, {_HAS} AS held FROM documents) SELECT doc_id, held FROM p
""")
def documents_with_terms(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = spans.passages(docs, ("the", "und", "que")).select("doc_id").distinct().withColumn("held", F.lit(True))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("held", F.lit(False)).alias("held"))
