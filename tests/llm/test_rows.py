"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import public_tokenizers
import pytest

from provenant.llm import gru_lm, html_template, iblt, mixing, mpeg, packing, simhash, toxicity, url_tree, warc

DOCS = "doc_id long, text string, source string, lang string, n_chars long"
PAGES = "page_id long, url string, html string"
LONG = "word " * 30_000


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def odd_docs(spark):
    rows = [
        (1, None, None, None, None), (2, "", "a", "en", 0), (3, LONG, "a", "en", len(LONG)), (4, "one two", "b", "en", 7), (4, "one two", "b", "en", 7),
        (None, "no id here", "b", None, 10), (5, "one two", "c", "en", 7), (6, " \t\n ", "c", "en", 4), (7, "Ünï çödé 😀 text", "d", "xx", 15),
    ]
    return docs(spark, rows)


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

ON_DOCS = {
    "mpeg": lambda d: mpeg.features(mpeg.stored(d)),
    "packing": lambda d: packing.pack(d, TOKENIZER),
    "simhash": simhash.near_duplicates,
    "mixing": mixing.mix,
    "gru": gru_lm.score,
    "iblt": iblt.compare,
    "similar": simhash.without_near_duplicates,
    "mixed": mixing.mixed,
}


@pytest.mark.parametrize("name", ON_DOCS)
def test_odd_documents(spark, name):
    rows = ON_DOCS[name](odd_docs(spark)).collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    if name == "packing":
        assert {i for i in ids} == {(False, i) for i in range(1, 8)} | {(True, 0)}
        assert sum(r["length"] for r in rows if r["doc_id"] in (1, 2)) == 2
    elif name == "similar":
        # Wordless texts are one kind, so are the equal ones; each keeps its smallest id.
        assert sorted(r["doc_id"] or 0 for r in rows) == [0, 1, 3, 4, 7]
    elif name == "mixed":
        assert {r["doc_id"] for r in rows} <= {3, 4, 5, 7, None}
    else:
        assert ids == [(False, i) for i in (1, 2, 3, 4, 4, 5, 6, 7)] + [(True, 0)]


@pytest.mark.parametrize("name", ON_DOCS)
def test_empty_documents(spark, name):
    assert ON_DOCS[name](docs(spark, [])).collect() == []


@pytest.mark.parametrize("name", ON_DOCS)
def test_clashing_columns(spark, name):
    plain = docs(spark, [(i, f"some words of text number {i}", "s", "en", 1) for i in range(6)])
    extra = plain
    for column in ("fp", "row", "slice", "kind", "units", "ids", "start", "size", "target", "members", "row_key", "row_", "group", "word", "c"):
        extra = extra.selectExpr("*", f"'x' AS `{column}`")
    one, other = ON_DOCS[name](plain), ON_DOCS[name](extra)
    shown = [c for c in one.columns if c not in ("score",)]
    assert sorted(map(str, one.select(*shown).collect())) == sorted(map(str, other.select(*shown).collect()))


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "nonsense", ""), (None, "http://A.example.net/de/8x?q#f", "<p>Hi &amp; ho"), (3, "ftp://h", "x" * 2000), (3, "ftp://h", "x" * 2000), (2, "ftp://h/", "x" * 2000)]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS host", "'t' AS text", "2 AS template", "'p' AS place")
    texts = {(r["page_id"], r["url"]): r["text"] for r in html_template.extract(pages).collect()}
    assert texts[1, None] == "" and texts[2, "nonsense"] == "" and texts[None, rows[2][1]] == "Hi & ho"
    judged = {(r["page_id"], r["url"] if "url" in r else r["host"]): r for r in url_tree.judge_urls(pages).collect()}
    odd = judged[None, "a.example.net"]
    assert odd["path"] == "/de/8x" and odd["rule"] == "example.net/de/8" and odd["verdict"] == "block"
    assert judged[1, ""]["verdict"] == "allow" and judged[1, ""]["path"] == "" and judged[1, ""]["rule"] is None
    kinds = sorted((r["record_type"], r["record_id"]) for r in warc.read(warc.archives(pages)).collect())
    assert [k for k, _ in kinds].count("revisit") == 1 and len(kinds) == 6  # both rows of the largest id are responses
    empty = spark.createDataFrame([], PAGES)
    for operator in (html_template.extract, url_tree.judge_urls, lambda p: warc.read(warc.archives(p))):
        assert operator(empty).collect() == []


def test_toxicity_rows(spark):
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (61, None, None)], "doc_id long, quality int, toxic int")
    rows = [(i, f"plain words here {'vileword' if i % 3 == 0 else 'kindword'} number {i % 7} {i}", "s", None, None) for i in range(90)] + [(None, None, None, None, None), (3, "", "s", "x", 0)]
    judged = toxicity.judge(docs(spark, rows).selectExpr("*", "9 AS tox_abusive", "1 AS ids"), labels)
    out = judged.collect()
    assert len(out) == len(rows) and judged.columns[:5] == ["doc_id", "text", "source", "lang", "n_chars"]
    assert all(r["tox_rejected"] == ("vileword" in (r["text"] or "")) for r in out if r["text"])
    assert toxicity.judge(docs(spark, []), labels).collect() == []
    assert len(toxicity.judge(docs(spark, rows), labels.limit(0)).collect()) == len(rows)
