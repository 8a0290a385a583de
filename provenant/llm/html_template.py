"""HTML extraction by equivalence classes: templates deduced from pages of one host.

A token is an element's place (the path of block elements with their classes; its opening and closing count as two tokens) or a
block of text at a place. Its occurrence vector says how often each page of the host has it. Tokens with equal vectors are a
class; it is found without meeting the pages, as vectors are compared by a random sum over pages that partial aggregation adds
up. Classes of enough tokens and pages are valid. They nest by their places and make the host's template: text in the class of
an element around it is template text, what varies between a class's tokens are its slots.

The content is found on the template: from the outermost element that every page has once, down to the innermost one of its
class whose slots hold nearly all of the slots' text (links count against it), as long as no title of the slots is left
outside. A page that has elements of a nested class there goes on into these. The slots below are the main text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import small, written
from provenant.llm.url_tree import split_url

#: A valid class has so many tokens, on so many pages and on this share of the host's pages.
TOKENS, PAGES, SUPPORT = 2, 2, 0.2
#: Template text is on so many pages if an element with a name holds it and nothing else, else on so many: fewer may be copies.
NAMED_PAGES, PLAIN_PAGES = 3, 8
#: An element that holds this share of the slots' text around it is nearer to the content.
MOST = 0.85
#: (host, token) pairs that a task holds before it hands their sums on.
HELD = 100_000
#: Places and template texts that are broadcast; more of them are joined by a shuffle.
FEW = 200_000

#: No alternative can pass the next tag's opening unquoted, so unclosed tags cost no rescans.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>""", re.S)
_MARK = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "math", "canvas", "audio", "video", "noframes"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "ruby", "rt", "rp",
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An opening element ends these open ones by itself.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}

#: Fixed values of the HTML standard: elements that are never an article's text, and those that hold text only.
_NOT_MAIN = {"head", "nav", "aside", "footer", "form", "menu", "dialog", "button", "select", "header", "fieldset", "datalist"}
_TEXT_ONLY = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "li", "dt", "dd", "td", "th", "address", "figcaption", "caption", "legend", "summary"}
#: What the operator leaves out, as whole words of class, id or role, and the standard's landmark roles.
_OTHER = {"menu", "nav", "header", "footer", "sidebar", "notice", "cookie", "ad", "ads", "advert", "promo", "sponsored", "form", "comment", "comments"}
_ROLES = {"navigation", "banner", "complementary", "contentinfo", "search"}
_HEADING = re.compile(r"h[1-6]$")
#: Names of the content itself, whatever other names stand beside them, and words that speak of a neighbour.
_CONTENT = {"main", "content", "article", "post", "entry"}
_NEIGHBOUR = {"has", "with", "no", "without"}
_WORD = re.compile(r"[a-z]+")


def _not_main(marks: str) -> str:
    """Why marks say that an element is no content: 'header', 'other' or nothing."""
    names = marks.lower().split()
    if _CONTENT.intersection(names):
        return ""
    odd: set[str] = set()
    for name in names:
        words = _WORD.findall(name)
        if words and words[0] not in _NEIGHBOUR:
            odd.update(_OTHER.intersection(words), _ROLES.intersection(words))
    return "" if not odd else "header" if odd == {"header"} else "other"


@dataclass
class Parsed:
    """A page's elements by place, outer ones first: [place around, name, times, main, characters, link characters]; and its
    blocks of text in order: (place, text, link characters, main), decoded, white space as one space."""

    elements: dict[int, list] = field(default_factory=dict)
    texts: list[tuple[int, str, int, bool]] = field(default_factory=list)


#: The place that is around all elements.
TOP = 0


def _place(around: int, name: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{around}/{name}") - (1 << 63)


def parse(page: str) -> Parsed:
    """Elements and blocks of a page, in time in proportion to its length, however deep it nests.

    main is False in menus, headers (but for headings inside an article), footers, sidebars, notices, adverts, forms, comments
    and hidden parts.
    """
    out = Parsed({TOP: [TOP, "", 1, True, 0, 0]})
    stack: list[tuple[str, int, bool, str]] = [("", TOP, True, "")]  # tag, place, main, why not
    opened: Counter[str] = Counter()
    articles = 0  # open article and main elements that are content
    text: list[str] = []
    links = [0, 0]  # inside a link, characters in links

    def flush() -> None:
        joined = " ".join("".join(text).split())
        text.clear()
        linked, links[1] = links[1], 0
        if joined:
            place, main = stack[-1][1], stack[-1][2]
            linked = min(linked, len(joined))
            out.texts.append((place, joined, linked, main))
            row = out.elements[place]
            row[4] += len(joined)
            row[5] += linked

    def said(raw: str) -> None:
        plain = html.unescape(raw) if "&" in raw else raw
        text.append(plain)
        if links[0]:
            links[1] += len(plain.strip())

    def close(depth: int) -> None:
        nonlocal articles
        for gone, _, main, _ in stack[depth:]:
            opened[gone] -= 1
            articles -= main and gone in ("article", "main")
        del stack[depth:]

    at = 0
    while found := _TOKEN.search(page, at):
        if found.start() > at:
            said(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        closing = bool(found[1])
        if tag in _RAW:
            if not closing and not found[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in _INLINE:
            if tag == "a":
                links[0] = 0 if closing else 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if closing:
            if opened[tag] > 0:
                flush()
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
                links[0] = 0
            continue
        flush()
        ended = _ENDS.get(tag, ())
        if stack[-1][0] in ended:
            while stack[-1][0] in ended:
                close(len(stack) - 1)
        elif tag in _ENDS_P and any(x[0] == "p" for x in stack[-3:]):
            close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p"))
        marks = " ".join(a or b or c for _, a, b, c in _MARK.findall(found[3])) if found[3] else ""
        named = f"{tag}.{re.sub(r'[0-9]+', '#', marks)}" if marks else tag
        _, around, around_main, around_why = stack[-1]
        why = "header" if tag == "header" else "other" if tag in _NOT_MAIN else ""
        if not why and marks and tag not in ("html", "body", "article", "main"):
            why = _not_main(marks)
        if not why and found[3] and _HIDDEN.search(found[3]):
            why = "other"
        main = around_main and not why
        if not main and not why and around_why == "header" and _HEADING.match(tag) and articles:
            main = True  # the article's own title
        place = _place(around, named)
        stack.append((tag, place, main, why or ("" if main else around_why)))
        opened[tag] += 1
        articles += main and tag in ("article", "main")
        row = out.elements.setdefault(place, [around, named, 0, False, 0, 0])
        row[2] += 1
        row[3] = row[3] or main
    if at < len(page):
        said(page[at:])
    flush()
    return out


def _vector(page_key: str, count: int) -> int:
    """A page's entry in the random sum that stands for an occurrence vector: sums are equal if vectors are."""
    return xxhash.xxh64_intdigest(f"{count}|{page_key}") >> 2 & 0x3FFFFFFFFFFFFFF


def text_key(place: int, text: str) -> int:
    """The token of a block of text; never 0, which stands for the element itself."""
    return xxhash.xxh3_64_intdigest(f"{place}\n{text}") - (1 << 63) or 1


def occurrences(pages: DataFrame) -> DataFrame:
    """key, host, html -> host, token, text, around, name, pages, total, vector, chars, link_chars, main: each token's
    occurrences on its host.

    token is a place; text is 0 for the element itself, else the key of a block of text there. Blocks outside the main parts are
    no tokens, as they are left out anyway.
    """
    names = ["host", "token", "text", "around", "name", "pages", "total", "vector", "chars", "link_chars", "main"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], list] = {}

        def handed() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6]
            keys = [pa.array([k[i] for k in sums], pa.string() if i == 0 else pa.int64()) for i in range(3)]
            return pa.RecordBatch.from_arrays([*keys, *(pa.array([v[i] for v in sums.values()], kind) for i, kind in enumerate(kinds))], names)

        def add(key: tuple[str, int, int], around: int, name: str, vector: int, count: int, chars: int, linked: int, main: int) -> None:
            row = sums.setdefault(key, [around, name, *[0] * 6])
            row[2] += 1
            row[3] += count
            row[4] = row[4] + vector & 0x3FFFFFFFFFFFFFF
            row[5] += chars
            row[6] += linked
            row[7] += main

        for batch in small(batches):
            for key, host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = parse(page)
                vectors: dict[int, int] = {}
                for place, (around, name, count, main, chars, linked) in found.elements.items():
                    if count not in vectors:
                        vectors[count] = _vector(key, count)
                    add((host, place, 0), around, name, vectors[count], count, chars, linked, main)
                own: dict[tuple[int, int], list[int]] = {}
                for place, text, linked, main in found.texts:
                    if main:
                        row = own.setdefault((place, text_key(place, text)), [0, 0, 0])
                        row[0] += 1
                        row[1] += len(text)
                        row[2] += linked
                for (place, text), (count, chars, linked) in own.items():
                    if count not in vectors:
                        vectors[count] = _vector(key, count)
                    add((host, place, text), place, "", vectors[count], count, chars, linked, 1)
                if len(sums) >= HELD:
                    yield handed()
                    sums.clear()
        if sums:
            yield handed()

    schema = "host string, token long, text long, around long, name string, pages long, total long, vector long, chars long, link_chars long, main long"
    found = pages.select("key", "host", "html").mapInArrow(run, schema)
    wrap = F.sum(F.col("vector").cast("decimal(38,0)")) % F.lit(1 << 58).cast("decimal(20,0)")
    return found.groupBy("host", "token", "text").agg(
        F.max("around").alias("around"), F.max("name").alias("name"), *[F.sum(n).alias(n) for n in ("pages", "total", "chars", "link_chars", "main")], wrap.cast("long").alias("vector")
    )


def templates(tokens: DataFrame) -> DataFrame:
    """host -> tokens: those of the host's valid classes, as (token, text, around, name, vector, pages, total, chars, link_chars, main).

    A token needs a share of its host's pages, so a template is no larger than a few pages. An element's opening and closing are
    two tokens of its class; a text counts once. The host's pages are those of the place around all elements.
    """
    size = tokens.where((F.col("token") == TOP) & (F.col("text") == 0)).select("host", F.col("pages").alias("host_pages"))
    wide = tokens.join(size, "host").where((F.col("pages") >= PAGES) & (F.col("pages") >= SUPPORT * F.col("host_pages")))
    same = ["host", "vector", "pages", "total"]
    classes = wide.groupBy(*same).agg(F.sum(F.when(F.col("text") == 0, 2).otherwise(1)).alias("in_class"))
    valid = wide.join(classes.where(F.col("in_class") >= TOKENS), same)
    row = F.struct("token", "text", "around", "name", "vector", "pages", "total", "chars", "link_chars", (F.col("main") > 0).alias("main"))
    return valid.groupBy("host").agg(F.sort_array(F.collect_list(row)).alias("tokens"))


def _class_of(row: dict) -> tuple[int, int, int]:
    return row["vector"], row["pages"], row["total"]


def template_texts(tokens: list[dict]) -> list[dict]:
    """The tokens of text that nest in their class: an element at or above their place occurs on the same pages, as often. On few
    pages that may be copies, so there an element with a name must hold nothing but such text."""
    elements = {row["token"]: row for row in tokens if not row["text"]}
    inner: dict[int, list[int]] = {}
    for place, row in elements.items():
        if place != TOP:
            inner.setdefault(row["around"], []).append(place)
    order, todo = [], [TOP] if TOP in elements else []
    while todo:
        place = todo.pop()
        order.append(place)
        todo += inner.get(place, ())
    classes: dict[int, frozenset] = {}  # of the elements at and above a place; shared where nothing is new
    for place in order:
        kind, above = _class_of(elements[place]), classes[elements[place]["around"]] if place != TOP else frozenset()
        classes[place] = above if kind in above else above | {kind}
    alike = [row for row in tokens if row["text"] and row["pages"] >= NAMED_PAGES and _class_of(row) in classes.get(row["token"], ())]
    loose = {place: elements[place]["chars"] for place in order}  # characters that are no such text, then those of the subtree
    for row in alike:
        loose[row["token"]] -= row["chars"]
    for place in reversed(order):
        if place != TOP:
            loose[elements[place]["around"]] += loose[place]
    pure: dict[int, bool] = {}
    for place in order:
        pure[place] = place != TOP and (pure[elements[place]["around"]] or "." in elements[place]["name"] and loose[place] <= 0)
    return [row for row in alike if row["pages"] >= PLAIN_PAGES or pure[row["token"]]]


def slots(tokens: list[dict], fixed: list[dict]) -> dict[int, dict]:
    """The elements by place, with the text that is not the template's; those whose element around is not in the template are
    left out, with what is in them."""
    cut: dict[int, list[int]] = {}
    for row in fixed:
        own = cut.setdefault(row["token"], [0, 0])
        own[0] += row["chars"]
        own[1] += row["link_chars"]
    found = {row["token"]: row for row in tokens if not row["text"]}
    inner: dict[int, list[int]] = {}
    for place, row in found.items():
        if place != TOP:
            inner.setdefault(row["around"], []).append(place)
    out, todo = {}, [TOP] if TOP in found else []
    while todo:
        place = todo.pop()
        gone = cut.get(place, (0, 0))
        out[place] = found[place] | {"chars": found[place]["chars"] - gone[0], "link_chars": found[place]["link_chars"] - gone[1]}
        todo += inner.get(place, ())
    return out


def _title(name: str) -> int:
    tag = name.partition(".")[0]
    return int(tag[1]) if _HEADING.match(tag) else 9


def content(found: dict[int, dict], top: int = TOP, kinds: Collection[tuple] | None = None) -> int:
    """The innermost element of `top`'s class (or of these kinds) that holds the slots' text below top, and its title."""
    weight = {place: (row["chars"] - 2 * row["link_chars"]) * bool(row["main"]) for place, row in found.items()}
    titles = {place: _title(row["name"]) if row["main"] and row["chars"] > 0 else 9 for place, row in found.items()}
    inner: dict[int, list[int]] = {}
    for place in reversed(found):  # found has outer elements first
        if place != TOP:
            around = found[place]["around"]
            weight[around] += weight[place]
            titles[around] = min(titles[around], titles[place])
            inner.setdefault(around, []).append(place)
    kinds = {_class_of(found[top])} if kinds is None else kinds
    place, best = top, top
    while weight[place] > 0:
        nearest = max(inner.get(place, ()), key=lambda p: (weight[p], p), default=None)
        if nearest is None or weight[nearest] < MOST * weight[place] or titles[nearest] > titles[place]:
            break
        place = nearest
        row = found[place]
        if _class_of(row) in kinds and row["name"].partition(".")[0] not in _TEXT_ONLY:
            best = place
    return best


def places(found: DataFrame) -> DataFrame:
    """host, tokens -> tree_host, place, name, nested, fixed: the content's element of each host's template, the elements that
    pages of nested classes have once, and the keys of the template's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for tokens in batch.column(1).to_pylist():
                fixed = template_texts(tokens)
                own = slots(tokens, fixed)
                place = content(own) if TOP in own else None
                nested = [p for p, row in own.items() if row["total"] == row["pages"] and _class_of(row) != _class_of(own[TOP])]
                rows.append((place, own[place]["name"] if place is not None else None, nested, [row["text"] for row in fixed]))
            kinds = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["tree_host", "place", "name", "nested", "fixed"])

    return found.select("host", "tokens").mapInArrow(run, "tree_host string, place long, name string, nested array<long>, fixed array<long>")


def _own_elements(page: Parsed, fixed: Collection[int]) -> dict[int, dict]:
    """A page's own elements with the text of its slots, as slots() has them; those it has once are of the top's kind."""
    chars: dict[int, list[int]] = {}
    for place, text, linked, main in page.texts:
        if main and text_key(place, text) not in fixed:
            own = chars.setdefault(place, [0, 0])
            own[0] += len(text)
            own[1] += linked
    return {
        place: {"token": place, "text": 0, "around": around, "name": name, "vector": 0, "pages": 1, "total": count, "chars": chars.get(place, (0, 0))[0], "link_chars": chars.get(place, (0, 0))[1], "main": main}
        for place, (around, name, count, main, _, _) in page.elements.items()
    }


def main_text(page: str, place: int | None = None, nested: Collection[int] = (), fixed: Collection[int] = ()) -> str:
    """The slots' blocks below the content's element, joined by line feeds; a page without that element, or of a host without a
    template, is judged by its own elements. Template text (fixed) is cut; a page that has nothing else keeps it."""
    found = parse(page)
    own = _own_elements(found, fixed)
    if place is None or place not in own:
        place = content(own)
    elif own.keys() & nested:
        place = content({p: row | {"vector": int(p in nested)} for p, row in own.items()}, place, {(1, 1, 1)})
    inside: dict[int, bool] = {}
    for at, row in own.items():
        inside[at] = at == place or at != TOP and inside[row["around"]]
    blocks = [(text, text_key(at, text) in fixed) for at, text, _, main in found.texts if main and inside[at]]
    return "\n".join([text for text, cut in blocks if not cut] or [text for text, _ in blocks])


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars (code points), content (the name of the element chosen by the host's template).

    Null html is empty and gives an empty text; urls without a host share the template of the empty host. Repeated rows add
    to their host's counts as often as they occur; other columns are not read; an empty table gives no rows. A large host's pages
    stay where they are, as its template is one small row.
    """
    host, _ = split_url(F.col("url"))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    key = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit("|"), F.xxhash64("html").cast("string"))
    tokens = written(occurrences(rows.select(key.alias("key"), "host", "html")), "tokens")
    found = written(places(templates(tokens)), "places")
    held = found.agg(F.count(F.lit(1)).alias("hosts"), F.sum(F.size("nested") + F.size("fixed")).alias("keys")).first()
    if held["hosts"] + (held["keys"] or 0) <= FEW:
        found = F.broadcast(found)  # names and numbers, as many as counted; beyond that, Spark's skewed join splits a large host
    told = rows.join(found, F.col("host") == F.col("tree_host"), "left").select(F.col("page_id").cast("long"), "url", "html", "place", "nested", "fixed", "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            told = zip(*(c.to_pylist() for c in batch.columns[2:6]), strict=True)
            texts = [main_text(page, place, set(nested or ()), set(fixed or ())) for page, place, nested, fixed in told]
            sizes = pa.array([len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), sizes, batch.column(6)], ["page_id", "url", "text", "n_chars", "content"])

    return told.mapInArrow(run, "page_id long, url string, text string, n_chars long, content string")
