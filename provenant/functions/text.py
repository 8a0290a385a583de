"""Text kernels on plain strings: normalisation with offsets, location, sentences, folding, redaction, numbers, ratios.

Offsets are code points of the source text throughout. Kernels take and return Python values; the Arrow UDFs over them
are in provenant.functions.udfs.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Sequence

import numpy as np

# Typographic characters and the plain ones that stand for them.
QUOTES = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "′": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "″": '"', "«": '"', "»": '"'}
DASHES = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-"}
INVISIBLE = {"​", "‌", "‍", "⁠", "﻿", "­"}

#: Words whose full stop ends no sentence: of the English suppressions of Unicode's CLDR, those of prose and companies.
ABBREVIATIONS = {
    "adj", "approx", "aug", "capt", "co", "col", "conn", "cont", "corp", "dec", "def", "dept", "diff", "dr", "e.g", "est", "etc", "ex", "exec", "feb", "fig", "gen", "gov", "hon", "i.e", "inc", "jan", "jr",
    "lt", "ltd", "maj", "mar", "mgr", "min", "misc", "mr", "mrs", "ms", "mt", "n.y", "no", "nov", "nr", "num", "oct", "org", "ph.d", "phys", "pp", "prof", "rev", "sep", "sept", "sgt", "sr", "st",
    "u.k", "u.s", "vs", "yr",
}


def repair_c1(text: str) -> str:
    """C1 control characters are what cp1252 has in their place, where it has something."""

    def one(match: re.Match) -> str:
        try:
            return match[0].encode("latin-1").decode("cp1252")
        except UnicodeDecodeError:
            return match[0]

    return re.sub("[\x80-\x9f]", one, text)


def normalise(text: str) -> tuple[str, list[int]]:
    """NFKC, quotes and dashes plain, invisible characters out, white space as one space; and, for each character of
    the result, where it comes from in text. Leading and trailing space is left out."""
    out: list[str] = []
    at: list[int] = []
    space = -1
    for i, source in enumerate(text):
        if source in INVISIBLE:
            continue
        plain = QUOTES.get(source) or DASHES.get(source) or unicodedata.normalize("NFKC", repair_c1(source))
        for c in plain:
            if c.isspace():
                space = i if space < 0 and out else space
                continue
            if space >= 0:
                out.append(" ")
                at.append(space)
                space = -1
            out.append(c)
            at.append(i)
    return "".join(out), at


def repair_mojibake(text: str) -> str:
    """UTF-8 that was read as cp1252 or latin-1, read again; runs that are no such thing stay."""

    def one(match: re.Match) -> str:
        for charset in ("cp1252", "latin-1"):
            try:
                return match[0].encode(charset).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
        return match[0]

    return re.sub("[Â-ô][\u0080-ÿŒ-™]{1,3}", one, text)


def locate(quote: str, text: str) -> tuple[int, int] | None:
    """Where a quote stands in a text: as it is, else both normalised, else the quote's encoding repaired as well."""
    if not quote.strip():
        return None
    at = text.find(quote)
    if at >= 0:
        return at, at + len(quote)
    plain, places = normalise(text)
    for wanted in (normalise(quote)[0], normalise(repair_mojibake(quote))[0]):
        at = plain.find(wanted) if wanted else -1
        if at >= 0:
            return places[at], places[at + len(wanted) - 1] + 1
    return None


def name_pattern(name: str) -> re.Pattern:
    """A name as whole words: no letter, digit or hyphenated part may go on, and no decimals after a final digit."""
    body = r"[\s-]+".join(re.escape(p) for p in re.split(r"[\s-]+", fold(name)) if p)
    return re.compile(rf"(?<![\w-]){body}(?![\w-])(?!\.\d)")


def has_name(name: str, text: str) -> bool:
    return bool(fold(name).strip()) and bool(name_pattern(name).search(fold(text)))


def fold(text: str) -> str:
    """For comparison: NFKC, no invisible characters, plain quotes and dashes, case folded."""
    kept = "".join(QUOTES.get(c) or DASHES.get(c) or c for c in text if c not in INVISIBLE)
    return unicodedata.normalize("NFKC", kept).casefold()


def comparison_key(text: str) -> str:
    return "".join(c for c in fold(text) if c.isalnum())


_MARK = re.compile(r"[.!?]+|\n\s*")
_ITEM = re.compile(r"[-*•‣●]\s")


def _past(text: str, at: int, kinds: tuple[str, ...]) -> int:
    """Past punctuation of these Unicode categories, and straight quotes."""
    while at < len(text) and (text[at] in "\"'" or unicodedata.category(text[at]) in kinds):
        at += 1
    return at


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of sentences, without white space around.

    A sentence ends at end marks, with what closes behind them, if white space and then a capital or digit follow, perhaps behind
    something that opens; not at a full stop after an abbreviation or an initial. It also ends at a blank line and before a list's item.
    """
    spans, start = [], 0
    for mark in _MARK.finditer(text):
        if mark.start() < start:
            continue
        if mark[0][0] == "\n":
            if mark[0].count("\n") < 2 and not _ITEM.match(text, mark.end()):
                continue
            end, after = mark.span()
        else:
            end = after = _past(text, mark.end(), ("Pe", "Pf"))
            while after < len(text) and text[after].isspace():
                after += 1
            opens = _past(text, after, ("Ps", "Pi"))
            if after == end or opens >= len(text) or not (text[opens].isupper() or text[opens].isdigit()):
                if not (after > end and "\n" in text[end:after].strip(" \t") and (text[end:after].count("\n") > 1 or _ITEM.match(text, after))):
                    continue
            elif mark[0] == ".":
                words = text[start : mark.start()].rsplit(None, 1)
                last = words[-1].lstrip("\"'([").lower() if words and not text[mark.start() - 1].isspace() else ""
                if last in ABBREVIATIONS or len(last) == 1 and last.isalpha():
                    continue
        spans.append((start, end))
        start = after
    spans.append((start, len(text)))
    out = []
    for a, b in spans:
        part = text[a:b]
        lead = len(part) - len(part.lstrip())
        if part.strip():
            out.append((a + lead, a + len(part.rstrip())))
    return out


def segments(text: str) -> list[tuple[int, int]]:
    """Sentences cut finer: at list items, at navigation marks, and where two are glued without a space."""
    out = []
    for a, b in sentences(text):
        start = a
        for match in re.finditer(r"(?<=[a-zß-ÿ][.!?])(?=[A-ZÀ-Þ][a-z])|\s+[|›»>]\s+|;\s*\n|\n", text[a:b]):
            end = a + match.start()
            if text[start:end].strip():
                out.append((start, end))
            start = a + match.end()
        if text[start:b].strip():
            out.append((start, b))
    return out


def shape(segment: str) -> str:
    """code, table, nav, heading or prose, by shares of characters and words."""
    words = segment.split()
    if not words:
        return "nav"
    marks = sum(c in "{}();=<>[]_/\\" for c in segment) / len(segment)
    digits = sum(c.isdigit() for c in segment) / len(segment)
    if marks > 0.12:
        return "code"
    if segment.count("\t") + segment.count("|") >= 3 or digits > 0.4:
        return "table"
    ended = bool(re.search(r"[.!?][\"')\]”]*$", segment.strip()))
    capital = sum(w[0].isupper() for w in words) / len(words)
    if len(words) <= 3 and not ended:
        return "nav"
    if len(words) <= 12 and not ended:
        return "heading"
    return "prose" if ended or capital < 0.6 else "nav"


def phrase_pattern(phrases: Iterable[str], plural: bool = False) -> re.Pattern:
    """Whole-word phrases, longest first; a space also fits a hyphen, dash or line end; an optional plural s."""
    gap = r"(?:\s+|\s*[-‐-―]\s*)"
    bodies = [gap.join(re.escape(w) for w in p.split()) for p in sorted(set(phrases), key=lambda p: (-len(p), p)) if p.split()]
    return re.compile(rf"(?<![\w-])(?:{'|'.join(bodies)}){'(?:s|es)?' if plural else ''}(?![\w-])", re.IGNORECASE) if bodies else re.compile(r"(?!)")


def mask(text: str, phrases: Iterable[str]) -> str:
    """Phrases overwritten by as many spaces, so offsets stay."""
    return phrase_pattern(phrases).sub(lambda m: " " * len(m[0]), text)


def tokens(text: str) -> list[str]:
    """Folded words without possessives, plural forms cut lightly."""
    found = re.findall(r"[\w]+(?:['][\w]+)*", fold(text))
    out = []
    for w in found:
        w = w.removesuffix("'s").replace("'", "")
        if len(w) > 4 and w.endswith("ies"):
            w = w[:-3] + "y"
        elif len(w) > 3 and w.endswith("s") and not w.endswith(("ss", "us", "is")):
            w = w[:-1]
        if w:
            out.append(w)
    return out


def shingles(text: str, n: int = 6) -> list[str]:
    words = tokens(text)
    return sorted({" ".join(words[i : i + n]) for i in range(len(words) - n + 1)})


_SCALE = {"hundred": 100, "thousand": 1_000, "k": 1_000, "million": 1_000_000, "m": 1_000_000, "mn": 1_000_000, "billion": 1_000_000_000, "bn": 1_000_000_000, "b": 1_000_000_000}
_NUMBER = re.compile(r"(?<![\w.])(\d{1,3}(?:,\d{3})+|\d+)(\.\d+)?(?:\s?(hundred|thousand|million|billion|bn|mn|k|m|b)\b)?", re.I)


def numbers(text: str) -> list[str]:
    """Numbers in one form: '1.4 million' and '1,400,000' are 1400000."""
    from decimal import Decimal

    out = []
    for whole, part, scale in _NUMBER.findall(text):
        value = Decimal(whole.replace(",", "") + part) * _SCALE.get(scale.lower(), 1)
        text_value = format(value, "f")
        out.append(text_value.rstrip("0").rstrip(".") if "." in text_value else text_value)
    return out


_SMALL = {"a", "an", "the", "of", "and", "or", "in", "on", "to", "for", "with", "per", "by", "at", "from", "is", "are", "was", "were", "than", "more", "over"}


def volume_phrases(text: str) -> list[str]:
    """A number with the one or two content words that follow it, in one form."""
    out = []
    for match in _NUMBER.finditer(text):
        words = [w for w in tokens(text[match.end() : match.end() + 80]) if w not in _SMALL][:2]
        if words:
            out.append(" ".join([numbers(match[0])[0], *words]))
    return out


_PERIOD = {"day": 365, "week": 52, "month": 12, "quarter": 4, "year": 1, "annum": 1}


def counts(text: str, nouns: Sequence[str], vetoes: Sequence[str] = ("times", "daily", "weekly", "monthly", "hours", "minutes")) -> list[tuple[str, int]]:
    """(noun, yearly count): a number, at most three plain words, and the noun; a frequency word between vetoes; a
    following 'per month' and the like makes it yearly."""
    found = []
    for noun in nouns:
        tail = re.compile(rf"((?:\s+[a-z-]+){{0,3}}?)\s+{re.escape(noun)}(?:s|es)?\b(?:\s+(?:per|a|each|every)\s+({'|'.join(_PERIOD)})\b)?", re.I)
        for match in _NUMBER.finditer(text):
            after = tail.match(text, match.end())
            if after and not set(after[1].lower().split()) & set(vetoes):
                found.append((noun, int(float(numbers(match[0])[0]) * _PERIOD.get((after[2] or "year").lower(), 1))))
    return found


_NEGATION = re.compile(r"\b(?:no|not|never|without|neither|nor|cannot|can't|don't|doesn't|isn't|aren't|won't|none)\b", re.I)


def unnegated(pattern: str, text: str) -> str | None:
    """The first match that its clause doesn't negate before it."""
    for match in re.finditer(pattern, text, re.I):
        clause = re.split(r"[.;:!?\n]|,\s+(?:but|and|while)\b|\bbut\b", text[: match.start()])[-1]
        if not _NEGATION.search(clause):
            return match[0]
    return None


def indel_ratio(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over both lengths; two empty strings are alike."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    # Bit-parallel: one integer holds a row of the table.
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit) | (row - hit)
    common = len(a) - (row & (1 << len(a)) - 1).bit_count()
    return 200.0 * common / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio of the common words alone and with either rest; a side without words has ratio 0."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    one, other = (" ".join(filter(None, [both, " ".join(sorted(s - (x & y)))])) for s in (x, y))
    return max(indel_ratio(one, other), indel_ratio(both, one) if both else 0.0, indel_ratio(both, other) if both else 0.0)


def partial_ratio(needle: str, text: str) -> tuple[float, int]:
    """The best ratio of the shorter string with any stretch of its length in the other, and where it is first.

    Every stretch counts. What a stretch shares with the needle in whatever order bounds what it shares in order, so stretches are
    compared from the largest bound down, many at once, until no bound is better than what was found.
    """
    if len(needle) > len(text):
        needle, text = text, needle
    if not needle:
        return 0.0, 0
    at = text.find(needle)
    if at >= 0:
        return 100.0, at
    width = len(needle)
    coded = lambda x: np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, own, counts = np.unique(coded(needle), return_inverse=True, return_counts=True)
    letters = np.searchsorted(kinds, coded(text)).clip(max=len(kinds) - 1)
    letters[kinds[letters] != coded(text)] = len(kinds)
    bound = np.zeros(len(text) - width + 1, np.int32)
    for kind, count in enumerate(counts):
        seen = np.concatenate([[0], np.cumsum(letters == kind, dtype=np.int32)])
        bound += np.minimum(seen[width:] - seen[:-width], count)
    order, best, place, done = np.argsort(-bound, kind="stable"), -1, 0, 0
    while done < len(order) and bound[order[done]] >= best:
        starts = order[done : done + (4096 if done else 64)]
        done += len(starts)
        starts = starts[(bound[starts] > best) | (bound[starts] == best) & (starts < place)]
        if len(starts):
            common = _common(own, len(kinds), letters, starts)
            top = common.max()
            first = starts[common == top].min()
            if top > best or top == best and first < place:
                best, place = top, first
    return indel_ratio(needle, text[place : place + width]), int(place)


def _common(own: np.ndarray, kinds: int, letters: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The longest common subsequence of a needle (own) with the stretch of its length at each start: indel_ratio's rows in words of
    64 bits, one row a stretch. Letters that the needle lacks have the number `kinds`."""
    words, one = -(-len(own) // 64), np.uint64(1)
    masks = np.zeros((words, kinds + 1), np.uint64)
    for i, kind in enumerate(own):
        masks[i // 64, kind] |= one << np.uint64(i % 64)
    rows = np.full((words, len(starts)), ~np.uint64(0))
    for i in range(len(own)):
        here, carry = letters[starts + i], np.uint64(0)
        for word in range(words):
            hit = rows[word] & masks[word][here]
            total = rows[word] + hit
            over = total < hit
            total += carry
            over |= total < carry
            rows[word] = total | (rows[word] - hit)
            carry = over.astype(np.uint64)
    rows[-1] &= ~np.uint64(0) >> np.uint64(64 * words - len(own))
    return len(own) - np.bitwise_count(rows).sum(axis=0, dtype=np.int64)


def locate_excerpt(excerpt: str, text: str, least: float = 90.0) -> tuple[str, float] | None:
    """(how, score): exact, by its first and last 24 characters, or by the best partial ratio on folded text."""
    a, b = (" ".join(fold(x).split()) for x in (excerpt, text))
    if not a:
        return None
    if a in b:
        return "exact", 100.0
    if len(a) >= 48:
        start = b.find(a[:24])
        end = b.find(a[-24:], start) if start >= 0 else -1
        if start >= 0 and 0 <= end + 24 - start <= 1.5 * len(a):
            return "anchors", indel_ratio(a, b[start : end + 24])
    score, _ = partial_ratio(a, b)
    return ("fuzzy", score) if score >= least else None


_SENSITIVE = (
    ("EMAIL", re.compile(r"""[^\s@<>()\[\],;:"']+@(?:[0-9A-Za-z-]+\.)+[A-Za-z]{2,}""")),
    ("PHONE", re.compile(r"(?<![\w.])\+?\d[\d ()/-]{7,}\d(?![\w.])")),
    ("PERSON", re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?")),
)


def redact(text: str) -> tuple[str, dict[str, str]]:
    """E-mails, phone numbers and titled persons as numbered placeholders, equal ones alike, and what they stand for."""
    known: dict[tuple[str, str], str] = {}
    for kind, pattern in _SENSITIVE:

        def one(match: re.Match, kind: str = kind) -> str:
            return known.setdefault((kind, match[0]), f"[{kind}_{1 + sum(k == kind for k, _ in known)}]")

        text = pattern.sub(one, text)
    return text, {mark: value for (_, value), mark in known.items()}


def unredact(text: str, marks: dict[str, str]) -> str:
    for mark in sorted(marks, key=lambda m: (-len(m), m)):
        text = text.replace(mark, marks[mark])
    return text


def elision_parts(excerpt: str, least: int = 12) -> list[str]:
    """What stands between ellipses, parts of at least so many characters."""
    parts = [p.strip() for p in re.split(r"\s*(?:\[?\.{3,}\]?|\[?…\]?)\s*", excerpt)]
    return [p for p in parts if len(p) >= least]


def capitalised(text: str, terms: Sequence[str], reach: int = 80, longest: int = 3) -> list[str]:
    """Runs of capitalised words within reach of a term, in order, each once."""
    out: dict[str, None] = {}
    hits = [m.span() for m in phrase_pattern(terms).finditer(text)]
    for match in re.finditer(r"\b[A-Z][\w&.-]*(?:\s+[A-Z][\w&.-]*)*", text):
        if any(match.start() < b + reach and match.end() > a - reach for a, b in hits):
            words = match[0].rstrip(".").split()
            if not phrase_pattern(terms).fullmatch(" ".join(words)):
                out[" ".join(words[:longest])] = None
    return list(out)


def join_list(parts: Sequence[str]) -> str:
    """a; a and b; a, b, and c."""
    return parts[0] if len(parts) == 1 else " and ".join(parts) if len(parts) < 3 else f"{', '.join(parts[:-1])}, and {parts[-1]}"


def clip(text: str, budget: int) -> str:
    """Within the budget, cut at a word and marked."""
    if len(text) <= budget:
        return text
    cut = text[: max(0, budget - 1)]
    return (cut.rsplit(" ", 1)[0] if " " in cut else cut).rstrip(" ,;:") + "…"


_LEGAL = {"inc", "incorporated", "ltd", "limited", "llc", "llp", "corp", "corporation", "co", "company", "gmbh", "ag", "sa", "plc", "bv", "nv", "holdings", "group"}


def compact_name(name: str) -> str:
    """Letters and digits of a name without its legal form."""
    words = re.findall(r"\w+", fold(name))
    while len(words) > 1 and words[-1] in _LEGAL:
        words.pop()
    return "".join(words)


def party_names(name: str) -> list[str]:
    """What a party may be called: the name, what parentheses or d/b/a add, and a first word long enough to tell it."""
    out = [name.strip()]
    out += [p.strip() for p in re.findall(r"\(([^)]+)\)", name)]
    base = re.sub(r"\([^)]*\)", " ", name)
    parts = re.split(r"\s+(?:d/b/a|dba|formerly|f/k/a)\s+", base, flags=re.I)
    out += [" ".join(p.split()) for p in parts]
    first = re.match(r"\w{5,}", parts[0].strip())
    if first and first[0].lower() not in _LEGAL:
        out.append(first[0])
    return list(dict.fromkeys(p for p in out if p))


def fit_excerpt(text: str, start: int, end: int, least: int = 25, most: int = 600) -> tuple[int, int]:
    """A span widened to at least, or cut to at most, so many characters around its start, at clauses, else at words."""
    end = min(end, len(text))
    if end - start > most:
        cut = text[start : start + most]
        clause = max(cut.rfind(c) for c in (". ", "; ", ", ", "\n"))
        word = cut.rfind(" ")
        end = start + (clause + 1 if clause > most // 2 else word if word > 0 else most)
    while end - start < least and (start > 0 or end < len(text)):
        if end < len(text):
            after = re.compile(r"\s*\S+").match(text, end)
            end = after.end() if after else len(text)
        elif start > 0:
            start = max(text.rfind(" ", 0, max(0, start - 1)) + 1, 0) if start > 1 else 0
    return start, end


def decode(data: bytes, header: str | None = None) -> tuple[str, str]:
    """(text, charset): a byte order mark, the header's charset, the page's meta, UTF-8, else cp1252 without errors."""
    for mark, charset in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(charset, "replace"), charset
    meta = re.search(rb"<meta[^>]+charset\s*=\s*[\"']?([\w-]+)", data[:4096], re.I)
    named = re.search(r"charset\s*=\s*[\"']?([\w-]+)", header or "", re.I)
    for charset in ((named[1] if named else None), (meta[1].decode("ascii") if meta else None), "utf-8"):
        try:
            if charset:
                return data.decode(charset), charset.lower()
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("cp1252", "replace"), "cp1252"


def signals(body: str) -> dict[str, str]:
    """Content-Signal directives of a robots file: the last of a name counts."""
    out = {}
    for line in re.findall(r"(?im)^\s*content-signal\s*:\s*(.+)$", body):
        for part in line.split("#")[0].split(","):
            name, sign, value = part.partition("=")
            if sign:
                out[name.strip().lower()] = value.strip().lower()
    return out


def page_of(offsets: Sequence[int], at: int) -> int:
    """The page, from 1, that an offset is on, given where pages start."""
    return bisect_right(offsets, at)


def occurrence_index(excerpt: str, body: str, at: int) -> int:
    """How often an excerpt occurs before a place, so that the same words later in a page can be told apart."""
    count, start = 0, 0
    while 0 <= (start := body.find(excerpt, start)) < at and excerpt:
        count, start = count + 1, start + 1
    return count


def hit_windows(hits: Sequence[tuple[int, int]], most: int = 350) -> list[tuple[int, int]]:
    """Hits of a long sentence in groups whose spans stay within so many characters, from the left."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and b - out[-1][0] <= most:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out
