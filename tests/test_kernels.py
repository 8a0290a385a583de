import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from provenant.functions import html, text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_normalise_maps_back(value):
    plain, at = text.normalise(value)
    assert len(plain) == len(at) and at == sorted(at) and all(0 <= i < len(value) for i in at)
    assert plain == plain.strip() and "  " not in plain


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab “”’—é😀​ .", min_size=1, max_size=40), st.data())
def test_locate_finds_slices(value, data):
    a = data.draw(st.integers(0, len(value) - 1))
    b = data.draw(st.integers(a + 1, len(value)))
    quote = value[a:b]
    found = text.locate(quote, value)
    if quote.strip():
        assert found and text.normalise(value[slice(*found)])[0] == text.normalise(quote)[0]
    else:
        assert found is None


def test_locate_variants():
    body = "😀 It said “AI‑driven” tools — now. Café"
    assert body[slice(*text.locate('said "AI-driven" tools - now', body))] == "said “AI‑driven” tools — now"
    assert text.locate("CafÃ©", body) == (len(body) - 4, len(body))
    assert text.locate("missing words", body) is None


def test_names():
    assert text.has_name("X-4", "the X-4 engine") and not text.has_name("X-4", "the X-4o engine")
    assert text.has_name("X 3", "an X 3 model") and not text.has_name("X 3", "an X 3.5 model")


def test_sentences():
    body = "Mr. A. Smith went home. It rained!  Then 3 left.\n\nNew block\n- item one\n- item two"
    assert [body[a:b] for a, b in text.sentences(body)] == ["Mr. A. Smith went home.", "It rained!", "Then 3 left.", "New block", "- item one", "- item two"]
    assert text.sentences("") == [] and text.sentences("  \n ") == []


def test_shapes():
    assert [text.shape(s) for s in ("if (a) { b = c[0]; }", "1 | 2 | 3 | 4", "Home", "Our Products and Services", "We use this in production every day.")] == ["code", "table", "nav", "heading", "prose"]


def test_phrases_and_masks():
    pattern = text.phrase_pattern(["machine learning", "ai"])
    assert [m[0] for m in pattern.finditer("Machine-learning, AI; said; ai-based, machine\nlearning")] == ["Machine-learning", "AI", "machine\nlearning"]
    assert text.mask("an air fryer and ai", ["air fryer"]) == "an           and ai"


def test_numbers():
    assert text.numbers("1.4 million, 1,400,000 and 2k or 3.50") == ["1400000", "1400000", "2000", "3.5"]
    assert text.volume_phrases("over 1.2 million customer records per year") == ["1200000 customer record"]
    assert text.counts("we serve 10,000 active retail customers per month", ["customer"]) == [("customer", 120000)]
    assert text.counts("10 times customers", ["customer"]) == []


def test_negation():
    assert text.unnegated("uses ai", "It never uses AI.") is None and text.unnegated("uses ai", "Not slow; it uses AI.") == "uses AI"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_ratios():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 90))) for _ in range(2))
        assert abs(text.indel_ratio(a, b) - 200 * lcs(a, b) / (len(a) + len(b))) < 1e-9
    assert text.token_sort_ratio("b a", "a b") == 100 and text.token_set_ratio("a b", "a b c d") == 100
    assert text.partial_ratio("needle", "hay needle hay")[0] == 100 and text.token_set_ratio("", "a") == 0


def test_partial_ratio_against_every_stretch():
    rng = random.Random(3)
    for size, most in ((1, 3), (12, 120), (40, 200), (64, 150), (65, 150), (130, 300)):
        for _ in range(25):
            body = "".join(rng.choice("abcde é") for _ in range(most))
            at = rng.randrange(most - size + 1)
            needle = "".join(c if rng.random() < 0.8 else rng.choice("abcdeЖ") for c in body[at : at + size])
            want = max((text.indel_ratio(needle, body[s : s + size]), -s) for s in range(most - size + 1))
            assert text.partial_ratio(needle, body) == text.partial_ratio(body, needle) == (want[0], -want[1])


def test_partial_ratio_with_longer_runs_elsewhere():
    """The longest runs that the text shares with the excerpt are not where it is most alike."""
    body = "our hartled machine was here, his hartled machine works. " + "x" * 40 + " the hartled machine works " + "y" * 40
    assert text.partial_ratio("the hЖrtled machine works", body.replace("machine", "engine", 1)) == (96.0, body.replace("machine", "engine", 1).index("the hartled"))
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 5))) for _ in range(3000)]
    for i in range(0, 2000, 20):
        cut = " ".join(words[i : i + 8])
        found = text.partial_ratio(cut[:5] + "Ж" + cut[6:], " ".join(words))
        assert found[0] >= 100.0 * (len(cut) - 1) / len(cut) - 1e-9


def test_redaction_round_trip():
    body = "Dr. Jane Doe (jane@x.org, +1 555 123 4567) met Dr. Jane Doe; mail jane@x.org"
    hidden, marks = text.redact(body)
    assert "jane" not in hidden.lower() and hidden.count("[EMAIL_1]") == 2 and text.unredact(hidden, marks) == body


def test_small_kernels():
    assert text.join_list(["a"]) == "a" and text.join_list(["a", "b"]) == "a and b" and text.join_list(["a", "b", "c"]) == "a, b, and c"
    assert text.compact_name("Acme Widgets, Inc.") == "acmewidgets"
    assert text.party_names("Northwind Traders (NWT) d/b/a Wind") == ["Northwind Traders (NWT) d/b/a Wind", "NWT", "Northwind Traders", "Wind", "Northwind"]
    assert text.elision_parts("the first long part ... short … the second long part") == ["the first long part", "the second long part"]
    assert text.capitalised("We work with Blue Harbor Labs on AI models", ["ai"]) == ["We", "Blue Harbor Labs"]
    assert text.decode("é".encode("cp1252")) == ("é", "cp1252") and text.decode(b'<meta charset="latin-1">\xe9')[1] == "latin-1"
    assert text.signals("Content-Signal: search=yes, ai-train=no # x") == {"search": "yes", "ai-train": "no"}
    assert [text.page_of([0, 10, 20], i) for i in (0, 9, 10, 25)] == [1, 1, 2, 3]
    assert text.clip("one two three", 9) == "one two…" and text.clip("one", 9) == "one"
    body = "word " * 300
    a, b = text.fit_excerpt(body, 0, len(body))
    assert 25 <= b - a <= 600
    assert text.shingles("one two three four five six seven", 6) == ["one two three four five six", "two three four five six seven"]


def test_html():
    page = '<html><head><title>A &amp; B</title><script type="application/ld+json">{"x": [{"datePublished": "2023-05-06T00:00"}]}</script></head><body><nav>Menu</nav><div class="cookie-banner">Accept our nice AI cookies now or later please</div><p>One <b>two</b></p><p>Three</p><a href="/x#y">l</a><a href="mailto:a@b">m</a></body></html>'
    assert html.title(page) == "A & B" and html.main_text(page).startswith("One two\nThree") and "Menu" not in html.main_text(page)
    assert html.links(page, "http://h/a/") == ["http://h/x"] and html.published(page) == ("2023-05-06", "json_ld")
    assert html.published("<p>", "Wed, 21 Oct 2015 07:28:00 GMT") == ("2015-10-21", "last_modified")
    assert html.missed_blocks(page, re.compile("AI")) == ["Accept our nice AI cookies now or later please"]
    assert html.main_text("<nav>only</nav>") == "only"


def test_occurrences_and_windows():
    body = "ab ab ab"
    assert [text.occurrence_index("ab", body, i) for i in (0, 3, 6)] == [0, 1, 2] and text.occurrence_index("x", body, 5) == 0
    assert text.hit_windows([(400, 410), (0, 10), (100, 120), (340, 350)]) == [(0, 350), (400, 410)]
