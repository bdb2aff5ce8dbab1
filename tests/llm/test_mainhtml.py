import random
import time

import pytest

from opslens.llm import mainhtml

LONG = "A paragraph that is long enough to be a surge all by itself, since it goes on and on."

CASES = [
    (None, ""), ("", ""), ("   \n ", ""), ("plain text", "plain text"), ("<p>a < b &amp;&lt; c", "a < b &< c"),
    (f"<nav><ul><li><a href=/>Home</a></ul></nav><p>Short.</p><p>{LONG}</p><p>End.</p><footer>(c)</footer>", f"Short.\n\n{LONG}\n\nEnd."),
    ("<article><h1>T</h1><p>x</p></article>", "T\n\nx"),
    (f"<article><p>x</p><div class='ad big'>{LONG}</div><p>y</p></article><p>{LONG}</p>", "x\n\ny"),
    (f"<script>var a = '<p>{LONG}</p>';</script><p>t</p>", "t"),
    ("<style>p{}</style><title>no</title><p>a\n\t b<br>c&nbsp;d <b>e</b>f</p>", "a b c d ef"),
    (f"<div id='comments'><article class=comment>{LONG}</article></div><article><p>main</p></article>", "main"),
    (f"<div class='cookie-notice'><div>{LONG}</div>{LONG}</div><p>text</p>", "text"),
    (f"<body class='with-sidebar'><div class=sidebar>{LONG}</div><p>text</p>", "text"),
    ("<!-- <p>no</p> --><p title='a > b'>yes</p><form><p>no</form>", "yes"),
    (f"<aside><p>{LONG}<p>{LONG}</aside><p>a<p>b", "a\n\nb"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\n\nc"),
    ("<p>&amp;lt; &#233; &#x1F600; &unknown; &am", None),
    ("<p>one</p><script>never closed <p>two</p>", "one"),
    ("<article><header><h1>no</h1></header><p>x</article>", "x"),
    ("<p hidden>no</p><p aria-hidden='true'>no</p><p>yes</p>", "yes"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_cases(page, text):
    found = mainhtml.main_text(page)
    assert found == ("&lt; é 😀 &unknown; &am" if text is None else text)


def test_runs_between_surge_and_dive():
    assert mainhtml.between([]) == [] and mainhtml.between([0, 0]) == []
    assert mainhtml.between([2, 90, 0, 3, 0, 0, 0, 5]) == [(0, 4)]
    assert mainhtml.between([0, 50, 0, 50, 0, 0, 0, 100, 1]) == [(1, 4), (7, 9)]
    assert mainhtml.between([5, 0, 0, 0, 4]) == [(0, 1)]
    assert mainhtml.between([1]) == [(0, 1)]


def test_long_and_odd_pages_take_linear_time():
    for page in ("<" * 200_000, "<a " * 50_000, "<p>x" * 50_000, "&" * 200_000, "<div class='" + "x" * 200_000):
        mainhtml.main_text(page)
    assert mainhtml.main_text("<p>" + "word " * 200_000).count("word") == 200_000


def test_query_form(spark):
    rows = [(i, "u", page, 1) for i, (page, _) in enumerate(CASES)] * 2
    found = mainhtml.main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int"))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    for r in found.collect():
        assert r.text == mainhtml.main_text(CASES[r.page_id][0]) and r.n_chars == len(r.text)
    assert mainhtml.main_texts(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def plain_runs(sizes):
    """Stretches that no LINES empty lines part, trimmed, with a window as large as the need."""
    n = mainhtml.LINES
    windows = [sum(sizes[i : i + n]) for i in range(len(sizes))]
    need = min(mainhtml.SURGE, max(windows, default=0))
    full = [i for i, size in enumerate(sizes) if size]
    runs = []
    for i in full:
        if runs and i - runs[-1][1] < n + 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return [(a, b + 1) for a, b in runs if max(sum(sizes[i : min(i + n, b + 1)]) for i in range(a, b + 1)) >= need]


@pytest.mark.parametrize("seed", range(6))
def test_runs_like_plain_ones(seed):
    rng = random.Random(seed)
    for _ in range(500):
        sizes = [rng.choice([0, 0, 0, 0, 5, 20, 40, 90, 300][: rng.randrange(5, 10)]) for _ in range(rng.randrange(30))]
        assert mainhtml.between(sizes) == plain_runs(sizes), sizes


@pytest.mark.parametrize("seed", range(3))
def test_main_text_is_what_lies_in_runs(seed):
    """Pages of plain blocks: the text is that of the lines in plain runs."""
    rng = random.Random(seed)
    for _ in range(100):
        blocks = [rng.choice(["<nav>no</nav>", "<p>short</p>", f"<p>{LONG}</p>", "<div class=ad>no</div><hr>", "<p>of middle length, some words</p>"]) for _ in range(12)]
        lines = mainhtml.lines_of("".join(blocks))
        runs = plain_runs([len(line.text) for line in lines])
        kept = [line.text for a, b in runs for line in lines[a:b] if line.text]
        assert mainhtml.main_text("".join(blocks)) == "\n\n".join(kept)


@pytest.mark.parametrize("attribute", [
    'style="overflow:hidden"', 'title="the hidden gem"', "data-hidden", 'data-role="banner"', 'title="class=ad"',
    "data-class='ad'", 'alt="a" data-id=menu', "x='hidden' y",
])
def test_words_in_other_attributes_mean_nothing(attribute):
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(6))
    text = "\n\n".join(f"{LONG} {i}" for i in range(6))
    assert mainhtml.main_text(f"<div {attribute}>{body}</div><p>tail</p>") == f"{text}\n\ntail"
    assert mainhtml.main_text(f"<article><p {attribute}>{LONG}</p><p>x</p></article>") == f"{LONG}\n\nx"


def test_paragraphs_are_no_page_parts():
    assert mainhtml.main_text(f"<article><p class='related'>{LONG}</p><p class=search-term>b</p><p class=notice>no</p></article>") == f"{LONG}\n\nb"


@pytest.mark.parametrize("page", [
    "<div>" * 200_000 + "x" + "</div>" * 200_000,
    "<div>" * 100_000 + "</b>" * 100_000 + "x",
    "<div class=ad>a" * 50_000 + "</div>" * 50_000,
    "<article>a" * 50_000 + "</article>" * 50_000,
    "<nav>" * 100_000 + "</nav>" * 100_000 + "x",
])
def test_time_is_linear_in_depth(page):
    started = time.perf_counter()
    mainhtml.main_text(page)
    assert time.perf_counter() - started < 6
