"""Tags and class words weigh, they do not switch; nothing of an article is lost to gaps."""

import pytest

from opslens.llm import mainhtml

LONG = "A paragraph that is long enough to be a surge all by itself, since it goes on and on."
BODY = "".join(f"<p>{i} {LONG}</p>" for i in range(6))
TEXT = "\n\n".join(f"{i} {LONG}" for i in range(6))
ASIDES = "<div class=ad>ad</div><aside>more</aside><form>form</form><nav>nav</nav>"

WEIGHTS = [
    (f"<div id=content>{BODY}</div><article class=card><a href=/>A teaser</a></article>", TEXT),
    (f"<article><h2>Card</h2></article><div id=content>{BODY}</div>", TEXT),
    *((f"<div class='{c}'>{page}</div><p>tail</p>" if page == BODY else f"<div class='{c}'>{page}</div>", TEXT + ("\n\ntail" if page == BODY else ""))
      for c in ("wrap no-sidebar", "content-with-sidebar", "search-results-page") for page in (BODY, f"<article>{BODY}</article>")),
    (f"<div class=search><article>{BODY}</article></div>", TEXT),
    (f"<article><p>Yes. {LONG}</p></article><div id=comments class=comments-area>{BODY}</div>", f"Yes. {LONG}"),
    (f"<article>{BODY}</article><div class=related><article>{LONG}</article></div>", TEXT),
    ("<pre>x = 1 <span class=comment># one</span></pre>", "x = 1 # one"),
]
GAPS = [
    (f"<article><p>{LONG}</p>{ASIDES}<p>End.</p></article>", f"{LONG}\n\nEnd."),
    (f"<h1>Head</h1>{ASIDES}<p>{LONG}</p>{ASIDES}<p>End.</p>", f"Head\n\n{LONG}\n\nEnd."),
    (f"<article><p>{LONG}</p></article><article><p>Second.</p></article>", f"{LONG}\n\nSecond."),
]


@pytest.mark.parametrize(("page", "text"), WEIGHTS)
def test_tags_and_classes_are_weights(page, text):
    assert mainhtml.main_text(page) == text


@pytest.mark.parametrize(("page", "text"), GAPS)
def test_gaps_lose_nothing(page, text):
    assert mainhtml.main_text(page) == text
