"""Main text of pages written by hand, which share nothing with the layouts that the model learns from."""

import pytest

from contactsheet.llm import html as page

A = "The council met on Tuesday to discuss the new library, which is to open in the spring of next year."
B = "Members agreed that opening hours should be longer, and they asked the clerk for a report by the end of June."
C = "Residents may write to the office until then, and every letter will be read at the following meeting."
P = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
TEXT = f"{A}\n{B}\n{C}"

#: Page, and what its main text must hold; nothing of OFF may be in it.
OFF = ["Home", "Imprint", "Buy now", "cookies", "Subscribe", "Anna wrote", "Related"]
NAV = '<ul class="menu"><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/i">Imprint</a></li></ul>'
FOOT = '<div class="footer"><a href="/i">Imprint</a> | <a href="/p">Privacy</a></div>'
PAGES = {
    "theme with sidebar": f'<html><body>{NAV}<div class="post-with-sidebar">{P}</div><div class="sidebar"><h3>Related</h3><ul><li><a href="/x">Related item</a></li></ul></div>{FOOT}</body></html>',
    "no ads": f'<body><div id="content" class="content no-ads">{P}</div><div class="ads">Buy now and save a lot.</div></body>',
    "has nav": f'<body class="has-nav"><nav>{NAV}</nav><main class="main has-nav">{P}</main></body>',
    "with comments": f'<body><div class="article-body with-comments">{P}</div><div class="comments"><div class="comment"><p>Anna wrote: I do not think that this is right at all.</p></div></div></body>',
    "layout has two sidebars": f'<body><div class="layout has-sidebar"><div class="column"><h1>A library opens</h1>{P}</div><aside><p><a href="/x">Related things to read</a></p></aside></div></body>',
    "without header": f'<div class="page without-header"><div class="text">{P}</div></div>',
    "plain": f"<html><head><title>x</title></head><body>{P}</body></html>",
    "article in main": f"<body><header><a href=/>Home</a></header><main><article><h1>A library opens</h1>{P}</article></main><footer>Imprint</footer></body>",
    "table layout": f'<table><tr><td><a href="/">Home</a><br><a href="/i">Imprint</a></td><td>{P}</td></tr></table>',
    "breaks": f'<div class="nav"><a href="/">Home</a></div><div class="story">{A}<br><br>{B}<br><br>{C}</div>',
    "lists": f'<article><p>{A}</p><ul><li>{B}</li><li>{C}</li></ul></article><nav><a href="/">Home</a></nav>',
    "form": f'<body><main>{P}</main><form action="/s"><label>Subscribe to our letter</label><input name="m"><button>Subscribe</button></form></body>',
    "cookie notice": f'<body><div class="cookie-notice"><p>We use cookies to make this site better.</p><button>OK</button></div><div class="entry">{P}</div></body>',
    "quote": f"<body><article><p>{A}</p><blockquote><p>{B}</p></blockquote><p>{C}</p></article></body>",
    "scripts": f'<body><script>var a = "<p>Buy now</p>";</script><style>p{{}}</style><article>{P}</article><script>b()</script></body>',
    "camel case": f'<body><div class="topNav"><a href="/">Home</a> <a href="/i">Imprint</a></div><div class="articleBody">{P}</div></body>',
    "deep": "<div>" * 30 + P + "</div>" * 30,
    "unclosed": f"<body><div class=content><p>{A}<p>{B}<p>{C}",
    "marked up": f'<body><article><p>{A.replace("library", "<b>lib</b>rary")}</p><p>{B.replace("&", "&amp;")}</p><p>{C}</p></article></body>',
    "links within": f'<body><article><p>{A}</p><p>{B.replace("report", "<a href=/r>report</a>")}</p><p>{C}</p></article>{FOOT}</body>',
}


@pytest.fixture(scope="module")
def model(spark):
    runs = [A, B, C, "Rain fell all night, but in the morning the road was dry again.", "Nobody knew who had left the door open, and nobody asked."]
    rows = [(i, "u", f"<article><p>{a}</p><p>{b}</p></article><nav><a href=/>Start</a></nav>") for i, (a, b) in enumerate((a, b) for a in runs for b in runs)]
    return page.fit(spark.createDataFrame(rows, "page_id long, url string, html string"))


@pytest.mark.parametrize("name", PAGES)
def test_written_by_hand(model, name):
    (got,) = page.main_texts([PAGES[name]], model)
    lost = [x for x in (A, B, C) if x not in got.replace("\n", " ")]
    assert not lost and not [x for x in OFF if x in got], got


def test_one_paragraph_and_no_tags(model):
    one = "Of all the places we saw that summer, none was as quiet as the small harbour behind the hill, where boats lay still."
    assert page.main_texts([f"<p>{one}</p>", one, f"{one} {B}", f"<body>{one}<p>{B}"], model) == [one, one, f"{one} {B}", f"{one}\n{B}"]
    assert page.main_texts([NAV, f"<nav>{NAV}</nav>", "", None], model) == [""] * 4


def test_names_tell_what_a_box_is_or_has():
    assert page._names("post-with-sidebar has-nav no-ads ad") == ({"post", "ad"}, {"sidebar", "nav", "ads"})
    assert page._names("with") == ({"with"}, set()) and page._names("") == (set(), set())
