"""HTML extraction: the given pages by their known form, and awkward pages by hand."""

import html
import re

import pytest

from shelfmark.llm.main_text import extract, main_text
from shelfmark.llm.queries import QUERIES

LONG = "Some words of a paragraph that is long enough to count as text of an article, and more of them. "


def known(page):
    """The given pages have one article of h1 and p elements; only p elements stay open."""
    inside = re.search(r"<article>(.*?)(</article>|\Z)", page, re.DOTALL)[1]
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside))
    return "\n\n".join(b for b in blocks if b)


def test_given_pages(spark):
    folder = "/root/testdata/sf0.01"
    want = {r.page_id: known(r.html) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    out = QUERIES["op7_main_text"](spark, folder)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    rows = out.collect()
    assert {r.page_id: r.text for r in rows} == want and len(rows) == len(want)
    assert all(r.n_chars == len(r.text) for r in rows)


BOILERPLATE = [
    "<nav><ul><li><a href=x>Home</a></ul></nav>",
    "<header><h2>The site</h2><p>Its motto is long and has quite a few words in it</p></header>",
    "<footer>&copy; 2024 <p>All rights reserved by everybody who wants them</p></footer>",
    "<aside><p>" + LONG + "</p></aside>",
    "<div class='cookie-notice'><p>We use cookies. " + LONG + "</p></div>",
    "<div id=comments><div class=comment><p>" + LONG * 3 + "</p></div></div>",
    "<section class='reader comments'><p>" + LONG * 3 + "</p></section>",
    "<form action=/><p>Your mail address, please, and a few words about you</p><input><select><option>a</select></form>",
    "<script>if (a < b) document.write('<p>" + LONG + "</p>')</script><style>p > a {}</style>",
    "<!-- <p>" + LONG + "</p> --><div role=complementary><p>" + LONG + "</p></div>",
    "<div style='display: none'><p>" + LONG + "</p></div><div class=ad>Buy it</div>",
    "<svg><text>x</text></svg><template><p>" + LONG + "</p></template><noscript><p>" + LONG + "</p></noscript>",
]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div id=content>{}</div>", "<main><div>{}</div></main>"])
@pytest.mark.parametrize("other", BOILERPLATE)
def test_left_out(wrap, other):
    inside = f"<h1>The  title</h1><p>{LONG * 4}<p>{LONG * 3}<ul><li>{LONG}<li>{LONG}</ul><p>{LONG * 2}"
    want = "\n\n".join(["The title", *((LONG * n).strip() for n in (4, 3, 1, 1, 2))])
    body = wrap.format(inside)
    assert main_text(f"<html><body class='with sidebar'>{other}{body}</body></html>") == want
    assert main_text(f"<body>{body}{other}") == want


NOT_RESCUED = [
    "<section class=comments><article class=comment><p>" + LONG * 3 + "</p></article></section>",
    "<section class=comments><article><h1>Me</h1><p>" + LONG * 3 + "</p></article></section>",
    "<div class=related><article><h2>More</h2><p>" + LONG + "</p></article><article><p>" + LONG + "</p></article></div>",
    "<div class='related-posts'><main><p>" + LONG + "</p></main></div>",
    "<div class='cookie-notice'><h1>We use cookies</h1><p>" + LONG + "</p></div>",
    "<article class='teaser promo'><p>" + LONG * 3 + "</p></article>",
]


@pytest.mark.parametrize("wrap", ["<article><h1>T</h1>{}</article>", "<article><h2>T</h2>{}</article>", "<div id=content><h1>T</h1>{}</div>", "<div id=content><h2>T</h2>{}</div>"])
@pytest.mark.parametrize("other", NOT_RESCUED)
def test_marked_elements_with_articles_or_headings_of_their_own(wrap, other):
    body = wrap.format(f"<p>{LONG * 4}</p><p>{LONG * 3}</p>")
    want = "\n\n".join(["T", (LONG * 4).strip(), (LONG * 3).strip()])
    assert main_text(f"<body>{other}{body}</body>") == want
    assert main_text(f"<body>{body}{other}</body>") == want
    assert main_text(f"<body>{wrap.format(f'<p>{LONG * 4}</p><p>{LONG * 3}</p>{other}')}</body>") == want


@pytest.mark.parametrize("name", ["post has-sidebar", "ad-free", "no-comments", "with_sidebar", "post without-ads"])
@pytest.mark.parametrize("title", ["h1", "h2"])
def test_names_that_only_hold_a_mark(name, title):
    inside = f"<{title}>T</{title}><p>{LONG * 4}</p><p>{LONG * 3}</p>"
    want = "\n\n".join(["T", (LONG * 4).strip(), (LONG * 3).strip()])
    assert main_text(f"<body><div class='{name}'>{inside}</div><div class=sidebar><p>{LONG}</p></div></body>") == want
    assert main_text(f"<body><article class='{name}'>{inside}</article></body>") == want


def test_rescued():
    inside = f"<p>{LONG * 4}</p><p>{LONG * 3}</p>"
    want = "\n\n".join(["T", (LONG * 4).strip(), (LONG * 3).strip()])
    assert main_text(f"<body><div class='post widget'><article><h1>T</h1>{inside}</article></div><p>x</p></body>") == want
    assert main_text(f"<body><main><div class=widget><h1>T</h1>{inside}</div></main></body>") == want
    assert main_text(f"<body><div class='site-header'><h1>T</h1>{inside}</div><p>x</p></body>") == want
    assert main_text(f"<body><article class=widget><h2>T</h2>{inside}</article></body>") == want


@pytest.mark.parametrize("inside", ["<h1>Title</h1>{}", "<article><h1>Title</h1>{}</article>", "<article><h2>Title</h2>{}</article>", "<div><h2>Title</h2>{}</div>"])
def test_page_in_a_form(inside):
    article = inside.format(f"<p>{LONG}</p><p>{LONG}</p>")
    search = "<form action=/search><p>Search here<input></form>"
    page = f"<body><form id=aspnetForm method=post><nav><a href=x>Home</a></nav><div>{article}{search}</div><footer>End</footer></form>"
    assert main_text(page) == "\n\n".join(["Title", LONG.strip(), LONG.strip()])


def test_forms_without_article():
    assert main_text("<body><form><label>Name</label><input><div>Your name, please</div></form>") == ""
    assert main_text(f"<body><p>{LONG}</p><form><h1>Write to us</h1><p>{LONG * 3}</p></form>") != ""
    assert main_text(f"<body><h1>A</h1><p>{LONG}</p><form><p>{LONG * 3}</p></form>") == "A\n\n" + LONG.strip()


def test_formulas_and_objects():
    formula = "<math><semantics><mi>pi</mi> <mi>r</mi><annotation encoding=tex>\\pi r</annotation></semantics></math>"
    page = f"<article><p>Area is {formula} here.</p><p>See <object data=x><param name=a>the table</object>.</p></article>"
    assert main_text(page) == "Area is pi r here.\n\nSee the table."


def test_text_of_blocks():
    page = "<article><header class=header><h1>A&nbsp;&amp B</h1></header><p>a <b>b</b>c<br>d &lt;p&gt; 1 < 2 &#x1D11E;<p>\n x \t y</p>z<table><tr><td>1<td>2</table></article>"
    assert main_text(page) == "A & B\n\na bc d <p> 1 < 2 𝄞\n\nx y\n\nz\n\n1\n\n2"
    assert main_text("<p class=\"a > b\" title='<p>'>x</p><p>z") == "x\n\nz"
    assert main_text("<article><p>x</p><a href=\"broken>y</a><p>z</article>") == "x\n\ny\n\nz"
    assert main_text("just text &amp; more") == "just text & more"


@pytest.mark.parametrize("page", [None, "", " \n", "<html></html>", "<nav>x</nav>", "<!-- x", "<script>x"])
def test_no_text(page):
    assert main_text(page) == ""


def test_large_pages():
    assert main_text("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>").count("\n\n") == 19_999
    assert main_text("<div>" * 50_000 + LONG) == LONG.strip()
    assert main_text("<" * 100_000 + "p" + "<a '" * 2000)


def test_rows(spark):
    rows = [(1, "u", "<p>x</p>", "old", 9), (1, "u", "<p>x</p>", "old", 9), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, _html int")
    out = extract(df)
    assert out.columns == ["page_id", "url", "_html", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out.collect()) == [(0, "", 0), (1, "x", 1), (1, "x", 1)]
    assert extract(df.where("page_id > 5")).count() == 0
