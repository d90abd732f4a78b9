import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passages.llm.html import Tokens, extract, main_text
from passages.llm.queries import QUERIES

LONG = "A sentence of the article, long enough to count, with commas, and more words than a menu has. " * 3


def test_article_among_the_rest():
    page = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var a = "</p>";</script></head>
    <body><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
    <div class="cookie-notice">We use cookies, of course, to do things, and more things, and so on.</div>
    <div id="content"><h2>Head &amp; line</h2><p>{LONG}</p><p>Short.</p><ul><li>One</li><li>Two</ul>
    <form><p>Your name, please, and your address, and all.</p></form><div class="ad">Buy, buy, buy</div>
    <p>Second&nbsp;part<br>after   the break &#233;&lt;b&gt;</p></div>
    <div class="comments"><p>I, for one, think that this is wrong, {LONG}</p></div>
    <aside><p>{LONG}</p></aside><footer>Footer, with, commas</footer></body></html>"""
    assert main_text(page).split("\n") == [
        "Head & line", LONG.strip(), "Short.", "One", "Two", "Second part", "after the break é<b>"
    ]


def test_broken_markup():
    assert main_text("<article><p>one<p><b>two<div>three</div></article") == "one\ntwo\nthree"
    assert main_text("just text, no tag") == "just text, no tag"
    assert main_text("<p>a</p></div></p><p>b &am") == "a\nb &am"
    assert main_text("<!-- <p>no</p> --><p>yes</p><!-- open") == "yes"
    for nothing in (None, "", "  ", "<html></html>", "<script>x</script>", "<nav>menu</nav>"):
        assert main_text(nothing) == ""
    deep = "<div>" * 3_000 + "text" + "</div>" * 3_000
    assert main_text(deep) == "text"
    assert len(main_text("<p>" + "word " * 200_000 + "</p>")) == 999_999


def test_articles_under_classes_of_furniture():
    for start in ('class="content has-sidebar"', 'class="layout no-sidebar"', 'class="post related"', 'id="social-science"', 'class="entry comments-open"'):
        for tag in ("section", "article", "main", "p"):
            page = f'<body><div {start}><{tag}>{LONG}</{tag}></div><div class="related">Another, page</div><footer>F</footer></body>'
            assert main_text(page) == LONG.strip(), page
    assert main_text(f'<div class="sidebar-left wrap"><main><p>{LONG}</p></main><div class="sidebar">S, s</div></div>') == LONG.strip()
    # What keeps its mark: comments longer than the article, and articles among them.
    notes = f'<div id="comments"><p>{LONG * 3}</p><article class="comment"><p>{LONG}</p></article></div>'
    for tag in ("article", "main", "div"):
        assert main_text(f"<{tag}><p>{LONG}</p></{tag}>{notes}") == LONG.strip()
    assert main_text(f'<main><p>{LONG}</p>{notes}</main>') == LONG.strip()
    assert main_text(f'<p>{LONG}<span class="share">Share</span> on</p>') == " ".join(f"{LONG} on".split())


def test_short_sections_of_pages_without_article():
    page = f"""<body><div><section><p>{LONG}</p></section><section><p>Short ending.</p></section>
    <section><a href="/">Links, only</a></section><section class="share">Share</section></div></body>"""
    assert main_text(page).split("\n") == [LONG.strip(), "Short ending."]
    assert main_text(f"<div><section><div>{LONG}</div></section><section>End.</section></div>").split("\n") == [LONG.strip(), "End."]


def test_whole_table(spark):
    """The pages of the tables have one article each, which a pattern can cut out."""
    import html

    got = {r.page_id: r for r in QUERIES["op8_main_text"](spark, "/root/testdata/sf0.001").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for page in pages:
        article = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br)\b[^>]*>", article)
        text = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert got[page.page_id].text == "\n".join(t for t in text if t)
        assert got[page.page_id].n_chars == len(got[page.page_id].text) and got[page.page_id].url == page.url
    assert len(got) == len(pages)


def test_odd_tables(spark):
    rows = [(1, None, "u"), (1, "<p>x</p>", "u"), (1, "<p>x</p>", "u")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string").withColumn("main_text", F.lit(0))
    out = extract(pages)
    assert out.columns == ["page_id", "text", "main_text"]
    assert sorted(r.main_text for r in out.collect()) == ["", "x", "x"]
    assert extract(pages.limit(0)).count() == 0


#: What a token is, as one pattern (which looks at places again and again).
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^<>]*\Z",
    re.S,
)


@settings(max_examples=2_000, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "/", "a", "b ", '"', "'", "!", "-", "--", "[CDATA[", "]]", "?", "<a", "</p", "\n", "="]), max_size=25))
def test_tokens_equal_the_pattern(parts):
    page = "".join(parts)
    tokens, at, found = Tokens(page), 0, []
    while (token := tokens.after(at)) is not None:
        found.append(token)
        at = token[1]
    assert found == [m.span() for m in TOKEN.finditer(page)]


def test_hostile_pages_take_seconds():
    pages = ["<div>x " * 150_000, '<a "' * 250_000, '<a "' * 250_000 + '>"', "<a ' " * 200_000 + '"', "<a " * 300_000 + '"']
    pages += ["<div>x " * 60_000 + "</section>" * 60_000, "<ul><li>x " * 60_000, "<b>x " * 60_000 + "</i>" * 60_000]
    for page in pages:
        began = time.time()
        main_text(page)
        assert time.time() - began < 20, page[:20]


def test_scores_decide_where_no_tag_does():
    """Two containers without article, main or telling classes: length, commas and links decide."""
    links = "".join(f'<p><a href="/{k}">A headline, with commas, and a good many words in it, number {k}</a></p>' for k in range(40))
    story = "".join(f"<p>{LONG}</p>" for _ in range(3))
    page = f'<html><body><div id="x1">{links}</div><div id="x2">{story}</div><div id="x3"><a href="/">One more link</a></div></body></html>'
    assert main_text(page) == "\n".join([LONG.strip()] * 3)
    deeper = f'<body><table><tr><td><div>{links}</div></td><td><div><div>{story}</div></div></td></tr></table></body>'
    assert main_text(deeper) == "\n".join([LONG.strip()] * 3)
