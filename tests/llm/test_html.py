import html
import re

import pytest
from pyspark.sql import functions as F

from cuesift.llm import html_extract, queries
from tests.llm.data import SF, needs_tables

ARTICLE = "<h1>A title</h1><p>First, a paragraph of some length, with commas, as articles have them, and more.</p><div>Second &amp; last, with <b>bold</b> and <a href='x'>a link</a>.<br>Next line.</div>"
TEXT = "A title First, a paragraph of some length, with commas, as articles have them, and more. Second & last, with bold and a link. Next line."
JUNK = [
    "<nav><ul><li><a href='/'>Home, sweet home, and more, and more</a></li></ul></nav>",
    "<header><p>Site header, with a slogan, and words, words, words.</p></header>",
    "<footer>&copy; us, them, and all, for ever, and a day, or so, they say.</footer>",
    "<aside><p>Sidebar text, that goes on, and on, and on, for a while.</p></aside>",
    "<div class='cookie-notice'><p>We use cookies, many, many, many cookies, to please you.</p></div>",
    "<div class='ad'><p>Buy this, and that, and these, and those, today, now, here.</p></div>",
    "<form><p>Name, address, and so on, and on, please, in full.</p><input value='x'></form>",
    "<script>var a = '<p>not, a, paragraph, at, all</p>';</script><style>p > a { color: red }</style>",
    "<section id='comments'><article class='comment'><p>Nice, really nice, article, thanks, a lot, again.</p></article></section>",
    "<!-- <p>commented, out, text</p> -->",
]


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", "<div id='content'>{}</div>", "<div><div class='x'>{}</div></div>"])
def test_article_alone_stays(around):
    page = f"<!DOCTYPE html><html><head><title>A title, of sorts</title></head><body>{''.join(JUNK[:5])}{around.format(ARTICLE)}{''.join(JUNK[5:])}</body></html>"
    assert html_extract.main_text(page) == TEXT
    for part in JUNK:
        assert html_extract.main_text(f"<body>{part}{around.format(ARTICLE)}</body>") == TEXT
        assert html_extract.main_text(f"<body>{around.format(ARTICLE + part)}</body>") == TEXT


@pytest.mark.parametrize("names", ["class='layout has-sidebar'", "class='no-sidebar'", "id='with-comments'", "class='has-header-image'", "class='layout hasSidebar'"])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", "<div class='x'>{}</div>", "<div class='has-menu'><div>{}</div></div>"])
def test_wrappers_named_like_junk(names, inner):
    page = f"<div {names}>{inner.format(ARTICLE)}</div>"
    assert html_extract.main_text(f"<body>{page}</body>") == TEXT
    if "article" in inner or "main" in inner:
        assert html_extract.main_text(f"<body>{''.join(JUNK[:5])}{page}{''.join(JUNK[5:])}</body>") == TEXT
        assert html_extract.main_text(f"<body><div {names}>{JUNK[4]}{inner.format(ARTICLE)}{JUNK[5]}</div></body>") == TEXT


def test_long_comments_stay_out():
    talk = f"<section id='comments'>{'<article><p>So, they say, and say, and say again, at length, all of it.</p></article>' * 20}</section>"
    for around in ("<article>{}</article>", "<main>{}</main>", "<div class='post'>{}</div>"):
        # a well-named container counts as long as it has a quarter of the comments' points
        assert html_extract.main_text(f"<body>{around.format(ARTICLE)}{talk if 'div' not in around else JUNK[8]}</body>") == TEXT


def test_short_sections_stay():
    """Pages without article and main: short blocks beside the best one are text, lists of links aren't."""
    long = "<section><p>" + "Some words, and more, of a long section. " * 12 + "</p></section>"
    page = f"<body><div><h2>Head</h2><section><p>A short one.</p></section>{long}<section><p>Last.</p></section><div><a href='x'>Elsewhere</a></div></div></body>"
    assert html_extract.main_text(page) == "Head A short one. " + "Some words, and more, of a long section. " * 12 + "Last."


def test_broken_markup():
    run = html_extract.main_text
    assert run("<p>one<p>two</b> <b>three") == "one two three" and run("<p>two</b><b>three") == "twothree"
    assert run("<article><p>a<b>b</p><p>c</p></article>") == "ab c"
    assert run("plain text only") == "plain text only"
    assert run("<div title=\"a > b\">x &lt;y&gt; &#233;\t\n z</div>") == "x <y> é z"
    assert run("<p>cut off <a href='unclosed") == "cut off"
    assert run("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"
    assert run("<div>" * 20000 + "<p>deep</p>") == "deep"
    assert run("<ul><li>one, two<li>three, four</ul>") == "one, two three, four"
    for empty in (None, "", "<html></html>", "<script>x</script>", "<nav>a</nav>", "<", "<!--"):
        assert run(empty) in ("", "<")
    words = " ".join(f"w{i}," for i in range(50_000))
    assert run(f"<body><p>{words}</p></body>") == words
    assert len(run("<p " + "x='" * 20_000)) >= 0 and len(run("<" * 50_000)) >= 0


def test_columns(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", "clash", "x"), (2, None, None, "y"), (2, None, None, "y")], "page_id long, html string, main_text string, HTML string")
    out = html_extract.extract(df)
    assert out.columns == ["page_id", "html", "main_text_in", "HTML", "main_text"] and sorted(r[4] for r in out.collect()) == ["", "", "a"]
    assert html_extract.extract(df.limit(0)).count() == 0


@needs_tables
def test_query(spark):
    """Against the articles of the pages, cut out by hand; one page in these tables has one article."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op8_html_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", pages[r["page_id"]], re.S).group(1)
        inner = re.sub(r"</?(?:p|h1|br|div)[^>]*>", " ", inner)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", inner)).split())
        assert r["text"] == want and r["n_chars"] == len(want)
    assert spark.createDataFrame(rows).filter(F.length("text") != F.col("n_chars")).count() == 0
