import html as references
import re

from tallyhouse.llm.html import extract, main_text, op3_html_extraction, threshold

DATA = "/root/testdata/sf0.001"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body class="has-sidebar">
<header><h2>Site name</h2></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav><div class="cookie-notice"><p>We use cookies on this long page.</p></div>
<article><header><h1>The &lt;title&gt; &amp; more</h1></header><p>A first   paragraph with
several words<br>and a break.<p>Short.<div class="ad">Buy this now, it is a really good offer for all!</div>
<ul><li>One<li>Two</ul><form><p>Your name please</p><input></form><p>Last caf&eacute; paragraph with <b>bold and <a href="/x">a link</a> in it.</p>
<section id="comments"><article class="comment"><p>A very long reader comment that says a lot about nothing at all.</p></article></section></article>
<aside><p>Related stories you may like to read today and tomorrow.</p></aside><footer>&copy; 2020</footer></body></html>"""


def test_a_page_with_everything():
    assert main_text(PAGE).split("\n") == [
        "The <title> & more",
        "A first paragraph with several words and a break.",
        "Short.",
        "One",
        "Two",
        "Last café paragraph with bold and a link in it.",
    ]


def test_a_page_without_a_main_element():
    page = (
        "<div id=top><a href=1>One</a> <a href=2>Two</a></div><div class=text><h1>Title</h1><p>This is a long paragraph of the content of a page.</p>"
        "<p>x</p><p>Another long paragraph with lots of words in it, and more.</p></div><div><a href=3>Imprint</a> <a href=4>Terms</a></div>"
    )
    assert main_text(page).split("\n") == ["Title", "This is a long paragraph of the content of a page.", "x", "Another long paragraph with lots of words in it, and more."]


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<nav>only a menu</nav>") == main_text("<p> \n </p>") == ""
    assert main_text("plain words") == "plain words"
    assert main_text("<article><p>cut off in a ta</p><p>more</p><di") .startswith("cut off in a ta\nmore")
    assert main_text("</p></div><p>stray ends</div></p>") == "stray ends"
    assert main_text("<article><p>" + "<b>deep " * 3000) == " ".join(["deep"] * 3000)


def test_clusters_part_at_the_gap():
    assert 2 < threshold([1.0, 1.5, 2.0, 90.0, 100.0]) < 90
    assert threshold([5.0]) == 5.0


def test_query_against_the_known_template(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = op3_html_extraction(spark, DATA).collect()
    assert {r["page_id"] for r in got} == set(pages)
    for row in got:
        inner = re.search(r"<article>(.*)</article>", pages[row["page_id"]], re.S)[1]
        blocks = [" ".join(references.unescape(re.sub(r"</?b>|<br>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert row["text"] == "\n".join(b for b in blocks if b) and row["n_chars"] == len(row["text"])


def test_rows_without_html(spark):
    frame = spark.createDataFrame([(1, None, "old"), (2, "<p>a</p>", "old")], "page_id long, html string, text string")
    assert sorted(map(tuple, extract(frame).select("page_id", "text", "n_chars").collect())) == [(1, "", 0), (2, "a", 1)]
