import html
import re

import pytest
from edge import clashing

from mkpulse.llm import html_extract as H

SCHEMA = "page_id long, url string, html string"


def brute(page):
    """The generator's pages hold one article of h1, p, b and br."""
    article = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p)>", article)
    texts = [" ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_pages_match_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.row.page_id: r.text for r in H.extract(pages).collect()}
    assert got == {r.page_id: brute(r.html) for r in pages.collect()}


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a\n b<p>c<br>d", "a b\n\nc d"), ("<p>a <b>b</b>c &lt;i&gt; &#233;&nbsp;x</p>", "a bc <i> é x"),
    ("<article><p>in</p></article><p>out</p>", "in"), ("<nav>n</nav><main><h2>T</h2><aside>s</aside><p>x</p><form>f</form></main>", "T\n\nx"),
    ("<script>var a = '<p>no</p>';</script><p>yes</p><style>p{}</style>", "yes"), ("<div class='cookie-notice'>c</div><div id=x><p>long enough text</p></div>", "long enough text"),
    ("<div class='page with-sidebar'><div class='sidebar'>s</div><p>the text of the page</p></div>", "the text of the page"),
    ("<article><p>x</p><div class=comments><article>a much longer comment than the text</article></div></article>", "x"),
    ("<ul><li>one<li>two</ul><table><tr><td>a<td>b</table>", "one\n\ntwo\n\na\n\nb"), ("<p>a < b & c", "a < b & c"), ("<!-- x --><p>y<!-- z", "y"),
    ("<article><header><h1>Head</h1></header><p>x</p><footer>f</footer></article>", "Head\n\nx"), ("<header>h</header><p>x</p><footer>f</footer>", "x"),
    ("<p>x</p><noscript>n</noscript><button>b</button><div role=navigation>m</div><p hidden>h</p>", "x"),
])
def test_blocks(page, text):
    assert H.main_text(page) == text


def test_deep_and_long_pages():
    assert H.main_text("<div>" * 30_000 + "x" + "</div>" * 30_000) == "x"
    assert len(H.main_text("<p>" + "word " * 200_000)) == 999_999
    assert H.main_text("<" * 50_000) is not None and H.main_text("<a '" * 5_000) is not None


def site(n, body, host="h.com"):
    return [(i, f"http://{host}/{i}", body(i)) for i in range(n)]


def test_template_of_a_host_goes_and_stays_elsewhere(spark):
    bar = "<div><div><span>Our</span> shop</div><p>Open daily</p></div>"
    pages = site(12, lambda i: f"{bar}<div><p>Text {i} of page {i}</p><p>Shared note</p></div><div>Rights reserved</div>")
    pages += [(100, "http://other.com/", f"{bar}<p>Alone</p>"), (101, "http://h.com/x", None), (102, None, f"{bar}<p>No host</p>")]
    got = {r.row.page_id: r.text for r in H.extract(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got[3] == "Text 3 of page 3" and got[101] == ""
    assert got[100] == "Our shop\n\nOpen daily\n\nAlone" and got[102] == "Our shop\n\nOpen daily\n\nNo host"


def test_prose_of_an_article_stays_and_its_widgets_go(spark):
    pages = site(12, lambda i: f"<article><p>Text {i}</p><p>Released under a licence.</p><div><a>Tell</a> a friend</div></article>")
    got = {r.row.page_id: r.text for r in H.extract(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got[5] == "Text 5\n\nReleased under a licence."


def test_copies_of_a_page_are_no_template(spark):
    pages = [(i, "http://h.com/same", "<div><p>One page, many rows</p></div>") for i in range(20)]
    got = H.extract(spark.createDataFrame(pages, SCHEMA)).collect()
    assert [r.text for r in got] == ["One page, many rows"] * 20


def test_edge_rows(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "x", ""), (1, "x", ""), (2, "http://a.com", "<p>t</p>")], SCHEMA)
    got = H.extract(clashing(pages)).collect()
    assert sorted((r.row.page_id or 0, r.text) for r in got) == [(0, ""), (1, ""), (1, ""), (2, "t")]
    assert H.extract(pages.limit(0)).count() == 0


def test_prose_on_every_page_of_a_host_goes(spark):
    pages = site(30, lambda i: f"<article><h1>Title {i}</h1><p>Text {i}</p><p>Order our new book today.</p>{'<p>Twice told.</p>' if i % 3 == 0 else ''}"
                 f"<table><tr><td>{i}<td>0</table></article>")
    pages += [(100 + i, f"http://h.com/{'news' if i < 30 else 'blog'}/{i}", f"<article><p>Item {i}</p>{'<p>News by mail.</p>' if i < 30 else ''}</article>") for i in range(90)]
    got = {r.row.page_id: r.text for r in H.extract(spark.createDataFrame([(i, u.replace("h.com", "a.com") if i < 100 else u, h) for i, u, h in pages], SCHEMA)).collect()}
    assert got[3] == "Title 3\n\nText 3\n\nTwice told.\n\n3\n\n0"
    assert got[105] == "Item 5" and got[185] == "Item 85"


@pytest.mark.parametrize("page, text", [
    ("<main><h1>T</h1><p>The long text of the page.</p><article class=card>teaser</article></main>", "T\n\nThe long text of the page.\n\nteaser"),
    ("<article></article><p>Text</p>", "Text"), ("<main><p>Text</p><article> </article></main>", "Text"),
    ("<article><p>One, longer</p></article><div>x</div><article><p>Two</p></article>", "One, longer\n\nTwo"),
    ("<div><h1>T</h1><p>x</p><article><p>Text</p></article></div>", "T\n\nText"),
    ("<main><h1>T</h1><div>by</div><article><p>The long text</p></article></main>", "T\n\nThe long text"),
    ("<nav><h1>Site</h1></nav><h1>Site</h1><article><h1>T</h1><p>Text</p></article>", "T\n\nText"),
    ("<main><p>Of the main</p></main><article><p>Beside</p></article>", "Of the main\n\nBeside"),
])
def test_landmarks(page, text):
    assert H.main_text(page) == text


def test_a_sites_own_title_beside_articles_goes(spark):
    pages = site(12, lambda i: f"<h1>Our site</h1><article><p>Text {i}</p></article>")
    got = {r.row.page_id: r.text for r in H.extract(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got[5] == "Text 5"


def test_deep_landmarks():
    assert H.main_text("<main><article>" + "<div>" * 30_000 + "x") == H.main_text("<main>" * 30_000 + "x") == "x"


@pytest.mark.parametrize("page, text", [
    ('<article><p style="overflow:hidden">a</p><p aria-hidden="false">b</p><p title="a hidden gem">c</p><p hidden>d</p><p HIDDEN="">e</p></article>', "a\n\nb\n\nc"),
    ('<div><p style="overflow:hidden">a</p><p data-x="class=ad">b</p><p hidden>c</p></div>', "a\n\nb"),
    ('<article><h2 id="search">Search</h2><section id="related-work">Work</section><div class="entry-header"><h1>T</h1></div></article>', "Search\n\nWork\n\nT"),
    ('<div class="entry-header"><h1>T</h1></div><h2 id="search">Search</h2><section id="related-work">Work</section>', "T\n\nSearch\n\nWork"),
    ('<article><p>x</p><div class="share"><a>Tell</a> all</div><div class="share">of the market</div></article>', "x\n\nof the market"),
    ('<body class="comments-open"><div role=main><p>x</p><div class="comments-area">y</div></div><p>z</p></body>', "x"),
])
def test_names_inside_and_outside_landmarks(page, text):
    assert H.main_text(page) == text


def test_counts_confirm_names_inside_landmarks(spark):
    pages = site(12, lambda i: f"<article><p>Text {i}</p><p class=notice>We use cookies.</p></article>")
    got = {r.row.page_id: r.text for r in H.extract(spark.createDataFrame([*pages, (20, "http://b.com/", pages[0][2])], SCHEMA)).collect()}
    assert got[5] == "Text 5" and got[20] == "Text 0\n\nWe use cookies."


def test_template_on_many_pages_of_a_large_host_goes(spark):
    pages = site(400, lambda i: f"<div><p>Text {i}</p></div>{'<div>See our archive</div>' if i % 16 == 0 else ''}")
    # copies of one page under many addresses are no template of it
    pages += [(1000 + i, f"http://h.com/copy?{i}", "<div><p>One page, many addresses</p></div>") for i in range(40)]
    got = {r.row.page_id: r.text for r in H.extract(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got[16] == "Text 16" and got[1003] == "One page, many addresses"


@pytest.mark.parametrize("page, text", [
    ('<div class="no-comments"><article><p>Text</p></article></div>', "Text"), ('<div class="post has-comments"><article><p>Text</p></article></div>', "Text"),
    ('<article class="post related-posts"><p>Text</p></article>', "Text"), ('<article class="related-posts comments"><p>Text</p></article>', "Text"),
    ('<div class="comments"><main><p>Text</p></main></div>', "Text"), ('<div class="comments"><p>Only this</p></div>', "Only this"),
    ('<article class="has-comments"><p>Text</p><div class="comments"><p>c</p></div></article><div class="related"><article>card</article></div>', "Text"),
    ('<div class="related"><article>card</article></div><article><p>Text</p></article>', "Text"),
])
def test_no_class_empties_a_page(page, text):
    assert H.main_text(page) == text


LONG = "The text of this page is long enough to be told from what stands around it."


@pytest.mark.parametrize("part, stays", [
    ('<div class="advert">Buy our shoes today</div>', False), ('<div class="notice">We use cookies</div>', False), ('<div id="cookie-banner">OK?</div>', False),
    ('<p class="sponsored">Buy!</p>', False), ('<div class="notice-board">Minutes of the board</div>', True), ('<div class="loads">Three loads</div>', True),
    (f'<div class="promo"><p>{LONG} {LONG}</p></div>', True), ('<div class="ad"><h1>T</h1></div>', True),
])
def test_marked_adverts_and_notices_go_inside_landmarks(part, stays):
    for tag in ("article", "main"):
        got = H.main_text(f"<{tag}><p>{LONG}</p>{part}</{tag}>")
        assert (got != LONG) == stays, got


def test_marks_below_the_deepest_level_hold():
    deep = "<div>" * 500
    assert H.main_text(f"<article>{deep}<p>Text</p><nav>menu<nav>more</nav>menu</nav><div role=navigation>x<div>y</div>z</div><footer>f<script>'</footer>'</script></footer>end") == "Text\n\nend"


def test_a_sentence_on_few_of_many_pages_stays(spark):
    """Whatever its tag, and with or without a landmark; what is no sentence, or links, goes from some pages on."""
    pages = site(240, lambda i: f"<article><p>Text {i}</p>{'<div>They met again in the spring.</div>' if i % 6 == 0 else ''}</article>", "a.com")
    pages += [(i + 1000, u, f"<div>Text {i}</div>{'<p>He said nothing.</p>' if i % 10 == 0 else ''}") for i, u, _ in site(240, str, "b.com")]
    got = {r.row.page_id: r.text for r in H.extract(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got[6] == "Text 6\n\nThey met again in the spring." and got[1010] == "Text 10\n\nHe said nothing."


def test_links_on_a_few_pages_are_template_by_their_count(spark):
    """An unmarked list of links in an article, on five pages of a large host; the same on four stays."""
    def links(n):
        return "<ul>" + "".join(f"<li><a href='/{k}'>Part {n}{k}</a></li>" for k in range(4)) + "</ul>"

    pages = site(100, lambda i: f"<article><p>Text {i}</p>{links('a') if i < 5 else links('b') if i < 9 else ''}</article>")
    got = {r.row.page_id: r.text for r in H.extract(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got[2] == "Text 2" and got[7].startswith("Text 7\n\nPart b0")


def test_subtrees_beside_the_article_are_counted(spark):
    """The counts see the whole page: menus recur, whether a tag marks them or not."""
    pages = spark.createDataFrame(site(12, lambda i: f"<nav><a href=/>Home</a></nav><article><p>Text {i}</p></article><div><a href=/x>About us</a></div>"), SCHEMA)
    assert H.templates(pages).selectExpr("size(template) AS n").agg({"n": "min"}).first()[0] == 2
