import re
from html import unescape

from lodestone.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head>
<body class="with-sidebar"><header><h1>Site</h1><p>A long line of a site header, far too long to be short.</p></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, and we say so at length, at great length, so that it looks like text.</p></div>
<div id="page"><div class="post post-{n}"><h2>Title &amp; {n}</h2><div class="body"><p>First   <b>par</b>agraph
of page {n}, with &eacute; and &#8364;.<br>Next line.<p>Second one &lt;b&gt;<div class="ad-box">Buy</div><ul><li>One<li>Two</ul><form><input><p>Sign</p></form></div></div>
<section id="comments"><div><p>A reader comment that is longer than all of the article, and goes on, and on, and on, and on, and on, and on, and on, and on.</p></div></section></div>
<aside><p>Side</p></aside><div class="footer-links"><p>Foot</p></div><footer>Foot</footer></body></html>"""
WANT = "Title & {n}\nFirst paragraph of page {n}, with é and €. Next line.\nSecond one <b>\nOne\nTwo"


def test_pages_of_a_host(spark):
    pages = [(i, f"http://h.example/{i}", PAGE.replace("{n}", str(i))) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == {i: WANT.replace("{n}", str(i)) for i in range(8)}


def test_the_host_decides(spark):
    """A page whose article is short beside another block follows the other pages of its host."""
    page = lambda a, b: f"<body><div class='main'><p>{a}</p></div><div class='extra'><p>{b}</p></div></body>"
    pages = [(i, "http://h.example/x", page("article " * 30, "more " * 4)) for i in range(5)] + [(9, "http://h.example/y", page("short article", "more " * 60))]
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got[9] == "short article" and got[0] == ("article " * 30).strip()


def test_given_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    for r in html.extract_pages(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", inner))
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_broken_markup():
    for page in ("<", "<p", "<p>a<!-- b", "<script>x", "a < b > c", "<div class='x", "<p>x</div></p></b>", "</p>", "<a href='\"'>t</a>", "<p>&#0;&bogus;</p>", "plain"):
        assert isinstance(html.extract(page, None), str)
    assert html.extract("plain <b>text</b>", None) == "plain text"


def test_hosts(spark):
    urls = ["http://A.example:80/x", "https://u:p@b.example?q", "//c.example", "d.example/x", None, ""]
    got = [r["h"] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(html.host_of(__import__("pyspark.sql.functions", fromlist=["col"]).col("u")).alias("h")).collect()]
    assert got == ["a.example", "b.example", "c.example", "", "", ""]


def test_all_of_an_article_is_kept():
    """Text before, between and after the sections, lists or tables that hold most of an article."""
    long = "Many words of a long paragraph, and some more of them. " * 8
    parts = (
        f"<section><p>{long}1</p></section><p>between</p><section><p>{long}2</p></section>",
        f"<ul><li>{long}1</li></ul><p>between</p><ul><li>{long}2</li></ul>",
        f"<table><tbody><tr><td>{long}1</td></tr></tbody></table><p>between</p><table><tbody><tr><td>{long}2</td></tr></tbody></table>",
    )
    want = f"Title\nlead\n{long}1\nbetween\n{long}2\nend"
    for part in parts:
        for around in ("article", "main", "div"):
            page = f"<body><nav><p>{long}</p></nav><{around}><h1>Title</h1><p>lead</p>{part}<p>end</p></{around}><div class='other'><p>other</p></div></body>"
            for path in (None, max(html.scored(page), key=html.scored(page).get)):
                assert html.extract(page, path) == want


def test_a_form_around_the_page_is_no_noise():
    page = "<body><form id='form1'><div class='main'><h1>Title</h1><p>Text of the page, long enough.</p></div></form><form class='search'><p>Find it</p></form></body>"
    assert html.extract(page, None) == "Title\nText of the page, long enough."
    page = "<body><div class='main'><p>Text of the page, long enough.</p></div><form><p>Find it</p></form></body>"
    assert html.extract(page, None) == "Text of the page, long enough."


def test_time_grows_with_length():
    """300 kB of markup that never ends, or nests without end, is read in seconds."""
    import time

    for unit in ("<a ", '<a "', "<a '\"", "<!", "<!--", "</script", "<script></script", "<div>", "<div class='a'>x", "<h1>", "<li>", "</p>", "<p>", "<b class='ad'>", "<", "<dd><h1>", "<form>"):
        page = "<p>start</p>" + unit * (300_000 // len(unit))
        began = time.process_time()
        assert "x" in html.extract(page, None) or "start" in html.extract(page, None), unit
        assert time.process_time() - began < 8, unit


def test_titles_and_inline_noise():
    page = (
        "<body><div class='page-header'><p>Site</p></div><article><div class='entry-header'><h1>Title</h1></div><p>One <span class='ad'>buy <span>now</span></span>two<span class='share'>Share</span>.</p>"
        "<button>Press</button><p>Three <b class='x'>four</b> <span class='ads'>that never closes</p><p>Five</p><div class='entry-footer'>tags</div></article></body>"
    )
    assert html.extract(page, None) == "Title\nOne two.\nThree four that never closes\nFive"
    page = "<body><article><p>One</p><span class='advert'><div>Buy</div><p>it</p></span><p>Two</p></article></body>"
    assert html.extract(page, None) == "One\nTwo"


def test_quoted_ends():
    assert html.extract("<p title='a > b' class=\"x\">text</p>", None) == "text"
    assert html.extract("<p title='" + "long " * 200 + "> still'>text</p>", None) == "text"
    assert html.extract("<p title='open>text</p><p>more</p>", None) == "text\nmore"


LAYOUTS = (
    "class='site sidebar-right'", "class='layout sidebar-right'", "class='site nav-open'", "class='page header-fixed'", "class='row ad'", "class='search-results'", "class='widget-content'",
    "class='story-header'", "class='page-notice'", "class='content related-post'", "class='post-toc'", "id='sidebar-layout'",
)


def test_layouts_named_by_what_stands_beside(spark):
    """An article or main in a container whose name says noise; real noise beside it and around comments stays out."""
    noise = "<div class='sidebar'><p>A long line beside the text, and more of it.</p></div><div class='comments'><article class='comment-body'><p>A reader says so.</p></article></div><div class='ad'><p>Buy it now.</p></div>"
    pages, want = [], {}
    for n, layout in enumerate(LAYOUTS):
        for m, tag in enumerate(("article", "main", "article class='post'")):
            body = f"<{tag}><h1>Title {n}</h1><p>One {m}.</p><p>Two.</p></{tag.split()[0]}>"
            for k, page in enumerate((f"<div {layout}>{body}</div>{noise}", f"<div {layout}>{noise}<div class='inner'>{body}</div></div>", f"<div {layout}><div {layout}>{body}{noise}</div></div>")):
                pages.append((n * 100 + m * 10 + k, f"http://host{n}.example/{m}{k}", f"<html><body><nav><a href='/'>Home</a></nav>{page}<footer>Foot</footer></body></html>"))
                want[n * 100 + m * 10 + k] = f"Title {n}\nOne {m}.\nTwo."
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == want


def test_no_page_becomes_empty_by_a_name():
    assert html.extract("<body><div class='widget'><p>All the text that the page has.</p></div><nav><a href='/'>Home</a></nav></body>", None) == "All the text that the page has."
    assert html.extract("<body><div class='widget'><p>Beside it.</p></div><div><p>Text.</p></div></body>", None) == "Text."


def test_names_and_consensus_disagree(spark):
    """The host's pages agree on a container that is named after an advert beside it; one page has a longer box of a clean name."""
    page = lambda a, b: f"<body><div class='row ad'><main><p>{a}</p></main></div><div class='box'><p>{b}</p></div></body>"
    pages = [(i, "http://h.example/x", page("text " * 30, "more " * 4)) for i in range(5)] + [(9, "http://h.example/y", page("short text", "more " * 60))]
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got[9] == "short text" and got[0] == ("text " * 30).strip()


def test_all_classes_of_a_step_count():
    """Containers that differ in a fifth class are different ones."""
    page = "<body><div class='a b c d main'><p>The text of the page, long enough.</p></div><div class='a b c d wide'><p>Junk</p></div></body>"
    assert html.extract(page, None) == "The text of the page, long enough."
