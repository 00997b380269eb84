"""Extraction from pages of several layouts, and the votes of hosts."""

import os
import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from heronry.llm.html_extract import extract, host_paths, main_text, url_host

P1 = "The first paragraph is long enough to look like an article &amp; has a reference."
P2 = "The second one, with <b>bold</b> and <a href='/x'>a link</a>, goes on\n  over   lines."
T1 = "The first paragraph is long enough to look like an article & has a reference."
T2 = "The second one, with bold and a link, goes on over lines."
NAV = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li></ul></nav>"

LAYOUTS = {
    "article": f"<body>{NAV}<article><h1>Title</h1><p>{P1}</p><p>{P2}</p></article><footer>&copy; me</footer></body>",
    "unclosed": f"<body>{NAV}<article><h1>Title</h1><p>{P1}<p>{P2}</article><footer>&copy; me",
    "body inside": f"<article><h1>Title</h1><div class=body><p>{P1}</p><p>{P2}</p></div></article><aside>More</aside>",
    "main with sections": f"<main><h1>Title</h1><section><p>{P1}</p></section><section><p>{P2}</p></section></main><div id='sidebar'>Links</div>",
    "comments": f"<article><h1>Title</h1><p>{P1}</p><p>{P2}</p></article><div class='comments'><p>A reader says something that is longer than all of the article and more so, on and on and on and on.</p></div>",
    "notices and adverts": f"<div class='cookie-notice'>We use cookies.</div><article><h1>Title</h1><div class='ad'>Buy!</div><p>{P1}</p><div role='alert'>Note!</div><p>{P2}</p><form><input name=q><button>Go</button><label>Mail</label></form></article>",
    "upper case and scripts": f"<BODY><SCRIPT>var t='<p>no</p>';</SCRIPT><STYLE>p{{}}</STYLE><ARTICLE><H1>Title</H1><P>{P1}</P><!-- <p>no</p> --><P>{P2}</P></ARTICLE></BODY>",
    "layout named for its sidebar": f"<div class='has-sidebar'><article><h1>Title</h1><p>{P1}</p><p>{P2}</p></article></div><div class='sidebar'>Old posts</div>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    assert main_text(LAYOUTS[name]) == f"Title\n\n{T1}\n\n{T2}"


@pytest.mark.parametrize("page", [None, "", " ", "<", "<<<>>>", "</p></div>", "<script>never closed", "<!-- open", "<p", "&#0;&bogus;", "<div>" * 5000, "<a href='" + "x" * 100_000, "<p>" + "é " * 100_000])
def test_odd_pages_do_not_fail(page):
    assert isinstance(main_text(page), str)


DEEP = 20_000


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body><article>" + "<div>" * DEEP + f"<p>{P1}</p>" + "</div>" * DEEP + "</article></body>", T1),
        ("<body><div class='post'>" + "<div>" * DEEP + f"<p>{P1}", T1),
        ("<body><article>" + f"<ul><li>{P1}" * DEEP + "</article></body>", "\n\n".join([T1] * DEEP)),
        ("<body>" + "<div class='menu'>" * DEEP + f"<p>{P1}", T1),
        ("<body><article><p>" + "<b>" * DEEP + P1, T1),
    ],
    ids=["containers in an article", "containers", "lists", "named elements", "inline elements"],
)
def test_pages_of_any_depth(page, text):
    """Elements may be nested as deep as a page is long; work is in proportion to the page, or this would take minutes."""
    assert main_text(page) == text


def test_nothing_is_capped():
    words = "word " * 200_000
    assert main_text(f"<article><p>{words}</p></article>") == words.strip()


def test_a_host_votes_for_its_container(spark):
    """Two pages whose own text is small are read from the container that the host's other pages use."""
    full = f"<body><div class='post-12'><p>{P1}</p><p>{P2}</p></div><div class='box'><p>x</p></div></body>"
    short = "<body><div class='post-7'><p>Short.</p></div><div class='box'><p>A box whose text is longer than the post of this page.</p></div></body>"
    rows = [(i, f"http://a.example/{i}", full) for i in range(5)] + [(5, "http://a.example/5", short), (6, "http://b.example/6", short)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    paths = {r.host: r.paths for r in host_paths(pages).collect()}
    assert paths["a.example"][0] == "#>body>div.post"
    found = {r.page_id: r.text for r in extract(pages).collect()}
    assert found[0] == f"{T1}\n\n{T2}"
    assert found[5] == "Short."
    assert found[6] == "A box whose text is longer than the post of this page."


def test_every_path_of_a_host_counts(spark):
    """A host of 40 layouts: those of few votes are read like the others, with all containers at the path."""
    big, small = "A long part of the article. " * 7, "The rest of the article stands in a box of its own. "
    layouts = ["".join(chr(97 + int(c)) for c in f"{i:02}") for i in range(39)]
    rows = [(f"<body><div class='x{n}'><p>{big}</p></div><div class='x{n}'><p>{small}</p></div></body>", f"{big.strip()}\n\n{small.strip()}") for n in layouts for _ in range(4)]
    full = f"<body><div class='post'><p>{P1}</p><p>{P2}</p></div><div class='box'><p>x</p></div></body>"
    short = "<body><div class='post'><p>Short.</p></div><div class='box'><p>A box whose text is longer than the post of this page.</p></div></body>"
    rows += [(full, f"{T1}\n\n{T2}")] * 2 + [(short, "Short.")]
    pages = spark.createDataFrame([(i, None, p) for i, (p, _) in enumerate(rows)], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in extract(pages).collect()}
    assert found == {i: t for i, (_, t) in enumerate(rows)}
    assert main_text(rows[0][0]) == rows[0][1]


def test_nulls_repeats_and_other_columns(spark):
    page = LAYOUTS["article"]
    rows = [(1, None, page, "u"), (1, None, page, "u"), (None, "nowhere", None, "u"), (2, "http://h", "", "u")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("paths", F.lit("p")).withColumn("host", F.lit(1))
    out = extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(map(tuple, out.collect()), key=repr)
    text = f"Title\n\n{T1}\n\n{T2}"
    assert got == sorted([(1, None, text, len(text))] * 2 + [(None, "nowhere", "", 0), (2, "http://h", "", 0)], key=repr)


def test_empty_table(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_hosts(spark):
    urls = ["HTTP://User@A.Example:80?x", "x://É.b#c/d", "no host", None, "a\n://h/p://q"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(url_host(F.col("url"))).collect()] == ["user@a.example:80", "É.b", "", "", "h"]


ARTICLE = f"<h1>Title</h1><p>{P1}</p><p>{P2}</p>"
READER = "<p>A reader says something that is longer than all of the article and more so, on and on, and on again, and once more, so that nobody could take it for short.</p>" * 3
WRAPPERS = {
    "a page named for its sidebar": f"<div class='page right-sidebar'>{ARTICLE}</div>",
    "content under a fixed header": f"<div class='content header-fixed'>{ARTICLE}</div><div>Copyright</div>",
    "an article in a box called social": f"<div id='social'><article>{ARTICLE}</article></div><p>Powered by something</p>",
    "readers in camel case": f"<div class='post'>{ARTICLE}</div><div class='userComments'>{READER}</div>",
    "comments that are articles": f"<div class='post'>{ARTICLE}</div><ol class='commentlist'><li class='comment'><article>{READER}</article></li></ol>",
    "a layout with its sidebar inside": f"<div class='layout-sidebar'><div class='post'>{ARTICLE}</div><div class='sidebar'><p>Old posts and more of them</p></div></div><p>Powered by x</p>",
    "a named inline element around it": f"<font class='menu-font'><div class='post'>{ARTICLE}</div></font><span class='ad'>Buy!</span>",
    "related articles": f"<main><article>{ARTICLE}</article><div class='related-posts'><article><p>Another article's beginning</p></article></div></main>",
    "a heading in a header": f"<div class='siteHeader'><h1>The site</h1></div><div class='post'>{ARTICLE}</div><div class='sideBar'><p>Old posts</p></div>",
    "a dialog and a banner": f"<div id='cookieConsent'><p>We use cookies, many of them.</p></div><div role='banner'><p>News</p></div><section class='entry'>{ARTICLE}</section><div class='shareButtons'>Share</div>",
    "nothing but a notice": f"<div class='notice'>{ARTICLE}</div>",
}


@pytest.mark.parametrize("name", WRAPPERS)
def test_wrappers_are_told_from_what_is_beside_an_article(name):
    assert main_text(f"<body>{WRAPPERS[name]}</body>") == f"Title\n\n{T1}\n\n{T2}"


def test_the_vote_helps_pages_of_short_articles(spark):
    """Hosts of several layouts, with boxes of a random length beside articles of a random length: voting reads more pages right."""
    r = random.Random(4)
    words = lambda n: " ".join(r.choice("abcdefgh") * r.randrange(2, 9) for _ in range(n))
    pages, truth = [], {}
    for host in ("a.example", "b.example"):
        for layout in ("lead", "text"):
            for i in range(40):
                article, box = words(r.choice([4, 30, 80, 150])), words(r.choice([2, 10, 40]))
                page = f"<body><div class='{layout}-{i}'><p>{article}</p></div><div class='{layout}box'><p>{box}</p></div></body>"
                truth[len(pages)] = article
                pages.append((len(pages), f"http://{host}/{i}", page))
    got = {x.page_id: x.text for x in extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    voted = sum(got[i] == t for i, t in truth.items())
    alone = sum(main_text(p) == truth[i] for i, _, p in pages)
    assert voted == len(pages) and alone < 0.95 * len(pages)


class Second(HTMLParser):
    """Another reading of the article element: blocks outside of elements that are beside it."""

    BLOCK = set("p h1 h2 h3 h4 h5 h6 li blockquote pre figcaption div section article ul ol table tr td th dt dd header footer form".split())
    OUT = set("nav header footer aside form script style noscript button select iframe svg".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.out, self.blocks, self.text = 0, [], [], []

    def flush(self):
        block = " ".join("".join(self.text).split())
        self.text = []
        if block:
            self.blocks.append(block)

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.depth += 1
        if tag in self.BLOCK:
            self.flush()
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
        if self.depth and (tag in self.OUT or (tag not in ("br", "img", "hr", "input") and self.out) or re.search(r"\b(ads?|advert|notice|comments?|share|related|newsletter|promo|sidebar)\b", names)):
            if tag not in ("br", "img", "hr", "input", "meta", "link"):
                self.out.append(tag)
        if tag == "br" and self.depth and not self.out:
            self.text.append(" ")

    def handle_endtag(self, tag):
        if self.out and tag in self.out:
            while self.out.pop() != tag:
                pass
        elif tag in self.BLOCK:
            self.flush()
        if tag == "article":
            self.depth -= 1

    def handle_data(self, data):
        if self.depth and not self.out:
            self.text.append(data)


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pages_equal_a_second_reading(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {p.page_id: p.html for p in pages.collect()}
    got = {x.page_id: x.text for x in extract(pages).collect()}
    same = 0
    for i, page in html.items():
        second = Second()
        second.feed(page or "")
        second.flush()
        same += got[i] == "\n\n".join(second.blocks)
    assert same >= 0.98 * len(html)
