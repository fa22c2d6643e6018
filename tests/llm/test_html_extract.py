import math

import pytest

from veilgate.llm import html_extract as H

LONG = "A sentence of the article that goes on for quite a while, so that it is dense enough to matter. "


def article(inner, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{before}<article>{inner}</article>{after}</body></html>"


NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">More</a></li></ul></nav>'
CASES = {
    "plain": (article(f"<h1>Head &amp; tail</h1><p>{LONG}</p><p>The.</p>", NAV, "<footer>&copy; me</footer>"), ["Head & tail", LONG.strip(), "The."]),
    "entities": (article("<p>a&lt;b&gt; &eacute; &#233; &#xe9; &amp;amp; &am &copy x&nbsp;y &bogus; 1 < 2</p>"), ["a<b> é é é &amp; &am © x y &bogus; 1 < 2"]),
    "unclosed": (article("<p><b>One<br><p>Two <i>three</i>four\n\t five<li>six"), ["One", "Two threefour five", "six"]),
    "line break": (article("<p>one<br>two<br/>three</p>"), ["one two three"]),
    "script": (article('<p>x</p><script>var t="</p><p>no</p>";</script><style>p{}</style><!-- <p>no</p> --><p>y</p>'), ["x", "y"]),
    "furniture inside": (
        article(
            f'<header><h1>Title</h1></header><p>{LONG}</p><div class="ad-box">Buy</div><aside>Side</aside><form><p>Mail?</p><input></form>'
            '<div id="share-bar">Share</div><div class="cookieNotice">Cookies</div><section class="comments"><p>First!</p></section><p hidden>h</p>'
            '<p style="display: none">h</p><p class="no-sidebar">kept</p>'
        ),
        ["Title", LONG.strip(), "kept"],
    ),
    "no article element": (
        f'<body><header>Site</header>{NAV}<h1>The headline of the page stands here</h1><div class="content"><p>{LONG}</p><p>{LONG}</p><p>Short.</p></div>'
        f'<div class="sidebar"><p>{LONG}</p></div><div><a href="x">one link</a> <a href="y">two links here</a></div><footer>f</footer></body>',
        ["The headline of the page stands here", LONG.strip(), LONG.strip(), "Short."],
    ),
    "main": (f"<body>{NAV}<main><h2>Hi</h2><p>{LONG}</p></main><div>outside text</div></body>", ["Hi", LONG.strip()]),
    "one paragraph": (f"<p>{LONG}", [LONG.strip()]),
    "no markup": ("just text & more", ["just text & more"]),
    "cut": (article(f"<p>{LONG}</p>").replace("</body></html>", "") + "<foot", [LONG.strip()]),
    "upper case": ("<BODY><NAV>n</NAV><ARTICLE CLASS=x><P>Text</P></ARTICLE></BODY>", ["Text"]),
    "quoted bracket": (article('<p title="a > b" class=\'c\'>in</p><p title="open>broken</p><p>next</p>'), None),
    "comment open": (article("<p>x</p>") + "<!-- never closed <p>no</p>", ["x"]),
    "only furniture": (f"<body>{NAV}<footer>f</footer></body>", []),
    "empty": ("", []),
    "null": (None, []),
    "table": (article("<table><tr><td>a<td>b<tr><td>c</table>"), ["a", "b", "c"]),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    source, want = CASES[name]
    got = H.main_text(source)
    if want is not None:
        assert got == "\n".join(want)


def test_densities_equal_the_definition():
    page = H.Page(article(f'<h1>abc</h1><p>{LONG}<a href="x">link text</a></p><ul><li><a>m</a></li></ul>', NAV))
    density, total, _ = H.densities(page)
    n = len(page.tags)

    def below(k):
        out, more = [], [k]
        while more:
            at = more.pop()
            kids = [j for j in range(1, n) if page.parents[j] == at]
            out += kids
            more += kids
        return out

    def linked(k):
        while k > 0:
            if page.tags[k] == "a":
                return True
            k = page.parents[k]
        return False

    def size(nodes, only=lambda k: True):
        return sum(len("".join(t.split())) for k, t in page.pieces if t is not None and k in nodes and only(k))

    all_nodes = set(range(n))
    share = size(all_nodes, linked) / size(all_nodes)
    for k in range(n):
        inner = below(k)
        c, lc = size({k, *inner}), size({k, *inner}, linked)
        t, lt = max(1, len(inner)), max(1, sum(page.tags[j] == "a" for j in inner))
        if c:
            base = max(1.1, math.log(c / max(1, c - lc) * lc + share * c + math.e))
            want = c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(base)
            assert density[k] == pytest.approx(want, abs=1e-3)
        assert total[k] == pytest.approx(sum(density[j] for j in range(1, n) if page.parents[j] == k and not page.furniture[j]))


def test_rows(spark):
    rows = [(1, "u", CASES["plain"][0]), (1, "u", CASES["plain"][0]), (None, None, None), (2, "v", "<article><p>" + "word " * 200_000 + "</p></article>")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id or 0), r.url or "", r.n_chars) for r in H.extract(frame).collect())
    n = len("\n".join(CASES["plain"][1]))
    assert got == [(0, "", 0), (1, "u", n), (1, "u", n), (2, "v", 999_999)]
    assert H.extract(frame.limit(0)).collect() == []


def test_deep_and_odd_pages_do_not_crash():
    assert H.main_text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert H.main_text("<p>" * 5000 + "</a></b>" * 5000) == ""
    H.main_text('<a title="' * 3000)
    H.main_text("<" * 50_000)


@pytest.mark.parametrize(
    "opening",
    [
        "article class='post category-social'", "article class='tag-advertising'", "main class='content-with-sidebar'", "div class='post-no-comments'",
        "section id='market-share'", "div class='social-wrap'",
    ],
)
def test_names_do_not_make_furniture_of_the_article(opening):
    page = f"<body>{NAV}<{opening}><p>{LONG}</p><p>Short.</p></{opening.split()[0]}><div class='site-footer'>f</div><div class='ad-box'>Buy</div></body>"
    assert H.main_text(page) == f"{LONG.strip()}\nShort."
    wrapped = f"<body><div class='widget page'><article><p>{LONG}</p></article></div><div class='comments'><p>{LONG}</p><p>{LONG}</p></div></body>"
    assert H.main_text(wrapped) == LONG.strip()


def test_what_stands_beside_an_article_in_main_is_judged():
    page = f"<body>{NAV}<main><h1>Title</h1><p>{LONG}</p><article>{f'<p>{LONG}</p>' * 8}</article><article><p>{LONG}</p></article><ul><li><a href='x'>more</a></li></ul></main><div>out</div></body>"
    assert H.main_text(page) == "\n".join(["Title", *[LONG.strip()] * 10])
    nested = f"<body><article><h1>Title</h1><p>lead</p><article><p>{LONG}</p><p>{LONG}</p></article></article></body>"
    assert H.main_text(nested) == "\n".join(["Title", "lead", *[LONG.strip()] * 2])
