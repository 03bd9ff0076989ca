import html
import random

import pytest

from trajectra.llm.html_extract import extract, main_text

CASES = {
    "plain article": ("<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1>"
                      "<p>One,  two\n three.</p><p>Four</p></article><footer>f</footer></body></html>", "T & U\nOne, two three.\nFour"),
    "scored div": ('<div id="header">Site</div><div class="sidebar"><p>Side, text, long, with commas.</p></div><div class="post">'
                   "<h2>Title</h2><p>One, two, three and more text in here.</p><div><p>More</p><ul><li>x</li><li>y &amp; z</li></ul></div>"
                   '</div><div class="comments"><p>Nice, post, indeed, my friend, so good.</p></div>',
                   "Title\nOne, two, three and more text in here.\nMore\nx\ny & z"),
    "unclosed": ("<article><p><b>a<br><p>b<ul><li>c<li>d</ul></article>", "a\nb\nc\nd"),
    "script and comment": ("<article><script>if (a<b) x('</p>')</script><!-- <p>no --><style>p{}</style><p>yes</p></article>", "yes"),
    "notice, form, share": ("<main><div class='cookie-notice'>Cookies!</div><p>Only <a href=x>link</a> text.</p><form><input>q</form>"
                            "<div class=social-share>Share</div></main><div><p>" + "other, " * 50 + "</p></div>", "Only link text."),
    "article header": ("<header>Site</header><article><header><h1>T</h1></header><p>A a a.</p></article>", "T\nA a a."),
    "menu inside": ("<article><p>Text, here.</p><ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul></article>", "Text, here."),
    "references": ("<article><p>&eacute;&#233;&#xe9;&lt;b&gt;&nbsp;x &amp;amp; &notanentity;</p></article>", "ééé<b> x &amp; ¬anentity;"),
    "hidden": ("<article><p>a</p><p hidden>b</p><p style='display: none'>c</p></article>", "a"),
    "table": ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n2\n3"),
    "text only": ("just text &lt;b&gt;", "just text <b>"),
    "odd quotes": ("<article><p title='a\">x</p><p>y</p></article>", None),
    "empty": ("", ""), "none": (None, ""), "blank": ("<html><body> \n</body></html>", ""), "broken": ("<article><p", None),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    page, want = CASES[name]
    got = main_text(page)
    assert isinstance(got, str) and (want is None or got == want)


def test_made_pages():
    """Pages built around known blocks give the blocks back."""
    rnd = random.Random(5)
    word = lambda: rnd.choice(["a&b", "x<y", "é", "comma,", "ad", "the", "***", "中文"])
    for _ in range(200):
        blocks = [" ".join(word() for _ in range(rnd.randrange(1, 60))) for _ in range(rnd.randrange(1, 12))]
        inner = "".join(f"<p class='x{i}'>{html.escape(b)}</p>\n" for i, b in enumerate(blocks))
        around = rnd.choice(["<article>%s</article>", "<main>%s</main>", "<div class='post-content'>%s</div>", "<section id=story>%s</section>"])
        page = ("<!doctype html><html><head><style>a{}</style></head><body><nav><ul>" + "<li><a href=#>m</a></li>" * 9 + "</ul></nav>"
                "<div class='ad'>buy, now, cheap, all, day</div>" + around % inner +
                "<aside><p>side, bar, text, long</p></aside><div class='comments'><p>so, nice, yes, good, one</p></div><footer>end</footer>")
        assert main_text(page) == "\n".join(blocks)


def test_unclosed_quotes_do_not_hang():
    main_text("<a " + "\"'" * 50_000)
    main_text("<div>" * 5_000 + "x")


def test_query_rows(spark):
    from pyspark.sql import functions as F
    rows = [(1, "u", CASES["plain article"][0]), (1, "u", CASES["plain article"][0]), (None, None, None), (2, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(1))
    got = extract(df).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id != 1} == {""}
    assert extract(df.limit(0)).collect() == []


KEPT = {
    "figure": ("<article><p>Text, here.</p><figure><img src=x><figcaption>A caption.</figcaption></figure></article>",
               "Text, here.\nA caption."),
    "title and lead beside the article": ("<main><h1>T</h1><p>Lead</p><article><p>One, two, three.</p></article></main>",
                                          "T\nLead\nOne, two, three."),
    "header beside the article": ("<main><header><h1>T</h1></header><article><p>One, two, three.</p></article></main>", "T\nOne, two, three."),
    "sources under a heading": ("<article><p>Text, here.</p><h2>Sources</h2><ul><li><a href=1>Smith 2010</a></li><li><a href=2>Lee 2011</a>"
                                "</li></ul></article>", "Text, here.\nSources\nSmith 2010\nLee 2011"),
    "references": ("<article><p>Text, here.</p><ol><li>Smith, <a href=1>A study of the growth of many things</a></li><li>Lee, "
                   "<a href=2>Another study of the same things</a></li></ol></article>",
                   "Text, here.\nSmith, A study of the growth of many things\nLee, Another study of the same things"),
    "menu by name": ("<article><p>Text, here.</p><ul class=toc><li><a href=1>A long title of the first part of this text</a></li>"
                     "<li><a href=2>A long title of the second part of this text</a></li></ul></article>", "Text, here."),
    "menu under a heading": ("<article><p>Text, here.</p><h3>Related</h3><ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul></article>",
                             "Text, here.\nRelated"),
}


@pytest.mark.parametrize("name", KEPT)
def test_article_text_is_kept(name):
    assert main_text(KEPT[name][0]) == KEPT[name][1]


ARTICLE = "<h1>Title</h1><p>One, two and three, the text of this article.</p><p>More of it, and more, until it is enough.</p>"
TEXT = "Title\nOne, two and three, the text of this article.\nMore of it, and more, until it is enough."
NAMED = {
    "wrapper with a sidebar": f"<div class='page-with-sidebar'><nav>menu</nav>{ARTICLE}<div class=sidebar><p>Side, bar, text.</p></div></div>",
    "layout": f"<div class='layout sidebar-right'><div class=content>{ARTICLE}</div><div class='sidebar-inner'><p>Side, bar.</p></div></div>",
    "article with ads": f"<article class='post has-ads promo-story'>{ARTICLE}<div class=ads>Buy, now, cheap.</div></article>",
    "comments are never the page": f"<article>{ARTICLE}</article><div class='comments-area'>{'<p>Nice, post, indeed, my friend, so good.</p>' * 30}</div>",
    "a sidebar larger than the article": f"<main>{ARTICLE}</main><div class='left-sidebar'>{'<p>Side, bar, text, with, commas, all day.</p>' * 30}</div>",
    "self-closing drawing": f"<article>{ARTICLE.replace('Title', '<svg class=i/>Title')}</article>",
}


@pytest.mark.parametrize("name", NAMED)
def test_names_are_judged_with_the_content(name):
    assert main_text(NAMED[name]) == TEXT


def test_sections_named_by_their_headings():
    prose = "The share of the market grew, and the search went on for days, as many had hoped it would be."
    page = f"<article>{ARTICLE}<section id='market-share'><h2>Market share</h2><p>{prose}</p></section><section id='search-and-rescue'><p>{prose}</p></section>" \
           "<div id='share-buttons'>Share this</div></article>"
    assert main_text(page) == f"{TEXT}\nMarket share\n{prose}\n{prose}"


def test_formulas_and_objects():
    assert main_text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds, always.</p>"
                     "<object data=f><p>A figure, as text.</p></object></article>") == "So x=1 holds, always.\nA figure, as text."


BROKEN = {
    "starts without ends": "<a " * 8000, "stray ends": "<b>t" * 8000 + "</i>" * 8000, "long attribute": "<a " + "x" * 300_000 + ">y</a>",
    "deep and closed": "<b>" * 20_000 + "<li>x</li>" * 5000, "dropped deep": "<nav>" + "<b>" * 20_000 + "</b>" * 20_000,
    "comments": "<!-- x" * 20_000, "declarations": "<!x " * 20_000, "odd quotes": "<a \"x' " * 20_000 + ">", "cells": "<table>" + "<td><p>a" * 20_000,
    "menus": "<div>" + "<ul><li><a href=x>a</a><li><a href=y>b</a></ul>" * 8000, "inline": "<p>" + "<i>a, b" * 30_000,
    "doubt": "<div class='a-share'>" * 5000 + "x", "blocks in inline": "<b>" * 10_000 + "<p>x" * 10_000,
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_pages_take_time_by_their_length(name):
    import time
    t = time.process_time()
    main_text(BROKEN[name])
    assert time.process_time() - t < 3


def test_points_against_brute_force():
    """Points of every block of made trees, each ancestor's share worked out alone."""
    from trajectra.llm.html_extract import BLOCKS, PARAGRAPHS, _walk, parse, score
    rnd = random.Random(11)

    def made(depth):
        if depth == 0 or rnd.random() < 0.2:
            return rnd.choice(["some words, here", "more", "a, b, c and d " * rnd.randrange(1, 12), ""])
        tag = rnd.choice(["div", "p", "section", "a", "b", "td", "article"])
        return f"<{tag}>" + "".join(made(depth - 1) for _ in range(rnd.randrange(1, 4))) + f"</{tag}>"

    def strings(n, inline_only):
        for c in n.children:
            if isinstance(c, str):
                yield c
            elif not inline_only or c.tag not in BLOCKS:
                yield from strings(c, inline_only)

    def size(pieces):
        return sum(sum(map(len, x.split())) + max(0, len(x.split()) - 1) for x in pieces)

    def own_texts(n, within_link=False):
        """(loose text of each node below, whether inside a link)."""
        link = within_link or n.tag == "a"
        yield "".join(c for c in n.children if isinstance(c, str)), link
        for c in n.children:
            if not isinstance(c, str):
                yield from own_texts(c, link)

    def inline_texts(n):
        yield "".join(c for c in n.children if isinstance(c, str))
        for c in n.children:
            if not isinstance(c, str) and c.tag not in BLOCKS:
                yield from inline_texts(c)

    for _ in range(60):
        root = parse("".join(made(5) for _ in range(4)))
        nodes = score(root)
        want = {id(n): 0.0 for n in nodes}
        for n in _walk(root):
            pieces = list(inline_texts(n))
            if n.tag not in BLOCKS or not size(pieces):
                continue
            every = list(own_texts(n))
            share_of_links = size(x for x, link in every if link) / size(x for x, _ in every)
            points = (1 + sum(x.count(",") for x in pieces) + min(size(pieces) / 100, 3)) * (1 - share_of_links)
            up, far = (n.parent if n.tag in PARAGRAPHS else n), 0
            while up is not None and far < 5:
                want[id(up)] += points / 2 ** far
                up, far = up.parent, far + 1
        for n in nodes:
            assert n.points == pytest.approx(want[id(n)])
