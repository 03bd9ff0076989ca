"""Main text of web pages by tree scoring.

A page becomes a light tree without the parts that are never article text.
Paragraph-like blocks pass points for their length and commas to their ancestors,
less to farther ones, and every container's points are discounted by the share of
its text that stands in links.  The best container is kept, with those siblings
that score near it or read like paragraphs.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajectra.llm.common import prepare

# Element names of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg".split())
DROPPED = frozenset("head nav footer aside form button select option dialog menu canvas audio video map "
                    "datalist fieldset label legend annotation annotation-xml".split()) | RAW
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section "
                   "summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset("p pre td th blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}          # a start tag ends an open element of these
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"},
          "th": {"table", "tr"}, "option": {"select"}, "p": {"table", "td", "th", "button", "object"}}

# Names of classes, ids and roles that mark what is not article text (whole words of the name).
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo promotion promoted banner "
    "sidebar rail nav navbar navigation menu submenu breadcrumb breadcrumbs footer masthead topbar toolbar header "
    "siteheader pageheader comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations pagination pager search searchbox widget widgets skip outbrain taboola "
    "complementary contentinfo dialog form hidden".split())
# Those of them that name what a box is even within a longer name ("comments-area"); the others may stand for a layout
# ("page-with-sidebar") or a heading ("market-share"), so a box with such a word in a longer name is judged by its content.
NEVER = frozenset(
    "comment comments commentlist disqus reply replies respond cookie cookies consent gdpr newsletter subscribe subscription signup login "
    "related recommended recommendations outbrain taboola breadcrumb breadcrumbs pagination pager modal popup overlay advertisement "
    "advertising advertorial sponsored hidden".split())
# Names that mark a menu where most of the box is links.
MENU = frozenset("toc links linklist tags taglist topics categories sitemap".split())
SOURCES = frozenset("reference references reflist source sources citation citations footnote footnotes bibliography".split())
ARTICLE = frozenset("article articlebody articlecontent main maincontent content post postbody postcontent entry "
                    "entrycontent story storybody text body".split())

_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*'|[\"'])*+)>", re.S)
_attribute = re.compile(r"(?<![^\s=/\"'>])([^\s=/\"'>]++)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)
_raw_end = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_words = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+").findall
_hidden = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I).search
SIBLING_SHARE = 0.2
MOSTLY_LINKS = 0.6
SHORT_LINK = 25              # characters of a menu's link, on average


class Node:
    __slots__ = ("tag", "parent", "children", "name", "points", "chars", "links", "n_links", "marks", "before", "doubt")

    def __init__(self, tag: str, parent: "Node | None", name: str = "", doubt: str = ""):
        self.tag, self.parent, self.name = tag, parent, name
        self.children: list = []
        self.points = self.chars = self.links = 0.0
        self.n_links = self.marks = 0          # links with text; articles, main parts and first headings
        self.before: Node | None = None        # the element beside it that stands before
        self.doubt = doubt                     # "id" or "class": what names it like a part that is not article text

    def density(self) -> float:
        return self.links / self.chars if self.chars else 0.0


def _is_boilerplate(tag: str, attributes: dict[str, str], in_article: bool) -> bool | str:
    """Whether an element is no article text by its name; "id" or "class" if its content has to tell."""
    if tag in ("body", "html", "article", "main") and "class" not in attributes and "id" not in attributes:
        return False
    if tag == "header":
        return not in_article          # an article's own header holds its title
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or _hidden(attributes.get("style", "")):
        return True
    if tag in ("body", "html"):
        return False
    doubt: bool | str = False
    for key in ("id", "class", "role"):
        for part in attributes.get(key, "").split():
            whole = re.sub(r"[^a-z]", "", part.lower())
            if whole in ARTICLE:
                continue
            words = [w.lower() for w in _words(part)]
            if whole in NOT_ARTICLE or any(w in NOT_ARTICLE for w in words):
                # "article-header" of a heading and "has-sidebar" of a wrapper are about their content, not themselves
                if not ({"has", "with", "no"} & set(words[:1]) or (in_article and words[-1:] == ["header"])):
                    if whole in NOT_ARTICLE or any(w in NEVER for w in words):
                        return True
                    doubt = "id" if key == "id" else "class"
    return doubt


INNER_FENCES = ("td", "th", "table", "article", "main", "body")
P_FENCES = tuple(FENCES["p"] | {"div", "section", "article", "li", "blockquote"})


def parse(page: str) -> Node:
    """The page's tree without dropped parts; tolerant of missing and stray end tags.

    Open elements are known by name and place, so no tag looks through the stack, and a
    page takes time in proportion to its length.
    """
    root = Node("html", None)
    at, pos, dropped, articles = root, 0, 0, 0
    stack: list[tuple[Node | None, str]] = [(root, "html")]       # None: an element inside a dropped part
    alive = [root]                                                # the open elements that are kept
    places: dict[str, list[int]] = {"html": [0]}                  # of the open elements of a name in the stack

    def text(piece: str) -> None:
        if piece and not dropped:
            at.children.append(html.unescape(piece))

    def last(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def close(back: int) -> None:
        """End the open elements from place ``back`` of the stack on."""
        nonlocal at, dropped, articles
        while len(stack) > back:
            node, tag = stack.pop()
            places[tag].pop()
            if node is None:
                dropped -= 1
            else:
                alive.pop()
                if tag in ("article", "main"):
                    articles -= 1
        at = alive[-1]

    while True:
        m = _token.search(page, pos) if page.find(">", pos) >= 0 or page.find("<!--", pos) >= 0 else None
        if m is None:                                                # no tag can end any more
            break
        text(page[pos:m.start()])
        pos = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            back = last(tag)
            # a stray end tag of an inline element ends nothing beyond its cell or article
            if back > 0 and (tag in BLOCKS or last(*INNER_FENCES) <= back):
                close(back)
            continue
        if tag in ("html", "body") and places.get(tag) and (tag == "html" or last(tag) > 0):
            continue
        if tag in BLOCKS and last("p") > max(0, last(*P_FENCES)):    # a block ends an open paragraph
            close(last("p"))
        if tag in CLOSES:
            while (back := last(*CLOSES[tag])) > max(0, last(*FENCES[tag])):
                close(back)
                if tag != "tr":
                    break
        if tag in RAW:
            if tag == "svg" and m.group(3).endswith("/"):            # elements of other languages may end in their start tag
                continue
            end = _raw_end[tag].search(page, pos)
            pos = end.end() if end else len(page)
            continue
        if tag in VOID:
            if not dropped and tag in ("br", "hr"):
                at.children.append(" " if tag == "br" else Node("hr", at))
            continue
        if tag in ("math", "mspace", "mprescripts", "none") and m.group(3).endswith("/"):
            continue
        attributes = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _attribute.findall(m.group(3))} if m.group(3) else {}
        if re.search(r"(?:^|\s)hidden(?:\s|$)", m.group(3) or ""):
            attributes["hidden"] = ""
        verdict = dropped or tag in DROPPED or _is_boilerplate(tag, attributes, articles > 0)
        places.setdefault(tag, []).append(len(stack))
        if verdict and not isinstance(verdict, str):
            if tag == "body":
                dropped = 0
            dropped += 1
            stack.append((None, tag))
            continue
        node = Node(tag, at, " ".join(attributes.get(k, "") for k in ("class", "id", "itemprop", "role")), verdict or "")
        node.before = next((c for c in reversed(at.children[-3:]) if not isinstance(c, str)), None)
        at.children.append(node)
        at = node
        alive.append(node)
        stack.append((node, tag))
        articles += tag in ("article", "main")
    text(page[pos:])
    _settle(root)
    return root


def _walk(root: Node) -> list[Node]:
    """All nodes, parents before children."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in reversed(n.children) if not isinstance(c, str)]
    return out


def _size(text: str) -> int:
    """Characters of ``text`` with single spaces."""
    words = text.split()
    return sum(map(len, words)) + max(0, len(words) - 1)


def _count(nodes: list[Node]) -> list[tuple[int, int]]:
    """Fill chars, links, n_links and marks bottom up; (characters, commas) of each node with its inline parts, in the order of ``nodes``."""
    inline: dict[int, tuple[int, int]] = {}
    for n in nodes:
        n.chars = n.links = n.points = 0.0
        n.n_links = n.marks = 0
    for n in reversed(nodes):
        loose = "".join(c for c in n.children if isinstance(c, str))
        size = _size(loose)
        n.chars += size
        if n.tag == "a":
            n.links, n.n_links = n.chars, n.n_links + (n.chars > 0)
        n.marks += n.tag in ("article", "main", "h1")
        here = inline.get(id(n), (0, 0))
        inline[id(n)] = here = (here[0] + size, here[1] + loose.count(",") + loose.count("、") + loose.count("،"))
        if n.parent:
            n.parent.chars += n.chars
            n.parent.links += n.links
            n.parent.n_links += n.n_links
            n.parent.marks += n.marks
            if n.tag not in BLOCKS:
                up = inline.get(id(n.parent), (0, 0))
                inline[id(n.parent)] = (up[0] + here[0], up[1] + here[1])
    return [inline[id(n)] for n in nodes]


MOST = 0.6                   # of a page's text: such a box is the page, whatever its name
PROSE = 80                   # characters that make a named part of an article prose


def _settle(root: Node) -> None:
    """Take out the boxes whose name is in doubt unless their content is the page's, or prose of its article.

    A box that holds most of the page's text and every article, main part and first
    heading is a layout's wrapper.  A part of an article named by its id alone is a
    section under a heading if it is prose.
    """
    nodes = _walk(root)
    if not any(n.doubt for n in nodes):
        return
    _count(nodes)
    todo = [(root, False)]
    while todo:
        n, in_article = todo.pop()
        if n.doubt and n.parent is not None:
            wrapper = n.chars >= MOST * root.chars and n.density() < 0.5 and n.marks == root.marks
            section = n.doubt == "id" and in_article and n.chars >= PROSE and n.density() < 0.25
            if not (wrapper or section):
                n.children = []
                continue
        in_article = in_article or n.tag in ("article", "main")
        todo += [(c, in_article) for c in n.children if not isinstance(c, str)]


def score(root: Node) -> list[Node]:
    """Count text and links bottom up, then pass points of paragraphs and loose text to ancestors."""
    nodes = _walk(root)
    for n, (size, commas) in zip(nodes, _count(nodes)):
        if n.tag not in BLOCKS or not size:
            continue
        points = (1 + commas + min(size / 100, 3.0)) * (1 - n.density())
        up, share = (n.parent if n.tag in PARAGRAPHS else n), 1.0
        while up is not None and share > 0.05:
            up.points += points * share
            up, share = up.parent, share / 2
    return nodes


def _value(n: Node) -> float:
    words = {re.sub(r"[^a-z]", "", w.lower()) for w in n.name.split()}
    bonus = 1.25 if n.tag in ("article", "main") or words & ARTICLE else 1.0
    return n.points * (1 - n.density()) * bonus


def main_nodes(root: Node) -> list[Node]:
    """The best container and its siblings that belong to it.

    A page that marks its article or main part has told the container: the best of
    those is taken, with other articles beside it that score near it, and the title and
    paragraphs beside it.
    """
    nodes = score(root)
    marked = [n for n in nodes if n.tag in ("article", "main") and n.points > 0]
    best = max(marked or (n for n in nodes if n.tag in BLOCKS), key=_value, default=root)
    if best.points == 0:
        return [root]
    if not marked:       # a wrapper around several such containers is the article
        while best.parent is not None and best.tag not in ("body", "html") and best.parent.tag not in ("body", "html") and \
                _value(best.parent) >= 0.75 * _value(best):
            best = best.parent
    if best.parent is None:
        return [best]
    least = max(3.0, SIBLING_SHARE * _value(best))
    out = []
    for n in best.parent.children:
        if n is best:
            out.append(n)
        elif not isinstance(n, str) and n.tag in BLOCKS:
            like_text = n.tag in ("p", "h1", "h2", "header", "hgroup", "pre", "blockquote") and n.chars > 0 and n.density() < 0.25
            if like_text or ((not marked or n.tag == "article") and _value(n) >= least and n.density() < MOSTLY_LINKS):
                out.append(n)
    return out


def _is_menu(n: Node) -> bool:
    """A box of mostly links that is named a menu, or has nothing but short links and no heading of its own.

    A list of references is mostly links, too, but stays: its links are titles, have
    text beside them, or stand under a heading.
    """
    if n.tag not in ("ul", "ol", "div", "section", "table", "dl") or n.density() <= MOSTLY_LINKS \
            or sum(isinstance(c, Node) for c in n.children) < 2:
        return False
    names = {w.lower() for w in _words(n.name)}
    if names & SOURCES:
        return False
    if names & MENU:
        return True
    if n.density() < 0.99 or n.chars > SHORT_LINK * n.n_links:
        return False
    heading = n.before
    if heading is None or heading.tag not in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return True
    title = "".join(c for x in _walk(heading) for c in x.children if isinstance(c, str))
    return any(w.lower() in NOT_ARTICLE | MENU for w in _words(title))


def blocks_of(nodes: list[Node]) -> list[str]:
    """Text of the nodes' blocks in page order; menus are left out."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        line = " ".join("".join(run).split())
        if line:
            out.append(line)
        run.clear()

    todo: list = list(reversed(nodes))
    top = set(map(id, nodes))
    while todo:
        n = todo.pop()
        if n is None:
            end()
        elif isinstance(n, str):
            run.append(n)
        else:
            if id(n) not in top and _is_menu(n):
                end()
                continue
            block = n.tag in BLOCKS
            if block:
                end()
                todo.append(None)
            todo += reversed(n.children)
    end()
    return out


def main_text(page: str | None) -> str:
    """The article of a page: blocks joined by newlines, each with single spaces; empty if there is none."""
    if not page:
        return ""
    return "\n".join(blocks_of(main_nodes(parse(page))))


def _main_texts(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype="object")


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Null, empty and textless pages give an empty text.  Repeated rows give equal
    rows; null ids and urls are kept.  An empty table gives an empty result.  Other
    columns are not read.
    """
    prepare(pages.sparkSession)
    out = pages.select("page_id", "url", F.pandas_udf(_main_texts, "string")(F.col("html")).alias("text"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
