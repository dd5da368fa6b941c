"""Main text of web pages by tree scoring."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: The kinds of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH = HEADING | set("p pre li dd dt td th blockquote figcaption caption summary legend address".split())
#: Elements that end an open p.
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: Elements that end an open one of the same family, up to the container they stand in.
FAMILY = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "option": ({"option"}, {"select", "datalist"})}
#: Elements whose content is text up to their end tag; none of it is main text.
RAW = set("script style title textarea iframe noembed noframes xmp".split())
#: Elements that never hold main text.
DROP = RAW | set("head noscript template nav footer aside form button select datalist menu dialog object svg canvas audio video map".split())
#: Words in class or id, and roles, of what surrounds an article.
AROUND = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead respond reply replies responses discussion discussions reactions cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager toolbar widget".split())
#: Of these, words that articles use of their own parts as well: inside one they count with many links only.
WEAK = set("alert banner footer header login masthead menu modal notice notices overlay popup promotion signup toolbar widget".split())
#: Beginnings of words that mark reader comments, and words that only begin alike.
COMMENTS, NO_COMMENTS = ("comment", "disqus"), set("commentary commentaries commentator commentators".split())
#: Words that articles have in the names of their own parts: inside one they count for parts without a paragraph, or of links.
SOFT = set("promo promotion recommendations recommended related share sharing social subscription widget".split())
#: Whole class names that make even a paragraph of an article an advert.
ADVERT = set("ad ads advert adverts advertisement sponsored".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
TITLES = set("article post entry content story title".split())
CONTENT = set("article main".split())

#: A sibling of the best container stays with this share of its score.
SIBLING = 0.2
#: Share of text in links from which a part of an article is a list of links.
LINKED = 0.5


class Node:
    __slots__ = ("attrs", "chars", "children", "linked", "links", "parent", "prose", "score", "size", "tag")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.score = 0.0
        self.size = self.links = self.chars = self.linked = self.prose = 0


def parse(html: str) -> Node:
    """A tree of any text: end tags may lack, tags may be cut off, quotes may stay open."""
    root = node = Node("", "", None)
    at = 0
    while at < len(html):
        m = TOKEN.search(html, at)
        if not m:
            node.children.append(html[at:])
            break
        if m.start() > at:
            node.children.append(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            up = node
            while up.parent and up.tag != name:
                up = up.parent
            if up.parent:
                node = up.parent
            continue
        attrs = m[3] if m[2] else m[6]
        if name in RAW:
            end = re.compile(rf"</{name}[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in ENDS_P:
            node = _close(node, {"p"}, {"td", "th", "table", "button", "object"})
        elif name in FAMILY:
            node = _close(node, *FAMILY[name])
        new = Node(name, attrs, node)
        node.children.append(new)
        if name not in VOID and not attrs.endswith("/"):
            node = new
    return root


def _close(node: Node, names: set[str], within: set[str]) -> Node:
    """Where the next element goes if it ends an open one of ``names`` before any of ``within``."""
    up, out = node, node
    while up.parent and up.tag not in within:
        if up.tag in names:
            out = up.parent
            if up.tag == "p":
                break
        up = up.parent
    return out


def page_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(c for c in reversed(n.children) if not isinstance(c, str))
    return out


def surrounding(node: Node, in_article: bool, holds: set[int]) -> bool:
    """Whether the element is a menu, header, footer, sidebar, notice, advert, form or the like.

    Inside an article, paragraphs stay whatever they are called (but for
    adverts), and words that articles use themselves count only for parts that
    are mostly links.
    """
    tag = node.tag
    if tag in DROP or tag == "header" and not in_article:
        return True
    if not node.attrs or tag in ("html", "body", "main") or id(node) in holds:
        return False
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(node.attrs)}
    if "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "").lower():
        return True
    names = {w.lower() for k in ("class", "id") for w in values.get(k, "").split()}
    if in_article and (tag in PARAGRAPH or tag == "figure"):
        return bool(names & ADVERT)
    links = node.linked >= LINKED * max(1, node.chars)
    if values.get("role", "").lower() in ROLES and (links or not in_article):
        return True
    parts = {p.lower() for k in ("class", "id") for p in PART.findall(values.get(k, ""))}
    if any(p.startswith(COMMENTS) for p in parts - NO_COMMENTS):
        return True
    found = parts & AROUND
    if in_article:
        return bool(found - WEAK - SOFT) or bool(found & SOFT) and (links or not node.prose) or bool(found) and links
    return bool(found) and not (found == {"header"} and parts & TITLES)


def blocks(root: Node) -> list[tuple[Node, str, int]]:
    """(owner, text, characters in links) of each block of text, in page order, without the surroundings."""
    holds: set[int] = set()
    order = page_order(root)
    for n in order:
        if n.tag in CONTENT:
            up = n.parent
            while up and id(up) not in holds:
                holds.add(id(up))
                up = up.parent
    for n in reversed(order):
        n.chars += sum(len(c.strip()) for c in n.children if isinstance(c, str))
        if n.tag == "a":
            n.linked = n.chars
        if n.tag == "p":
            n.prose = n.chars
        if n.parent:
            n.parent.chars += n.chars
            n.parent.linked += n.linked
            n.parent.prose += n.prose
    out: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    links = 0

    def flush(owner: Node) -> None:
        nonlocal links
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((owner, text, min(links, len(text))))
            parts.clear()
        links = 0

    # (node, its block, in a link, in an article, next child)
    stack: list[list] = [[root, root, False, False, 0]]
    while stack:
        top = stack[-1]
        node, owner, in_a, in_article, k = top
        if k == len(node.children):
            stack.pop()
            if node is owner:
                flush(owner)
            continue
        top[4] += 1
        child = node.children[k]
        if isinstance(child, str):
            parts.append(child)
            links += len(child.strip()) if in_a else 0
        elif child.tag in ("br", "hr", "wbr", "img"):
            if child.tag == "hr":
                flush(owner)
            elif child.tag == "br":
                parts.append(" ")
        elif not surrounding(child, in_article, holds):
            block = child.tag in BLOCK
            if block:
                flush(owner)
            stack.append([child, child if block else owner, in_a or child.tag == "a", in_article or child.tag in CONTENT, 0])
        elif child.tag in BLOCK or child.tag in RAW:
            flush(owner)
    return out


def main_text(html: str) -> str:
    """The blocks of the article, joined by line ends.

    A block passes points for its length and its commas to its ancestors, half
    as many to each level up; a container's points are discounted by its link
    density. The article around the best container is kept (an article or main
    element, if there is one), else the container with those siblings that are
    headings, paragraphs, or score a fifth of it. Articles beside the article are
    kept too. All blocks therein are kept, but for unmarked menus: lists of
    nothing but links, in an article those ahead of its first paragraph.
    Of equally good containers the first in the page is taken.
    """
    root = parse(html)
    found = blocks(root)
    scored: set[int] = set()
    for owner, text, links in found:
        owner.size += len(text)
        owner.links += links
        if owner.tag not in HEADING:
            to = owner.parent if owner.tag in PARAGRAPH and owner.parent else owner
            to.score += 1 + text.count(",") + min(len(text) / 100, 3)
            scored.add(id(to))
    order = page_order(root)
    for n in reversed(order):
        if n.parent:
            n.parent.size += n.size
            n.parent.links += n.links
            n.parent.score += n.score / 2
    if not found:
        return ""
    density = lambda n: n.links / max(1, n.size)
    worth = lambda n: n.score * (1 - density(n))
    inside = lambda n: {id(n)}
    best = max(order, key=worth)
    if worth(best) <= 0:
        best = found[0][0]
    up = best
    while up and up.tag not in CONTENT:
        up = up.parent
    if up is None and not scored:
        return "\n".join(t for _, t, _ in found)
    if up is not None:
        # Articles beside it are parts of the same text, unless they are mostly links.
        kept = inside(up) | {id(s) for s in (up.parent.children if up.parent else ()) if not isinstance(s, str) and s.tag == up.tag == "article" and s.size and density(s) < LINKED}
    else:
        kept, limit = inside(best), SIBLING * worth(best)
        for s in best.parent.children if best.parent else ():
            if not isinstance(s, str) and s.size and (s.tag in HEADING or worth(s) >= max(limit, 1e-9) or s.tag in PARAGRAPH and s.tag != "li" and density(s) < 0.25):
                kept.add(id(s))
    known: dict[int, bool] = {}

    def within(n: Node | None) -> bool:
        path = []
        while n is not None and id(n) not in known and id(n) not in kept:
            path.append(n)
            n = n.parent
        yes = n is not None and (id(n) in kept or known.get(id(n), False))
        for p in path:
            known[id(p)] = yes
        return yes

    def listed(n: Node) -> bool:
        """In an unmarked menu: a list that is nothing but links."""
        while n is not None and id(n) not in kept:
            if n.tag in ("ul", "ol") and n.links >= 0.9 * n.size:
                return True
            n = n.parent
        return False

    out, begun = [], False
    for n, t, _ in found:
        if within(n):
            links = n.tag in ("li", "ul", "ol") and listed(n)
            # In an article, a list of links is a menu only ahead of all text.
            if not links or up is not None and begun:
                out.append(t)
                begun = begun or not links and n.tag not in HEADING
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages``, from the whole html.

    Cases: null or empty html, and pages without text, give an empty text; cut
    off pages are read as far as they go; a page of any length and depth is read
    whole, in time that grows with its length; of equal containers the first is
    taken; repeated rows and null ids or urls stay; an empty table gives no
    rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h or "") for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
