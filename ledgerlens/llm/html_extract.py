"""Main text of web pages by tree scoring.

The page is read into a tree of containers. Every paragraph (a block of text)
passes points for its length and its commas to its ancestors, halved per level
and discounted by the ancestor's link density. The container with most points, or the
whole article that holds it, is kept; without an article also what stands beside it
and its ancestors, unless most of it is links. Menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and comments go first; what holds the
page's articles is none of these, whatever its name.

Defined results: a null or empty html gives an empty text; markup that never
closes is closed at the end; text outside any element counts as a paragraph;
equal scores go to the container that begins first; a very long page is read whole,
in time and memory that grow with its length; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.textops import map_texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "title")
DROPPED = frozenset("nav footer aside form button select option label dialog menu head object canvas audio video".split()) | set(RAW)
BLOCKS = frozenset("p div section article main body html li ul ol dl dt dd table tbody thead tfoot tr td th blockquote pre "
                   "h1 h2 h3 h4 h5 h6 header footer nav aside form figure figcaption address hr details summary fieldset center".split())
CONTAINERS = frozenset("div section article main body html td blockquote root center".split())
#: Words of class, id and role that mark what is not the article, as a whole token or with words of place beside them.
_NOISE = (r"(?:ads?|adv|advert[^\W_]*|banner[^\W_]*|sponsor[^\W_]*|promo[^\W_]*|nav[^\W_]*|menu[^\W_]*|header|masthead|footer|foot|side-?bar[^\W_]*|"
          r"aside|notice[^\W_]*|cookie[^\W_]*|consent|gdpr|popup|modal|overlay|alert|comments?|comment-?list|respond|reply|replies|disqus|"
          r"share|sharing|social|related|recommend[^\W_]*|subscribe|newsletter|signup|login|breadcrumbs?|pagination|pager|widget[^\W_]*|"
          r"toolbar|hidden|tags|contentinfo|complementary|navigation|search|dialog|disclaimer|teaser[^\W_]*)")
_PLACE = (r"(?:site|page|main|global|primary|secondary|top|bottom|left|right|inner|outer|container|wrap|wrapper|box|area|list|section|block|"
          r"bar|row|column|body|title|links?|buttons?|icons?|items?|posts?|form|[0-9]+)")
NOISE = re.compile(rf"(?<!\S)(?:{_PLACE}[_-]+)*{_NOISE}(?:[_-]+(?:{_PLACE}|{_NOISE}))*(?!\S)", re.I)
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?:;|$)", re.I)
#: Controls, whose text is no paragraph.
CONTROLS = frozenset("button select option label menu".split())
GOOD = re.compile(r"article|main|content|post|entry|story|body|text", re.I)

#: Attributes as the HTML standard reads them: a quote opens a value only after "="; elsewhere it is part of a name or value.
_ATTRS = r"""(?:[\s/]++|=?+[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+(?:"|$)|'[^']*+(?:'|$)|[^\s>"'][^\s>]*+)?+)?+|=)*+"""
_TAG = re.compile(rf"<(?:!--(?:-?>|.*?(?:--!?>|$))|!\[CDATA\[(.*?)(?:\]\]>|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)({_ATTRS})(?:>|$))", re.S)
_ATTR = re.compile(r"""(=?[^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>"'][^\s>]*))?)?""")
_SPACE = re.compile(r"\s+")
#: What an open element is closed by, as in the HTML standard.
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}


class Node:
    __slots__ = ("tag", "parent", "children", "order", "noise", "named", "score", "passed", "chars", "linked", "weight", "plain", "articles")

    def __init__(self, tag: str, parent: Node | None, order: int, noise: bool, weight: float):
        self.tag, self.parent, self.order, self.noise, self.weight = tag, parent, order, noise, weight
        self.children: list = []
        self.score = self.passed = self.chars = self.linked = 0.0
        self.plain = self.articles = 0
        self.named = False


def parse(html: str) -> Node:
    """The tree of elements; a child is a node, or a (text, inside link) pair with references decoded."""
    root = here = Node("root", None, 0, False, 0.0)
    at = order = links = suspects = 0
    n = len(html)
    opened: dict[str, int] = {}  # elements of a tag that are open

    def close(upto: Node) -> Node:
        """End the open elements down to ``upto``, itself included; what is open then."""
        nonlocal links
        node = here
        while True:
            links -= node.tag == "a"
            opened[node.tag] -= 1
            if node is upto:
                return node.parent
            node = node.parent

    def text(upto: int) -> None:
        if upto > at:
            here.children.append((entities.unescape(html[at:upto]), links > 0))

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            text(n)
            break
        m = _TAG.match(html, lt)
        if m is None:  # a bare "<"
            text(lt + 1)
            at = lt + 1
            continue
        text(lt)
        at = m.end()
        if m[1]:
            here.children.append((m[1], links > 0))
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:  # a closing tag; one that closes nothing is left out
            if opened.get(tag):
                node = here
                while node.tag != tag:
                    node = node.parent
                here = close(node)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if (tag in CLOSES_P and (opened.get("p") or opened.get("a"))) or (tag == "a" and opened.get("a")):
            node, stop = here, BLOCKS if tag != "a" else BLOCKS - {"p"}
            while node is not root and node.tag not in stop and node.tag != "a":
                node = node.parent
            if (tag != "a" and node.tag == "p") or node.tag == "a" == tag:
                here = close(node)
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}[tag]
            while here.tag in same:
                here = close(here)
        order += 1
        attrs = {k.lower(): a or b or c for k, a, b, c in reversed(_ATTR.findall(m[4]))} if m[4] else {}  # the first of a name counts
        label = f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}"
        marked = bool(label.strip() and NOISE.search(label))
        noise = (tag in DROPPED or bool(_UNSEEN.search(attrs.get("style", ""))) or attrs.get("aria-hidden") == "true"
                 or (marked and tag not in ("body", "html", "article", "main")))
        weight = 25.0 * (tag in ("article", "main")) + 10.0 * bool(label.strip() and GOOD.search(label))
        if tag == "header" and here.tag not in ("article", "main"):
            noise = True
        node = Node(tag, here, order, noise, weight)
        node.articles = int(tag in ("article", "main") and not marked)
        node.named = marked or tag in DROPPED and tag != "form"
        suspects += noise
        here.children.append(node)
        if tag not in VOID and not m[4].rstrip().endswith("/"):
            here = node
            links += tag == "a"
            opened[tag] = opened.get(tag, 0) + 1
    if suspects:
        release(root)
    return root


def release(root: Node) -> None:
    """Take the mark of noise from what holds the page's article.

    That is every article and main element of the page. Without any, a form or a box that is
    only unseen is freed if it holds the larger part of the page's unlinked paragraph text; what is
    named as comments, adverts, a menu or a footer is not, however long it is. Comments and
    teasers marked as such do not count as articles.
    """
    order, stack = [], [(root, False)]
    while stack:
        node, control = stack.pop()
        order.append(node)
        control = control or node.tag in CONTROLS
        for child in node.children:
            if isinstance(child, Node):
                stack.append((child, control))
            elif not child[1] and not control:
                node.plain += len(child[0].strip())
    for node in reversed(order):  # children before their parents
        if node.parent is not None:
            node.parent.plain += node.plain
            node.parent.articles += node.articles
    for node in order:
        if node.noise and node.articles == root.articles and (node.articles or not node.named and 2 * node.plain > root.plain):
            node.noise = False


def blocks(node: Node) -> list[tuple[Node, str, int]]:
    """(block element, text, linked characters) of the kept blocks below ``node``, in page order."""
    out: list[tuple[Node, str, int]] = []
    parts: list[tuple[str, bool]] = []

    def flush(owner: Node) -> None:
        text = _SPACE.sub(" ", "".join(t for t, _ in parts)).strip()
        if text:
            out.append((owner, text, sum(len(t) for t, link in parts if link)))
        parts.clear()

    # An explicit stack, so deeply nested pages do not exhaust Python's.
    stack: list[tuple[Node, int, Node]] = [(node, 0, node)]
    while stack:
        here, k, owner = stack.pop()
        if k == len(here.children):
            if here.tag in BLOCKS or here is node:
                flush(owner)
            continue
        stack.append((here, k + 1, owner))
        child = here.children[k]
        if isinstance(child, tuple):
            parts.append(child)
        elif child.noise:
            if child.tag in BLOCKS:
                flush(owner)
        elif child.tag in BLOCKS:
            flush(owner)
            stack.append((child, 0, child))
        elif child.tag in VOID:
            parts.append((" ", False))
        else:
            stack.append((child, 0, owner))
    return out


def score(root: Node, found: list[tuple[Node, str, int]]) -> list[Node]:
    """Pass the blocks' points up, each node after its children; the elements in page order."""
    for owner, text, linked in found:
        owner.passed += 1.0 + text.count(",") + text.count("，") + min(len(text) / 100.0, 3.0) + len(text) / 1000.0
        owner.chars += len(text)
        owner.linked += linked
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.noise)
    for node in reversed(order):
        share = 1.0
        if node.tag in CONTAINERS and node.chars:
            node.score = (node.passed + node.weight) * (1.0 - node.linked / node.chars)
            share = 0.5
        if node.parent is not None:
            node.parent.passed += share * node.passed
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    return order


def _unlinked(node: Node) -> bool:
    return node.chars > 0 and 2 * node.linked < node.chars


def extract(html: str | None) -> str:
    """The main text: blocks joined by one line feed, white space inside a block as one space."""
    if not html:
        return ""
    root = parse(html)
    found = blocks(root)
    if not found:
        return ""
    order = score(root, found)
    best = min((x for x in order if x.tag in CONTAINERS and x.chars), key=lambda x: (-x.score, x.order))
    node = best  # an article that holds the best container is the whole article
    while node is not None and node.tag != "article":
        node = node.parent
    if node is None:
        node = best
        while node is not None and node.tag != "main":
            node = node.parent
    kept = {id(best if node is None else node)}
    if node is None:  # no article: what stands beside the best container, on every level, unless it is mostly links
        path = best
        while path.parent is not None:
            kept.update(id(c) for c in path.parent.children if isinstance(c, Node) and c is not path and not c.noise and _unlinked(c))
            path = path.parent
            kept.add(-id(path))  # its own text
    inside = {id(root): id(root) in kept}
    for x in order[1:]:
        inside[id(x)] = id(x) in kept or inside[id(x.parent)]
    return "\n".join(text for owner, text, _ in found if inside[id(owner)] or -id(owner) in kept)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) per page; a page is read whole in its task, nothing is shuffled."""

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_texts(rows, ["page_id", "url"], "html", lambda page: (extract(page),), "text string")
