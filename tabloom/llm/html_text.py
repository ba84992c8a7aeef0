"""Main text of web pages by tree scoring.

Text blocks give points for length and commas to the elements around them, fewer the farther up; an
element's points are cut by the share of its text that is inside links. The best container and those
of its siblings that look alike are kept; what is boilerplate by tag, role or class is pruned first.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, with_fields

#: Tags by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas".split())
DROP = frozenset("script style noscript template textarea title iframe svg math object canvas head nav header footer aside button select option menu dialog label input".split())
#: Boilerplate unless they hold an article or most of the page, which some pages wrap in a form.
FORMS = frozenset(["form", "fieldset"])
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
#: A new block of these kinds closes an open paragraph; list and table parts close their like.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
#: Words of class and id names that mark what is not the article: these wherever they stand between - and _ in a name,
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertisements sponsor sponsored promo promos promotion promotions banner banners cookie cookies gdpr sidebar sidebars menu menus nav navbar "
    "navigation navigations breadcrumb breadcrumbs footer footers masthead comment comments commentlist disqus respond share sharing social related recommended subscribe subscription newsletter "
    "popup popups modal overlay toolbar widget widgets signup signin pagination pager toc copyright tagcloud byline".split()
)
#: these only if the rest of the name says nothing else,
WEAK = frozenset(
    "consent notice notices alert alerts side header headers replies discussion recommend recommendation recommendations login search skip legal disclaimer tag tags metadata".split()
)
#: and these are the words that say nothing else.
PLAIN = frozenset("site page top main global wrapper container bar box block section area list item items link links wrap inner outer left right bottom panel column col widget group message msg text".split())
#: Names that tell what is beside an element, or what it is about: has-sidebar, no-comments, tag-politics.
NEUTRAL = re.compile(r"(?<!\S)(?:has|no|with|without|tags?|category|topic)[_-]\S+|(?<!\S)\S+[_-](?:has|no|with|without)[_-]\S+", re.I)
PARTS = re.compile(r"[_-]+")
GOOD = re.compile(r"(?:^|[\s_-])(?:article|articles|content|main|post|entry|story|body|text|page)(?=$|[\s_-])", re.I)
#: Names of an article itself.
OWN = re.compile(r"(?<!\S)(?:article|post|entry|story)(?:[_-](?:body|content|text))?(?!\S)", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|itemprop|style)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"\s+")
SENTENCE = re.compile(r"[.!?…](?:\s|$)")
#: Elements that may stand in one another; what is deeper is read as if it stood here, so that the work stays linear in the page.
DEPTH = 256


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "points", "size", "linked", "pruned")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []
        self.points, self.size, self.linked, self.pruned = 0.0, 0, 0, False


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the tag that begins before `at` ends (after its >), quoted values apart; 0 if it has no end.

    `last` holds the last place of > and of the quotes in the page, so that no search runs to the end in vain.
    """
    while at <= last[">"]:
        m = _EDGE.search(page, at)
        if m is None:
            return 0
        if m[0] == ">":
            return m.end()
        before = m.start() - 1
        while page[before].isspace():
            before -= 1
        if page[before] != "=":  # an apostrophe in a name or a bare value
            at = m.end()
        elif m.start() == last[m[0]]:  # a quote that nothing closes
            return page.find(">", m.end()) + 1
        else:
            at = page.find(m[0], m.end()) + 1
    return 0


_EDGE = re.compile(r"[>\"']")


def parse(page: str) -> Node:
    """A tree of elements and strings; tolerates missing and surplus end tags. The work is linear in the page's length.

    A < that begins no tag is text; a tag that never ends takes the rest of the page with it.
    """
    root = Node("#root", "", None)
    here, at, n, depth = root, 0, len(page), 0
    last = {c: page.rfind(c) for c in ">\"'"}
    opened: Counter = Counter()  # open elements by tag
    raw_end: dict[str, bool] = {}  # whether an end tag of this kind is still ahead

    def close(to: Node) -> None:
        """Closes the open elements up to `to`, and it too."""
        nonlocal here, depth
        while True:
            opened[here.tag] -= 1
            depth -= 1
            here, done = here.parent, here is to
            if done:
                return

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            here.kids.append(page[at:])
            break
        nxt = page[lt + 1 : lt + 2]
        slash = nxt == "/"
        if not (nxt in "!?" and nxt or (letter := page[lt + 2 : lt + 3] if slash else nxt).isascii() and letter.isalpha()):
            here.kids.append(page[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            here.kids.append(page[at:lt])
        if nxt in "!?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = end + 3 if end >= 0 else n
            elif page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                at = end + 3 if end >= 0 else n
            else:
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else n
            continue
        end = _tag_end(page, lt + 2, last)
        if not end:
            break
        mark, at = page[lt:end], end
        name = NAME.match(mark)[1].lower()
        if slash:
            if opened[name] > 0:
                x = here
                while x.tag != name:
                    x = x.parent
                close(x)
            elif name == "p":
                here.kids.append(Node("p", "", here))
            continue
        if name in BLOCK and name != "hr" and opened["p"] > 0:
            x = here  # an open paragraph ends where a block begins, whatever inline tags are open in it
            while x is not root and x.tag not in BLOCK:
                x = x.parent
            if x.tag == "p":
                close(x)
        if name in CLOSES and (left := sum(opened[t] for t in CLOSES[name])) > 0:
            x, top = here, None
            while left and x is not root and x.tag not in FENCE[name]:
                if x.tag in CLOSES[name]:
                    top, left = x, left - 1
                x = x.parent
            if top is not None:
                close(top)
        node = Node(name, mark, here)
        here.kids.append(node)
        if name in VOID or mark.endswith("/>") and name not in BLOCK and name not in RAW:
            continue
        if name in RAW:
            end = _raw_end(name).search(page, at) if raw_end.get(name, True) else None
            raw_end[name] = end is not None
            if end:
                at = end.end()
            elif name in ("script", "style"):
                at = n
            continue
        if depth < DEPTH:
            here = node
            depth += 1
            opened[name] += 1
    return root


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?![\w-])[^>]*>?", re.I)


def _boiler(node: Node, inside: bool) -> bool:
    """Whether the tag, a role or hiding makes an element boilerplate; `inside` an article a header belongs to it."""
    if node.tag in DROP:
        return not (node.tag == "header" and (inside or node.parent is not None and node.parent.tag in ("article", "main", "section")))
    if len(node.attrs) <= len(node.tag) + 2 or node.tag in ("body", "html", "article", "main"):
        return False
    for m in ATTR.finditer(node.attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _named_boiler(node: Node, inside: bool) -> bool:
    """Whether its tag (a form) or its class or id names an element as boilerplate; weak words don't `inside` an article or beside a good one, and a heading's id says nothing."""
    if node.tag in FORMS:
        return True
    if len(node.attrs) <= len(node.tag) + 2 or node.tag in ("body", "html", "article", "main"):
        return False
    for m in ATTR.finditer(node.attrs):
        key = m[1].lower()
        if key == "class" or key == "id" and node.tag not in HEADINGS:
            names = NEUTRAL.sub(" ", (m[2] or m[3] or m[4] or "").lower()).split()
            parts = [PARTS.split(x) for x in names]
            if any(p in STRONG for x in parts for p in x):
                return True
            weak = not inside and not any(GOOD.search(x) for x, y in zip(names, parts, strict=True) if not any(p in WEAK for p in y))
            if weak and any(any(p in WEAK for p in x) and all(p in WEAK or p in PLAIN for p in x) for x in parts):
                return True
    return False


def _text_sizes(order: list[Node]) -> dict[int, tuple[int, int, bool]]:
    """(characters, those in links, whether it is or holds an article or main) of each node; `order` has parents first."""
    out: dict[int, tuple[int, int, bool]] = {}
    for x in reversed(order):
        size = linked = 0
        holds = x.tag in ("article", "main")
        for k in x.kids:
            if isinstance(k, str):
                size += len(k.strip())
            elif not k.pruned:
                n, links, inner = out[id(k)]
                size, linked, holds = size + n, linked + links, holds or inner
        out[id(x)] = size, size if x.tag == "a" else linked, holds
    return out


def clean(text: str) -> str:
    """Character references decoded, white space to single blanks, trimmed."""
    return SPACE.sub(" ", html.unescape(text) if "&" in text else text).strip()


def _measure(root: Node) -> list[Node]:
    """Marks what is pruned and measures text; returns the containers that got points."""
    scored: list[Node] = []
    order, named, stack = [], [], [(root, False)]
    while stack:
        x, inside = stack.pop()
        order.append(x)
        inside = inside or x.tag in ("article", "main") or bool(x.attrs and OWN.search(_names(x)))
        for k in x.kids:
            if isinstance(k, Node):
                k.pruned = _boiler(k, inside)
                if not k.pruned:
                    stack.append((k, inside))
                    if _named_boiler(k, inside):
                        named.append(k)
    if named:
        # a name alone doesn't cut what holds an article or most of the text, unless that is links
        sizes = _text_sizes(order)
        total = sizes[id(root)][0]
        for k in named:
            size, linked, holds = sizes[id(k)]
            k.pruned = not holds and (2 * size < total or 2 * linked > size)
        order, stack = [], [root]
        while stack:
            x = stack.pop()
            order.append(x)
            stack += [k for k in x.kids if isinstance(k, Node) and not k.pruned]
    direct = {}
    for x in reversed(order):  # children come before their parents
        own = flow = 0
        commas = 0
        for k in x.kids:
            if isinstance(k, str):
                t = len(k.strip())
                own += t
                commas += k.count(",")
            elif not k.pruned:
                x.size += k.size
                x.linked += k.linked
                if k.tag not in BLOCK:
                    flow += direct[id(k)][0]
                    commas += direct[id(k)][1]
        x.size += own
        if x.tag == "a":
            x.linked = x.size
        direct[id(x)] = (own + flow, commas)
        if (x.tag in BLOCK or x is root) and own + flow > 0:
            points = 1 + commas + min((own + flow) / 100, 3)
            up, level = (x if x.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "li", "td", "blockquote", "dd", "dt", "figcaption") else x.parent), 0
            while up is not None and level < 5:
                if not up.points:
                    scored.append(up)
                    up.points += 25 if up.tag in ("article", "main") else 5 if GOOD.search(" ".join(m[2] or m[3] or "" for m in ATTR.finditer(up.attrs))) else 0
                up.points += points / (1, 2, 6, 9, 12)[level]
                up, level = up.parent, level + 1
    return scored


def _blocks(node: Node, out: list[str]) -> None:
    """The text blocks below a node, in page order."""
    line: list[str] = []

    def flush():
        if line and (t := clean("".join(line))):
            out.append(t)
        line.clear()

    stack = [iter(node.kids)]
    opened = [node]
    while stack:
        k = next(stack[-1], None)
        if k is None:
            stack.pop()
            if opened.pop().tag in BLOCK:
                flush()
        elif isinstance(k, str):
            line.append(k)
        elif k.tag in ("br", "wbr"):
            line.append(" " if k.tag == "br" else "")
        elif not k.pruned:
            if k.tag in BLOCK:
                flush()
            opened.append(k)
            stack.append(iter(k.kids))
    flush()


def _text(node: Node) -> str:
    out: list[str] = []
    _blocks(node, out)
    return " ".join(out)


def _names(node: Node) -> str:
    return " ".join(m[2] or m[3] or m[4] or "" for m in ATTR.finditer(node.attrs) if m[1].lower() in ("class", "id"))


def _prune_links(wrapper: Node, path: set[int]) -> None:
    """Prunes the link-dense blocks in a wrapper, but for headings and what is on the path."""
    stack = [wrapper]
    while stack:
        for k in stack.pop().kids:
            if isinstance(k, Node) and not k.pruned and k.tag in BLOCK:
                if id(k) not in path and k.linked > 0.5 * k.size and k.tag not in HEADINGS:
                    k.pruned = True
                else:
                    stack.append(k)


def main_text(page: str | None) -> str:
    """The article's blocks joined by blank lines; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    scored = _measure(root)
    if not scored:
        return ""

    def worth(x: Node) -> float:
        return x.points * (1 - x.linked / max(1, x.size))

    best = max(scored, key=worth)
    inside, path = best, []
    while inside is not None and inside.tag not in ("#root", "html", "body"):
        path.append(inside)
        inside = inside.parent
    # an article is kept whole however long its parts are; else main, what is named like an article, or the element around
    named = [x for x in path if GOOD.search(_names(x))]
    wrapper = next((x for t in ("article", "main") for x in path if x.tag == t), named[-1] if named else path[min(1, len(path) - 1)] if path else best)
    if wrapper.tag not in ("article", "main"):
        _prune_links(wrapper, set(map(id, path)))
    best = wrapper
    # what a better container leaves out may be in the element around it
    while best.parent is not None and best.parent.tag not in ("#root", "html", "body") and best.tag not in ("article", "main") and worth(best.parent) >= 0.75 * worth(best):
        best = best.parent
    out: list[str] = []
    line = max(10.0, 0.2 * worth(best))
    around = best.parent.kids if best.parent is not None else [best]
    for k in around:
        if k is best:
            _blocks(k, out)
        elif isinstance(k, Node) and not k.pruned and best.tag not in ("body", "main"):
            dense = k.linked / max(1, k.size)
            alike = k.points and worth(k) >= line or k.tag == best.tag and best.tag == "article"
            if alike or k.tag == "p" and (dense < 0.25 and k.size > 80 or not k.linked and SENTENCE.search(_text(k))):
                _blocks(k, out)
    return "\n\n".join(out)


def extract_text(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """`pages` without html, with text and n_chars (code points).

    Every row gets a result: null, empty or textless html gives "" and 0. Broken markup is read as far as it
    goes (missing end tags are implied, surplus ones ignored). Repeated rows and null ids or urls pass through. Columns named text or n_chars are replaced.
    """
    bounded_batches(spark)
    plain = pages.drop("text", "n_chars").withColumn("html", F.col("html").cast("string"))
    at = plain.columns.index("html")
    names = [c for c in plain.columns if c != "html"]

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(at).to_pylist()]
            cols = [b.column(j) for j in range(b.num_columns) if j != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return plain.mapInArrow(run, with_fields(plain.drop("html").schema, "text string, n_chars long"))
