"""Main-text extraction from web pages by composite text density.

A tolerant tokenizer builds a DOM; elements that are no text of the page by their tag, role or
style go first (scripts, forms, menus, asides, page headers and footers).  Every remaining node
gets its composite text density: characters per tag, scaled down the more of its characters are
link text, with the page's own link share as the balance.  A node's density sum adds up the
densities of its children but for named blocks (below), runs of text counting as children of one tag.  The subtree
with the greatest sum holds the article, and the least density on its path to the body is the
threshold that other subtrees have to reach to count as content beside it.

Names are evidence, not a verdict: a block whose class or id names an advert, a notice, a sidebar,
comments or the like is no candidate for the article unless the densities outside such blocks fall
far short of those inside (then the name was a wrong one; comments never are the article).  Inside
the article, blocks of a clear name go, those of a doubtful one only below the threshold.  An
``article`` element around the densest subtree is taken whole, as are headings right before what
is chosen.

The logarithm's base is e at least: at shares of links near 0 the published formula divides by a
logarithm near 0.

Defined edge cases: null or empty html gives the empty text; a page whose text is all
boilerplate gives the empty text; broken markup is repaired as browsers do for the common
cases (unclosed p, li and the like, stray end tags); repeated pages give repeated rows.
"""

from __future__ import annotations

import html as _html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare

# Element classes of the public HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg textarea title noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul xmp".split()
)
#: Elements that another start tag of the list closes while they are open.
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot li dd dt html body legend summary figcaption".split())
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = frozenset("table ul ol dl div section article main body html nav aside header footer select blockquote".split())
#: Boilerplate by tag and role.
DROP_TAGS = frozenset("head nav footer aside form button select input label menu dialog video audio canvas map".split()) | RAW
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar tablist".split())
#: Words of a class or id: of reader comments, clear names of other boilerplate, doubtful names.
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
CLEAR_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs cookie cookies consent gdpr menu nav navbar navigation "
    "newsletter outbrain pager pagination popup promo promotion promoted sharing sharedaddy sidebar sidebars signup sponsor sponsored sponsors subscribe subscription taboola toolbar paywall".split()
)
DOUBTFUL_WORDS = frozenset(
    "alert byline copyright disclaimer discussion feedback footer header legal login masthead modal notice notices notification overlay rail recommend recommended recommendations "
    "related reply search share skip social tags topbar widget widgets".split()
)
#: Words before a name that say the block is another one, as in has-sidebar.
NEGATIONS = frozenset("has have no not with without is hide".split())
#: A named block holds the article if the greatest density sum outside such blocks is below this share of its own.
FAR = 0.1
COMMENTS, CLEAR, DOUBTFUL = 3, 2, 1
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "drop", "name", "chars", "tags", "link_chars", "link_tags", "density", "density_sum")

    def __init__(self, tag: str, attrs: str, parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.drop, self.name = False, 0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)}


def _pruned(node: Node) -> bool:
    """Whether the element is no text of the page by its tag, role or style."""
    tag = node.tag
    if tag in DROP_TAGS:
        return True
    if tag == "header":  # of an article: its headings stay, see _blocks
        up = node.parent
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        return up is None
    if not node.attrs.strip():
        return False
    a = _attributes(node.attrs)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "").lower()):
        return True
    return a.get("role", "").lower() in DROP_ROLES


def _named(node: Node) -> int:
    """What the class and id say: COMMENTS, CLEAR or DOUBTFUL boilerplate, or 0."""
    if not node.attrs.strip() or node.tag in ("html", "body", "main", "article", "a"):
        return 0
    a = _attributes(node.attrs)
    found = 0
    for name in f"{a.get('class', '')} {a.get('id', '')}".split():
        words = _WORD.findall(_CAMEL.sub(" ", name).lower())
        if NEGATIONS & set(words[:1]):
            continue
        for w in words:
            found = max(found, COMMENTS if w in COMMENT_WORDS else CLEAR if w in CLEAR_WORDS else DOUBTFUL if w in DOUBTFUL_WORDS else 0)
    return found


def dom(page: str) -> Node:
    """The page as a tree; raw-text elements keep no content."""
    root = Node("html", "", None)
    node, at, n = root, 0, len(page)
    while at < n:
        m, lt = None, page.find("<", at)
        while lt >= 0 and (m := _TOKEN.match(page, lt)) is None:  # a bare "<" is text
            lt = page.find("<", lt + 1)
        if m is None:
            node.children.append(page[at:])
            break
        if lt > at:
            node.children.append(page[at:lt])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                node.children.append(_html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, attrs = name.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            up = node
            while up is not root and up.tag != tag:
                if up.tag in SCOPE and tag not in SCOPE and tag not in BLOCK:
                    break
                up = up.parent
            if up is not root and up.tag == tag:
                node = up.parent
            elif tag == "p":
                node.children.append(Node("p", "", node))
            continue
        if tag in ("html", "body") and node is root:
            if tag == "body":
                node = Node(tag, attrs, root)
                root.children.append(node)
            continue
        if tag in CLOSES_P or tag == "p":
            up = node
            while up is not root and up.tag != "p" and up.tag not in SCOPE:
                up = up.parent
            if up.tag == "p":
                node = up.parent
        if tag in IMPLIED:
            up = node
            while up is not root and up.tag not in SCOPE:
                if up.tag in IMPLIED[tag]:
                    node = up.parent
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
                up = up.parent
        if tag == "body":
            while node is not root:
                node = node.parent
        child = Node(tag, attrs, node)
        node.children.append(child)
        if tag == "xmp":  # plain text up to its end tag
            end = page.lower().find("</xmp", at)
            child.children.append(_html.escape(page[at : end if end >= 0 else n]))
            at = n if end < 0 or (close := page.find(">", end)) < 0 else close + 1
            continue
        if tag in VOID or attrs.rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            if end is None:
                at = n
            else:
                close = page.find(">", end.end())
                at = n if close < 0 else close + 1
            continue
        node = child
    return root


def _measure(root: Node) -> list[Node]:
    """Drop what is no text and count characters and tags, children before parents."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if _pruned(node):
            node.drop = True
            continue
        node.name = _named(node)
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        chars = tags = link_chars = link_tags = 0
        for c in node.children:
            if isinstance(c, str):
                chars += len(c) - c.count(" ") if not c.isspace() else 0
            elif not c.drop:
                chars, tags = chars + c.chars, tags + c.tags + 1
                link_chars, link_tags = link_chars + c.link_chars, link_tags + c.link_tags
        if node.tag == "a":
            link_chars, link_tags = chars, link_tags + 1
        node.chars, node.tags, node.link_chars, node.link_tags = chars, tags, link_chars, link_tags
    return order


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters a tag times log(C/LC * T/LT) to the base ln(C/(C - LC) * LC + share * C + e),
    with share the page's link characters over all, counts of 0 as 1 and a base of e at least."""
    if not chars:
        return 0.0
    t, lc, lt, plain = max(tags, 1), max(link_chars, 1), max(link_tags, 1), max(chars - link_chars, 1)
    base = max(math.log(chars / plain * link_chars + share * chars + math.e), math.e)
    return chars / t * max(math.log(chars / lc * t / lt), 0.0) / math.log(base)


def _densities(order: list[Node], body: Node) -> None:
    share = body.link_chars / max(body.chars, 1)
    for node in order:
        node.density = composite_density(node.chars, node.tags, node.link_chars, node.link_tags, share)
    for node in order:
        total, in_link = 0.0, node.tag == "a"
        for c in node.children:
            if isinstance(c, str):
                if not c.isspace():
                    n = len(c) - c.count(" ")
                    total += composite_density(n, 1, n * in_link, int(in_link), share)
            elif not c.drop and not c.name:
                total += c.density
        node.density_sum = total


#: Elements that are parts of an article, never the whole: what holds them is stepped up to.
PARTS = HEADINGS | frozenset("p li td th tr tbody thead tfoot blockquote pre dd dt ul ol dl figure figcaption caption".split())


def _best(body: Node) -> Node:
    """The node of the greatest density sum outside named blocks; if a node inside them outweighs
    it by far, comments apart, that one, and the blocks that hold it lose their names."""
    free, inside, stack = body, body, [(body, 0)]
    while stack:
        node, name = stack.pop()
        name = max(name, node.name)
        if not name and node.density_sum > 0 and node.density_sum >= free.density_sum:  # of equals the inner one
            free = node
        if name and name < COMMENTS and (inside is body or node.density_sum > inside.density_sum):
            inside = node
        if name < COMMENTS:
            stack += [(c, name) for c in reversed(node.children) if isinstance(c, Node) and not c.drop]
    if inside is not body and free.density_sum < FAR * inside.density_sum:
        up = inside
        while up is not body:
            up.name, up = 0, up.parent
        return inside
    return free


def _main(root: Node) -> tuple[list, float]:
    """The content subtrees in page order, and the threshold."""
    order = _measure(root)
    body = next((n for n in order if n.tag == "body"), root)
    if root.drop or not order or not body.chars and not root.chars:
        return [], 0.0
    if not body.chars:
        body = root
    _densities(order, body)
    best = _best(body)
    threshold, up, holder, path = math.inf, best, None, {id(body)}
    while True:
        path.add(id(up))
        threshold = min(threshold, up.density)
        if up.tag in ("article", "main") or "articleBody" in up.attrs:
            holder = up
        if up is body:
            break
        up = up.parent
    holder = holder or best
    while holder is not body and (holder.tag not in BLOCK or holder.tag in PARTS):
        holder = holder.parent
    if holder is body:
        return _of_body(body, threshold), threshold
    chosen: list = []
    stack = [body]
    while stack:
        node = stack.pop()
        if node is holder:
            chosen.append(node)
        elif id(node) in path:
            stack += [c for c in reversed(node.children) if isinstance(c, Node) and not c.drop]
        elif _dense(node, threshold) or node.tag in HEADINGS and not node.name and _leads(node, holder, threshold):
            chosen.append(node)
    return chosen, threshold


def _dense(node: Node, threshold: float) -> bool:
    return node.density > 0 and node.tag in BLOCK and not node.name and node.density >= threshold and node.link_chars * 2 < node.chars


def _leads(heading: Node, holder: Node, threshold: float) -> bool:
    """Whether the next element after a heading, other headings apart, is content."""
    kids = [c for c in heading.parent.children if isinstance(c, Node) and not c.drop]
    after = [c for c in kids[kids.index(heading) + 1 :] if c.tag not in HEADINGS and c.chars][:1]
    return any(c is holder or _dense(c, threshold) for c in after)


def _of_body(body: Node, threshold: float) -> list:
    """An article spread right under the body: its text, paragraphs and the like as they are, and
    containers that reach the threshold."""
    out: list = []
    for c in body.children:
        if isinstance(c, str):
            if not c.isspace():
                out.append(c)
        elif not c.drop and not c.name and c.chars:
            linked = c.link_chars * 2 >= c.chars
            if c.tag not in BLOCK or (c.tag in PARTS and not linked) or _dense(c, threshold):
                out.append(c)
    return out


def _blocks(nodes: list, threshold: float) -> list[str]:
    """The text of each block of the chosen nodes; explicit stack, as trees may be deep.

    Blocks of a clear name go; those of a doubtful one, below the threshold.
    """
    out: list[str] = []
    buf: list[str] = []

    def flush() -> None:
        text = " ".join(_html.unescape("".join(buf)).split())
        if text:
            out.append(text)
        buf.clear()

    stack: list = [(n, None) for n in reversed(nodes)]
    while stack:
        item, end = stack.pop()
        if end:
            flush()
        elif isinstance(item, str):
            buf.append(item)
        elif not item.drop:
            if item.name >= CLEAR or item.name == DOUBTFUL and item.density < threshold:
                continue
            if item.tag == "br":
                buf.append(" ")
                continue
            if item.tag in BLOCK:
                flush()
                stack.append((item, True))
            kids = item.children
            if item.tag == "header":
                kids = [c for c in kids if isinstance(c, Node) and c.tag in HEADINGS | {"div"}]
            stack += [(c, None) for c in reversed(kids)]
    flush()
    return out


def extract(page: str | None) -> str:
    """The main text of a page: its blocks, joined by blank lines."""
    if not page:
        return ""
    nodes, threshold = _main(dom(page))
    return "\n\n".join(_blocks(nodes, threshold))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.  Narrow: no shuffle."""
    prepare(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [extract(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    chosen = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
