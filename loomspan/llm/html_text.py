"""Main text of web pages by composite text density.

The page becomes a tree. Every node's density is its characters per tag, adjusted by its links: many linked
characters for its unlinked ones lower it (composite text density). A node's density sum adds its wanted children's
densities (inline elements count as tags, they are no candidates); the subtree of the largest sum is the article, or the
outermost article or main element around it, whole. The smallest density on the path from the largest sum to the body is
the threshold that other parts of the body must reach to be kept, each whole, beside an article or main element; other
such elements stay. On a page without them every part beside the path stays (headlines, further sections), unless it is
below the threshold and most of its characters are links.

Elements that are never article text (scripts, styles, menus, headers and footers outside an article, forms, asides)
and those whose class, id or role says menu, advert, notice, comments and the like count for densities and then go. Names are
evidence, text decides: a form, or an element that a name speaks against, stays where the page would keep less than a fifth of
that element's unlinked characters without it (a page inside one form; an article of the class "modal-verbs").
Blocks keep their order and are joined by two line feeds; white space inside a block becomes one space. Defined
cases: null or blank html gives empty text; unclosed and stray tags, and text without any tag, are read as browsers do;
repeated rows are rows of their own; pages of any length are read whole.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import chunks, free_name, ship

# Element names and marks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")
DROPPED = frozenset("script style noscript template svg canvas iframe object embed form nav footer aside menu dialog button select input textarea label fieldset head title audio video map xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = frozenset("ul ol dl table".split())
TABLE = frozenset("tr td th thead tbody tfoot".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("title meta link base basefont bgsound script style noscript noframes template".split())
PLACES = frozenset("site page main top bottom left right primary secondary global header footer post user reader article blog story cookie google social side email".split())
# Words of a class or id that say what a box is. The first mark it with any words after them; the second only with
# words of the two lists, of PLACES or of BOX, so that "ad-banner" is an advert and "ad-hoc-networks" is not.
MARKS = frozenset("adsense advert adverts advertisement advertising breadcrumb breadcrumbs cookie cookies disqus footer gdpr masthead modal nav navbar navigation newsletter pagination popup sidebar sponsored".split())
WEAK_MARKS = frozenset("ad ads alert banner comment comments consent copyright login menu notice notices pager promo promos promotion promotions recommended related replies respond share sharing signup skip social sponsor subscribe subscription".split())
BOX = frozenset("area bar block body box btn button buttons code col column container content count cta data details div form frame group heading icons image inner item items label layout link links list media meta module msg message new nav news outer overlay panel post posts region row rows section slot small social stories story strip text thread title to top unit widget widgets wrap wrapper zone".split())
# Names that common themes and plug-ins write as one word; they mark a box wherever they stand in a class or id.
GLUED = frozenset("adsbygoogle commentlist cookiebar leftcol mainmenu mainnav relatedposts rightcol sharedaddy sitefooter sitenav topnav".split())
LAST = frozenset("ad ads advert comments".split())  # mark a box after words of PLACES and BOX
# Marks that hold against any amount of text.
FIRM = frozenset("comment commentlist comments consent cookie cookies cookiebar disqus gdpr replies respond".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_OPENED = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*)|/(?=[^a-zA-Z]))")
_ATTRIBUTE = re.compile(r"[\s/]*+(=?[^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[-_]+|(?<=[a-z])(?=\d)")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW}


class Node:
    """An element. Kept at hand, so that no start or end tag has to walk up the tree: the nearest open block or button, the
    nearest element that bounds a list item, the outermost open row, cell and section of the nearest table or list."""

    __slots__ = ("block", "bound", "chars", "children", "density", "depth", "framed", "link_chars", "link_tags", "name", "parent", "soft", "table", "tags", "total", "unwanted", "upper")

    def __init__(self, name: str, parent: Node | None):
        self.name, self.parent, self.children = name, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.block, self.unwanted, self.soft = name in BLOCKS, False, False
        self.depth = parent.depth + 1 if parent else 0
        self.framed = name in ("article", "main") or parent is not None and parent.framed
        self.upper = self if parent is None or self.block or name == "button" else parent.upper
        self.bound = self if parent is None or self.block and name not in ("address", "div", "p") or name in SCOPES or name == "option" else parent.bound
        if parent is None or name in SCOPES:
            self.table: dict[str, Node] = {}
        elif name in TABLE and name not in parent.table:
            self.table = {**parent.table, name: self}
        else:
            self.table = parent.table


def marked(value: str) -> bool:
    """Whether a class or id names a menu, advert, notice, comments or the like."""
    for token in value.lower().split():
        parts = [x for x in _PART.split(token) if x]
        while len(parts) > 1 and parts[0] in PLACES and (parts[1] in MARKS or parts[1] in WEAK_MARKS or parts[1] in PLACES):
            del parts[0]
        if not parts:
            continue
        if any(x in GLUED for x in parts) or len(parts) > 1 and parts[-1] in LAST and all(x in PLACES or x in BOX for x in parts[:-1]):
            return True
        if parts[0] in MARKS or token == "side-bar" or parts[0] == "header" and len(parts) == 1 and token != "header":
            return True
        if parts[0] in WEAK_MARKS and all(x in MARKS or x in WEAK_MARKS or x in PLACES or x in BOX or x.isdigit() or len(x) == 1 for x in parts[1:]):
            return True
    return False


def _unwanted(node: Node, attributes: dict[str, str]) -> bool:
    name = node.name
    if name in DROPPED or name == "header" and not node.framed:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or attributes.get("role", "").lower() in ROLES:
        return True
    return marked(attributes.get("class", "")) or name != "article" and marked(attributes.get("id", ""))


def _soft(name: str, attributes: dict[str, str]) -> bool:
    """Whether an unwanted element is so by evidence only: a form, or a mark that is not firm."""
    if name in DROPPED and name != "form" or name == "header" or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return False
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        parts = [x for x in _PART.split(token) if x]
        if any(x in FIRM for x in parts) and all(x in FIRM or x in MARKS or x in WEAK_MARKS or x in PLACES or x in BOX or x.isdigit() for x in parts):
            return False
    return True


def _opened_in(node: Node, name: str) -> Node:
    """Where a start tag puts its element, after the end tags that it implies."""
    if node.name == "head" and name not in IN_HEAD:
        node = node.parent
    if name in TABLE:
        closed = [node.table[x] for x in CLOSED_BY[name] if x in node.table]
        if closed:
            node = min(closed, key=lambda n: n.depth).parent
    elif name in CLOSED_BY and node.bound.name in CLOSED_BY[name]:
        node = node.bound.parent
    if name in CLOSES_P and node.upper.name == "p":
        node = node.upper.parent
    if name in HEADINGS and node.name in HEADINGS:
        node = node.parent
    return node


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes of a tag, the first of each name, and the place after its ">"; -1 where the page ends first.

    A "/" ends no tag: only void elements are empty. A quote that is never closed belongs to an unquoted value.
    """
    found: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(page, at)
        if m[1]:
            found.setdefault(m[1].lower(), next((x for x in m.group(2, 3, 4) if x is not None), ""))
        at = m.end()
        if at >= len(page):
            return found, -1
        if page[at] == ">":
            return found, at + 1


def parse(page: str) -> Node:
    """The element tree of a page, unwanted elements marked; texts are str children. Linear in the page."""
    root = Node("body", None)
    at, node, end = 0, root, len(page)
    opened: Counter = Counter()  # elements on the way from the root to the node, by name
    heads = 0

    def leave(to: Node) -> Node:
        nonlocal heads
        up = node
        while up is not to:
            opened[up.name] -= 1
            heads -= up.name == "head"
            up = up.parent
        return to

    def text(piece: str) -> None:
        nonlocal node
        if piece:
            if node.name == "head" and piece.strip():
                node = leave(node.parent)
            node.children.append(entities.unescape(piece))

    while at < end:
        m = _OPENED.search(page, at)
        text(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        if not m[4]:
            close = page.find("-->" if m[1] else ">", at - 2 if m[1] else at)  # also ends "<!-->"
            at = close + (3 if m[1] else 1) if close >= 0 else end
            continue
        name, closing = m[4].lower(), m[3] == "/"
        attributes, after = _attributes(page, at)
        if after < 0:
            break  # a tag that the page's end cuts off
        at = after
        if name in ("html", "body"):
            if name == "body" and heads:
                while heads:
                    node = leave(node.parent)
            continue
        if closing:
            if opened[name]:
                while node.name != name:
                    node = leave(node.parent)
                node = leave(node.parent)
            continue
        if name in RAW:
            close = _RAW_END[name].search(page, at)
            at = close.end() if close else end
            continue
        node = leave(_opened_in(node, name))
        child = Node(name, node)
        child.unwanted = _unwanted(child, attributes)
        child.soft = child.unwanted and _soft(name, attributes)
        node.children.append(child)
        if name not in VOID:
            node = child
            opened[name] += 1
            heads += name == "head"
    return root


def prune(root: Node) -> None:
    """Take unwanted elements out of the tree."""
    stack = [root]
    while stack:
        n = stack.pop()
        n.children = [c for c in n.children if not isinstance(c, Node) or not c.unwanted]
        stack.extend(c for c in n.children if isinstance(c, Node))


def spare(root: Node) -> None:
    """Evidence never outweighs the text: a soft unwanted element stays where what is left without it is under a fifth of its own
    unlinked characters and it has paragraphs (or lines) of its own. Of several the one with most."""
    kept: dict[int, int] = {}  # unlinked characters that stay if the element itself does
    lines: dict[int, int] = {}
    best, most = None, 0
    for n in reversed(_below(root)):
        own = told = 0
        for c in n.children:
            if not isinstance(c, Node):
                own += len(_SPACE.sub(" ", c).strip())
            elif not c.unwanted and c.name != "a":
                own += kept[id(c)]
                told += lines[id(c)] + (c.name in ("p", "br"))
        kept[id(n)], lines[id(n)] = own, told
        if n.unwanted and n.soft and own > most and (told >= 2 or n.name == "article"):
            best, most = n, own
    if best is not None and 5 * kept[id(root)] < most:
        while best is not None:
            best.unwanted = False
            best = best.parent if best.parent is not None and (not best.parent.unwanted or best.parent.soft) else None


def _measure(root: Node) -> list[Node]:
    """Fill in counts, densities and sums; nodes in page order."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(reversed([c for c in n.children if isinstance(c, Node)]))
    for n in reversed(order):
        for c in n.children:
            if isinstance(c, Node):
                n.block |= c.block
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_chars += c.link_chars
                n.link_tags += c.link_tags + (c.name == "a")
            else:
                n.chars += len(_SPACE.sub(" ", c).strip())
        if n.name == "a":
            n.link_chars = n.chars
    share = root.link_chars / max(1, root.chars)
    for n in order:
        if not n.chars:
            continue
        c, t, lc, lt = n.chars, max(1, n.tags), n.link_chars, n.link_tags
        base = math.log(c * lc / max(1, c - lc) + share * c + math.e)
        n.density = max(0.0, c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt))) / math.log(max(base, 1.0 + 1e-9)) if base > 1 else c / t)
    for n in order:
        n.total = sum(c.density for c in n.children if isinstance(c, Node) and c.block and not c.unwanted) or n.density * 1e-6
    return order


def _best(order: list[Node]) -> Node:
    return max((n for n in order if n.block), key=lambda n: n.total, default=order[0])


def _below(n: Node) -> list[Node]:
    out, stack = [], [n]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(reversed([c for c in x.children if isinstance(c, Node)]))
    return out


def _linked(n: Node) -> bool:
    """Whether most characters of what is left of a subtree are links."""
    chars = linked = 0
    stack = [(n, n.name == "a")]
    while stack:
        x, inside = stack.pop()
        for c in x.children:
            if isinstance(c, Node):
                stack.append((c, inside or c.name == "a"))
            else:
                own = len(_SPACE.sub(" ", c).strip())
                chars += own
                linked += own * inside
    return 2 * linked > chars


def article(root: Node) -> list[Node]:
    """The subtrees that hold the article, in page order; unwanted elements count for densities and go."""
    spare(root)
    _measure(root)
    prune(root)
    best = _best(_below(root))
    threshold, up, top, framed = best.density, best, best, best.name in ("article", "main")
    while up.parent is not None:
        up = up.parent
        threshold = min(threshold, up.density)
        if up.name in ("article", "main"):
            top, framed = up, True
    path, up = {id(top)}, top
    while up.parent is not None:
        up = up.parent
        path.add(id(up))
    chosen, stack = [], [root]
    while stack:
        n = stack.pop()
        if n is top:
            chosen.append(n)
        elif id(n) in path:
            loose = [c for c in n.children if not isinstance(c, Node) and c.strip()]
            if loose:
                return [n]  # text of its own beside the best subtree: the article is the parent
            stack.extend(reversed([c for c in n.children if isinstance(c, Node)]))
        elif n.density and (n.density >= threshold or n.name in ("article", "main") or not framed and not _linked(n)):
            chosen.append(n)
    return chosen


def blocks(nodes: list[Node]) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", "".join(line)).strip()
        if text:
            out.append(text)
        line.clear()

    for top in nodes:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                close()
            elif isinstance(x, str):
                line.append(x)
            elif x.name == "br":
                line.append(" ")
            elif x.name in BLOCKS:
                close()
                stack.append(None)
                stack.extend(reversed(x.children))
            else:
                stack.extend(reversed(x.children))
        close()
    return out


def main_text(page: str | None) -> str:
    """The article of one page."""
    if not page or not page.strip():
        return ""
    return "\n\n".join(blocks(article(parse(page))))


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (default: all but the html) with text and n_chars; input columns of these names are replaced."""
    ship(__name__)
    keep = [c for c in (keep if keep is not None else pages.columns) if c.lower() not in ("text", "n_chars", html_col.lower())]
    inner = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").cast("string").alias(free_name(pages, "_html")))
    schema = T.StructType([*inner.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, len(keep), 4 << 20, 256):
                texts = [main_text(x) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return inner.mapInArrow(run, schema)
