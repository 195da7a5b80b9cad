"""Main text of web pages by composite text density.

The page becomes a tree (optional end tags implied as browsers do). Elements that never are content
(scripts, navigation, controls) leave the tree first. Names and roles (menus, adverts, forms, notices,
comments) are evidence only: a part that has one leaves if it holds less than half of the page's text
outside links, or if an article, main element or first heading with text of its own stands elsewhere.
A page whose one layout class or one form surrounds all of it therefore keeps its text.
Then every node gets its characters, tags, link characters and link tags, its composite density

    C/T * log(C/LC * T/LT) in base ln(C/notLC * LC + LCb/Cb * C + e)

(b: the body; empty counts as 1), and the sum of its children's densities. The threshold is the
smallest density on the path from the body to the node of the largest sum. From the body down, every
node at or above it gives content: a container the part of the largest sum within it, then what its
other children give; anything else itself as a whole. Beside content in a container, loose text and
blocks that aren't mostly links stay, such as short paragraphs and titles; beside content directly in
the body, which frames the page, only the headings before it stay.

Blocks of the article: white space runs become one space, ends are trimmed, empty blocks go, and
blocks are joined by one line feed. <br> ends a block.

Cases: null, empty and text-free html give ""; broken markup is read as far as it goes; deep nesting
is walked without recursion; very long pages are read whole; repeated rows give repeated results; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements without content, elements that are blocks, and whose start ends an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption br title".split()
)
ENDS_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "title", "html", "body"}
# An element's start closes these open ones, looked for no higher than the given elements.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
DROPPED = frozenset("head script style noscript template nav footer aside button select textarea input iframe object embed svg canvas dialog menu audio video map math".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar|side-bar|footer|masthead|site-header|page-header|header|cookies?|consent|gdpr|notices?|newsletter|subscribe|signup|popup|modal|overlay|share|sharing|social|comments?|commentlist|disqus|replies|respond|related|recommended|pagination|pager|widget|toolbar|skip|login)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
FOREIGN = frozenset("svg path math use circle rect line g".split())
# Elements that lay out a page; table parts do where they hold such blocks. Others are content or not as a whole.
CONTAINERS = frozenset("html article center div form main section".split())
TABLE_PARTS = frozenset("table tbody td tfoot th thead tr".split())
LAID_OUT = frozenset("article blockquote center div form h1 h2 main ol p section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())
P_SCOPE = frozenset("table td th button article section div li blockquote main".split())
A_SCOPE, BLOCK_SCOPE = BLOCK - {"p"}, BLOCK - {"p", "br"}


class Node:
    __slots__ = ("tag", "kids", "named", "chars", "tags", "link_chars", "link_tags", "density", "total", "parent", "inner_heading")

    def __init__(self, tag: str, parent: Node | None, named: bool = False) -> None:
        self.tag, self.parent, self.named, self.kids = tag, parent, named, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.inner_heading = False


# A tag with its attributes (quoted values may hold ">"), a comment, or a declaration; anything else is text.
TOKEN = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|!--(?:>|->|.*?(?:--!?>|\Z))|[!?/][^>]*+(?:>|\Z))""", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s"'>]++))?""")
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}


class _Tree:
    def __init__(self) -> None:
        self.root = self.at = Node("html", None)
        self.open_nodes: list[Node] = []
        self.depths: dict[str, list[int]] = {}  # where elements of each name stand among the open ones

    def read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            sign = html.find("<", at)
            if sign < 0 or html.find(">", sign) < 0 and not html.startswith("<!--", sign):
                break
            found = TOKEN.match(html, sign) or LOOSE.match(html, sign)
            if found is None:
                stop = html.find("<", sign + 1)
                self.text(html[at : stop if stop >= 0 else end])
                at = stop if stop >= 0 else end
                continue
            if sign > at:
                self.text(html[at:sign])
            at, tag = found.end(), found[2]
            if tag is None:
                continue
            tag = tag.lower()
            if found[1]:
                self.close(tag)
                continue
            self.open(tag, found[3])
            if tag in RAW:
                stop = RAW[tag].search(html, at)
                at = stop.start() if stop else end
        if at < end:
            self.text(html[at:])

    def text(self, data: str) -> None:
        self.at.kids.append(unescape(data) if "&" in data else data)

    def _close(self, wanted, stop=()) -> bool:
        """Closes the innermost open element of the wanted ones, unless one of `stop` is open within it."""
        depths = self.depths
        deep = lambda tags: max((depths[t][-1] for t in tags if depths.get(t)), default=-1)
        found = deep(wanted)
        if found < 0 or found < deep(stop):
            return False
        while len(self.open_nodes) > found:
            depths[self.open_nodes.pop().tag].pop()
        self.at = self.open_nodes[-1] if self.open_nodes else self.root
        return True

    def open(self, tag: str, rest: str) -> None:
        if tag in ("html", "body"):
            return
        if tag in ENDS_P:
            self._close(("p",), P_SCOPE)
        if tag in IMPLIED:
            close, stop = IMPLIED[tag]
            while self._close(close, stop):
                pass
        elif tag == "a":
            self._close(("a",), A_SCOPE)
        named = False
        if rest and not rest.isspace() and tag not in VOID:
            found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(rest)}
            named = (
                "hidden" in found
                or found.get("role", "").lower() in ROLES
                or found.get("aria-hidden") == "true"
                or any(k in found and NAMES.search(found[k]) for k in ("class", "id"))
                or "display:none" in found.get("style", "").replace(" ", "").lower()
            )
        node = Node(tag, self.at, named or tag == "form")
        self.at.kids.append(node)
        if tag not in VOID and not (rest.endswith("/") and tag in FOREIGN):
            self.at = node
            self.depths.setdefault(tag, []).append(len(self.open_nodes))
            self.open_nodes.append(node)

    def close(self, tag: str) -> None:
        if tag not in ("html", "body"):
            self._close((tag,), () if tag in BLOCK else BLOCK_SCOPE)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.read(html)
    return tree.root


def _order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [k for k in reversed(node.kids) if isinstance(k, Node)]
    return out


def _removable(kid: Node, inside: bool) -> bool:
    return kid.tag in DROPPED or (kid.tag == "header" and not (inside and kid.inner_heading))


def prune(root: Node) -> None:
    """Takes out what never is content, then named parts that don't hold the page. A header stays where it heads an article."""
    for node in reversed(_order(root)):
        node.inner_heading = node.tag in ("h1", "h2") or any(isinstance(k, Node) and k.inner_heading for k in node.kids)
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or node.tag in ("article", "main")
        node.kids = [k for k in node.kids if isinstance(k, str) or not _removable(k, inside)]
        todo += [(k, inside) for k in node.kids if isinstance(k, Node)]
    order = _order(root)
    plain: dict[Node, int] = {}  # characters outside links
    heart: dict[Node, int] = {}  # those of them in articles, main elements and the sections of top headings
    for node in reversed(order):
        kids = [k for k in node.kids if isinstance(k, Node)]
        plain[node] = 0 if node.tag == "a" else sum(len("".join(k.split())) for k in node.kids if isinstance(k, str)) + sum(plain[k] for k in kids)
        heart[node] = plain[node] if node.tag in ("article", "main") or any(k.tag == "h1" for k in kids) and node is not root else sum(heart[k] for k in kids)
    total, hearts = plain[root], heart[root]
    todo = [root]
    while todo:
        node = todo.pop()
        kept = []
        for kid in node.kids:
            if isinstance(kid, Node):
                if kid.named and kid.tag not in ("article", "main", "h1") and (2 * plain[kid] < total or (4 * heart[kid] < plain[kid] and 4 * (hearts - heart[kid]) > total)):
                    continue
                todo.append(kid)
            kept.append(kid)
        node.kids = kept


def score(root: Node) -> list[Node]:
    """Counts, densities and density sums of every node, in page order."""
    order = _order(root)
    for node in reversed(order):
        for kid in node.kids:
            if isinstance(kid, str):
                node.chars += len("".join(kid.split()))
            else:
                node.chars += kid.chars
                node.tags += kid.tags + (kid.tag != "br")
                node.link_chars += kid.link_chars
                node.link_tags += kid.link_tags + (kid.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    share = root.link_chars / max(1, root.chars)
    for node in reversed(order):
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        if c:
            ratio = c / max(1, lc) * t / lt
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            # Without links anywhere the base is 1 and adjusts nothing: plain characters per tag remain, on one scale.
            node.density = c / t * (math.log(ratio) / math.log(base) if base > 1 and ratio > 1 else 1e-3)
        node.total = sum(k.density for k in node.kids if isinstance(k, Node))
    return order


def _frames(order: list[Node]) -> set[Node]:
    """The nodes that lay out the page."""
    laid, out = set(), set()
    for node in reversed(order):
        if any(isinstance(k, Node) and (k.tag in LAID_OUT or k in laid) for k in node.kids):
            laid.add(node)
        if node.tag in CONTAINERS or (node.tag in TABLE_PARTS and node in laid):
            out.add(node)
    return out


def _marked(root: Node, order: list[Node], frames: set[Node], threshold: float) -> set[Node]:
    """The content nodes, from the body down."""
    best: dict[Node, Node] = {}
    for node in reversed(order):
        best[node] = max((node, *(best[k] for k in node.kids if isinstance(k, Node))), key=lambda n: n.total)
    marked, todo = set(), [root]
    while todo:
        node = todo.pop()
        if node in marked or node.density < threshold:
            continue
        marked.add(best[node] if node in frames else node)
        if node not in marked:
            todo += [k for k in node.kids if isinstance(k, Node)]
    return marked


def content(root: Node) -> Node | None:
    """The tree with what is content: the subtrees at or above the body path's smallest density and what belongs to them."""
    prune(root)
    order = score(root)
    if not root.chars:
        return None
    top = max(order, key=lambda n: n.total)
    if top.total == 0.0:
        return root
    threshold, node = math.inf, top
    while node is not None:
        threshold, node = min(threshold, node.density), node.parent
    frames = _frames(order)
    marked = _marked(root, order, frames, threshold)
    around = set()
    for node in marked:
        while (node := node.parent) is not None and node not in around:
            around.add(node)
    todo = [root]
    while todo:
        node = todo.pop()
        if node in marked:
            continue
        kept, later = [], False
        for kid in reversed(node.kids):
            if kid in marked or kid in around:
                later = True
            elif node is root:
                if isinstance(kid, str) or kid.tag not in HEADINGS or not later:
                    continue
            elif isinstance(kid, Node) and ((kid in frames and kid.tag != "section") or 2 * kid.link_chars > kid.chars):
                continue
            kept.append(kid)
        node.kids = kept[::-1]
        todo += [k for k in kept if k in around]
    return root


def blocks(root: Node) -> list[str]:
    out, line, todo = [], [], [(root, False)]

    def end() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    while todo:
        item, closing = todo.pop()
        if isinstance(item, str):
            line.append(item)
        elif closing or item.tag in VOID:
            if item.tag in BLOCK:
                end()
        else:
            if item.tag in BLOCK:
                end()
            todo.append((item, True))
            todo += [(k, False) for k in reversed(item.kids)]
    end()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    node = content(parse(html))
    return "\n".join(blocks(node)) if node is not None else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
