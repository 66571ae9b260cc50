"""Main-text extraction by composite text density.

A page is parsed to a tree. Elements that are never article text are cut off: by their tag (menus, forms, scripts, ...)
or because they are hidden; by class, id or role only if those mark them and they hold no article, main or h1, nor
more than half of the text of the article around them (or of the page, where none is around them; an element marked as
reader comments may hold more, if any other text is left). For every node left, the composite density is its characters per tag,
adjusted by the share of characters in links; a node's density sum is that of its children. From the node of the
largest sum, the least density on its path up to the body is the threshold; among nodes that reach the threshold the
subtree of the largest sum is the article. As its paragraphs may be split over sections, the choice goes up, below the
body, while the parent reaches the threshold as well.

Parsing takes time in proportion to the page, however deep or broken it is: tags that never end are text, and after a
tag that only ends inside quotes the rest of the page is read without heed of quotes. Unclosed elements end with what
contains them. Null and empty pages give an empty text; texts of any length stay whole. Repeated rows give a row each, an empty
table none. Only the columns in `keep` are returned beside text and n_chars; of these names in `keep`, those two win.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?", re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"(?<![-\w:.])([A-Za-z_:][-\w:.]*+)\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|(?<![-\w=\"'])(hidden)(?![-\w=])", re.S)

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("script style template noscript head title iframe object embed svg canvas math audio video nav footer aside form menu dialog button select textarea input option label fieldset map noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An open element of the first kind ends where one of the second begins.
ENDS = {
    "p": BLOCKS - {"br", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"},
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option", "optgroup"}),
    "tr": frozenset({"tr", "tbody", "tfoot", "thead"}), "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "head": frozenset({"body"}),
}
# Words of class names, ids and roles that mark what isn't article text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner nav navbar navigation menu menus "
    "breadcrumb breadcrumbs pagination pager sidebar sidebars aside header masthead footer foot copyright cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup signin login comment comments commentlist disqus reply replies respond share sharing social related "
    "recommended recommendations widget widgets toolbar skip search form complementary contentinfo dialog disclaimer".split()
)
# Of these, words that mark reader comments.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
# Words that say nothing of the content: a class name marks if it holds a mark and, beside marks, only these.
NEUTRAL = frozenset(
    "area articles bar block body bottom box btn button buttons center col column container content cta div form group head heading icon icons inner item items label left link links list "
    "lower middle mobile outer panel posts primary right row secondary section site slot small text thread threads title tools top unit upper view wrap wrapper zone".split()
)
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
_KEEP = frozenset({"html", "body", "article", "main", "h1"})


class Node:
    __slots__ = ("tag", "up", "parts", "chars", "links", "tags", "link_tags", "density", "total", "cut", "named", "comments", "kept", "ends", "scope")

    def __init__(self, tag: str, up: Node | None, cut: bool = False, named: bool = False, comments: bool = False):
        # named: cut for its class, id or role alone; kept: no more to be cut for those
        self.tag, self.up, self.cut, self.named, self.comments, self.kept = tag, up, cut or named, named and not cut, comments, False
        self.parts: list[Node | str] = []
        # the nearest element, itself included, of those that others end, if only formatting stands between
        self.ends: Node | None = self if tag in ENDS else up.ends if up is not None and tag not in BLOCKS else None
        # the article or main element around it, itself included
        self.scope: Node | None = self if tag in ("article", "main") else up.scope if up is not None else None


def _words_of(name: str) -> set[str]:
    """The words of a class name, id or role, if it marks and says nothing else; else none."""
    found = {w.lower() for w in _WORDS.findall(name)}
    return found if not MARKS.isdisjoint(found) and found <= MARKS | NEUTRAL else set()


def _marks(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is hidden, whether its class, id or role marks it, and whether as reader comments."""
    found: set[str] = set()
    if tag in _KEEP or not attributes:
        return False, False, False
    hidden = False
    for m in _ATTRIBUTE.finditer(attributes):
        if m[3]:
            hidden = True
            continue
        name, value = m[1].lower(), m[2].strip("\"'")
        if name in ("class", "id", "role"):
            found = found.union(*map(_words_of, value.split()))
        if name == "id":
            # what an id begins with says what the element is, whatever other words follow
            found |= COMMENTS & {w.lower() for w in _WORDS.findall(value)[:1]}
        if name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return hidden, bool(found), not COMMENTS.isdisjoint(found)


class _Reader:
    """Where tags end."""

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def tag_end(self, at: int) -> int:
        """Place of the > that ends a tag whose attributes begin at `at`; -1 if there is none."""
        if at > self.last:
            return -1
        page, here = self.page, at
        while self.quotes and (m := _STOP.search(page, here)) is not None:
            if m[0] == ">":
                return m.start()
            close = page.find(m[0], m.end())
            if close < 0:
                break
            here = close + 1
        # a quote that is never closed, or no end outside quotes: quotes mean nothing from here on
        self.quotes = False
        return page.find(">", at)


def parse(page: str) -> Node:
    """The page's tree; a node's parts are texts and nodes, `cut` marks what isn't article text."""
    root = Node("#root", None)
    reader, here, at, n = _Reader(page), root, 0, len(page)
    opened: dict[str, int] = {}  # elements of each tag that are open

    def climb(to: Node) -> Node:
        node = here
        while node is not to:
            opened[node.tag] -= 1
            node = node.up
        return to

    while at < n:
        if page[at] != "<":
            end = page.find("<", at)
            end = n if end < 0 else end
            here.parts.append(page[at:end])
            at = end
            continue
        if (m := _MARKUP.match(page, at)) is not None:
            at = m.end()
            continue
        m = _TAG.match(page, at)
        end = reader.tag_end(m.end()) if m is not None else -1
        if end < 0:
            here.parts.append("<")
            at += 1
            continue
        at, tag, attributes = end + 1, m[2].lower(), page[m.end() : end]
        if m[1]:
            if opened.get(tag):
                node = here
                while node.tag != tag:
                    node = node.up
                here = climb(node.up)
            elif tag in ("p", "br"):
                here.parts.append(Node(tag, here))
            continue
        if here.ends is not None and tag in ENDS[here.ends.tag]:
            here = climb(here.ends.up)
        hidden, named, comments = _marks(tag, attributes)
        made = Node(tag, here, tag in DROPPED or hidden or tag == "header" and here.scope is None, named, comments)
        if tag in ("article", "main", "h1"):
            _keep_around(here)
        here.parts.append(made)
        closed = attributes.rstrip().endswith("/")
        if tag in RAW and not closed:
            found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            made.parts.append(page[at : found.start() if found else n])
            at = found.end() if found else n
        elif tag not in VOID and not closed:
            opened[tag] = opened.get(tag, 0) + 1
            here = made
    return root


def _keep_around(node: Node | None) -> None:
    while node is not None and not node.kept:
        node.kept = True
        if node.named:
            node.cut = node.named = False
        node = node.up


def _keep_large(root: Node) -> None:
    """Elements that are cut for their names stay if they hold more than half of the text around them: of the article, or of a page without one."""
    order = [root]
    for node in order:
        order += [p for p in node.parts if isinstance(p, Node) and (p.named or not p.cut)]
    if not any(x.named for x in order):
        return
    for node in reversed(order):
        node.chars = sum(len("".join(p.split())) if isinstance(p, str) else p.chars if p.named or not p.cut else 0 for p in node.parts)
    articles = any(x.tag in ("article", "main") for x in order)
    for node in order:
        around = node.scope or (None if articles else root)
        if node.named and around is not None and (node.chars == around.chars if node.comments else 2 * node.chars > around.chars):
            node.cut = node.named = False


def _walk(root: Node) -> list[Node]:
    """Nodes that aren't cut off, parents first; without recursion, as trees may be deep."""
    order = [root]
    for node in order:
        order += [p for p in node.parts if isinstance(p, Node) and not p.cut]
    return order


def _measure(root: Node) -> list[Node]:
    order = _walk(root)
    for node in reversed(order):
        inner = [p for p in node.parts if isinstance(p, Node) and not p.cut]
        text = sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        node.chars = text + sum(p.chars for p in inner)
        node.links = node.chars if node.tag == "a" else sum(p.links for p in inner)
        node.tags = len(inner) + sum(p.tags for p in inner)
        node.link_tags = sum(p.link_tags + (p.tag == "a") for p in inner)
    body = next((x for x in order if x.tag == "body"), root)
    share = body.links / max(body.chars, 1)
    for node in reversed(order):
        chars, links = node.chars, max(node.links, 1)
        tags, link_tags = max(node.tags, 1), max(node.link_tags, 1)
        plain = max(chars - node.links, 1)
        base = math.log(chars / plain * node.links + share * chars + math.e)
        inside = chars / links * tags / link_tags
        node.density = chars / tags * math.log(max(inside, 1.0), base) if chars and base > 1 and inside > 1 else 0.0 if not chars else chars / tags * (inside > 1)
        if base <= 1.0000001 and chars:
            node.density = chars / tags
        node.total = sum(p.density for p in node.parts if isinstance(p, Node) and not p.cut)
    return order


def article(page: str) -> Node:
    """The node of the article."""
    root = parse(page)
    _keep_large(root)
    order = _measure(root)
    body = next((x for x in order if x.tag == "body"), root)
    order = _walk(body)
    best = max(order, key=lambda x: x.total)
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].up)
    threshold = min(x.density for x in path)
    chosen = max((x for x in order if x.density >= threshold), key=lambda x: x.total, default=best)
    if not chosen.total:
        return body
    # a run of paragraphs may be split over sections: go up, below the body, while the parent reaches the threshold
    while chosen is not body and chosen.up is not body and chosen.up.density >= threshold:
        chosen = chosen.up
    return chosen


def text_of(node: Node) -> str:
    """Texts of a subtree in page order: white space inside a block as one space, blocks joined by one space."""
    out: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.cut or x is node:
            if x.tag in BLOCKS:
                out.append(" ")
                stack.append(" ")
            stack += reversed(x.parts)
    return " ".join(html.unescape("".join(out)).split())


def main_text(page: str | None) -> str:
    return text_of(article(page)) if page else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(0).to_pylist()]
        # lone surrogates, as from references to them, have no UTF-8 form
        texts = [t if t.isascii() else t.encode("utf-8", "replace").decode() for t in texts]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], [*batch.schema.names[1:], "text"])


def extract(df: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep`, text and n_chars (its code points)."""
    keep = tuple(c for c in keep if c not in ("text", "n_chars"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    texts = df.select(F.col(page).alias("_page"), *keep).mapInArrow(_extract, f"{schema}, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
