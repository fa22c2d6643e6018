"""Main-text extraction by composite text density.

For every node of the document tree the characters and tags below it, and those within links, give its
composite density: characters per tag, raised where few of them are link text. The sum of its children's
densities is highest for the node that holds the article. From there the path to the body sets the threshold:
text beside the path stays only if it is at least as dense as the thinnest node on the path. Inside the
outermost article of the path (or main, if there is none) everything that is no furniture (menus, forms, notices, adverts, comments and the like, told
by element, role and class words) stays, however short.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgate.llm.common import batch, scan

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr option legend".split())
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SCOPE = frozenset("html body table td th caption button object template article section div main aside nav footer header form".split())
CONTAINER = frozenset("article main section div body td html".split())
ROOTS = frozenset(("article", "main"))

# Furniture: elements, roles and class words that hold no article text.
FURNITURE = frozenset(
    "head nav aside footer form button select datalist dialog menu noscript template svg math canvas object audio video map "
    "applet script style textarea title xmp iframe noembed noframes".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies copyright disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification overlay pager pagination popup promo promotion promotions recommendations recommended related reply replies respond "
    "share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
NEGATING = frozenset("no has with without hide".split())
#: First words of a name that only place what its last word says ("site-footer").
PLACES = frozenset("site main page top bottom left right primary secondary global mobile desktop sticky floating post entry article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def is_furniture(tag: str, attributes: str, in_root: bool) -> bool:
    """Whether an element is page furniture by itself; a header inside an article or main element is not."""
    if tag in FURNITURE:
        return True
    if tag == "header" and not in_root:
        return True
    if not attributes or attributes.isspace():
        return False
    found = attributes_of(attributes)
    if "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")):
        return True
    return tag not in ("html", "body") and found.get("role", "").lower() in ROLES


def attributes_of(attributes: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}


def named_furniture(tag: str, attributes: str, in_root: bool) -> bool:
    """Whether a class or id names furniture: its first word does, or its last word behind a word of place."""
    if tag in ("html", "body", "article", "main") or not attributes or attributes.isspace():
        return False
    found = attributes_of(attributes)
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = [w.lower() for w in _WORD.findall(name)]
        if words and NEGATING.isdisjoint(words):
            head = words[-1] if words[0] in PLACES else words[0]
            if head in WORDS and not (in_root and head == "header"):
                return True
    return False


class Page:
    """A parsed page: nodes in document order (parents first) and its pieces of text between node borders."""

    def __init__(self, source: str):
        self.tags, self.parents, self.furniture, self.in_root = ["#"], [-1], [False], [False]
        #: nodes that are furniture by element or role, or below one; nodes with a name of furniture
        self.certain, self.named = [False], [False]
        #: (node, text), or (node, None) where a node begins or ends
        self.pieces: list[tuple[int, str | None]] = []
        self._parse(source)
        self._mark()

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        root = self.in_root[parent]
        self.tags.append(tag)
        self.parents.append(parent)
        self.certain.append(self.certain[parent] or is_furniture(tag, attributes, root))
        self.named.append(named_furniture(tag, attributes, root))
        self.in_root.append(root or tag in ROOTS)
        return len(self.tags) - 1

    def _mark(self) -> None:
        """Furniture of all nodes. A name does not make furniture of what holds an article or main element or, on pages without one, most text."""
        n = len(self.tags)
        chars, holds = [0] * n, [False] * n
        for node, text in self.pieces:
            if text is not None and not self.certain[node]:
                chars[node] += sum(map(len, text.split()))
        for node in range(n - 1, 0, -1):
            up = self.parents[node]
            chars[up] += chars[node]
            holds[up] |= holds[node] or (self.tags[node] in ROOTS and chars[node] > 0)
        limit = chars[0] / 2
        self.furniture = [False] * n
        for node in range(1, n):
            named = self.named[node] and not holds[node] and (holds[0] or chars[node] <= limit)
            self.furniture[node] = self.furniture[self.parents[node]] or self.certain[node] or named

    def _parse(self, source: str) -> None:
        stack, at, pieces, tags = [0], 0, self.pieces, self.tags
        depths: dict[str, list[int]] = {}  # where on the stack the open elements of each tag are

        def deepest(names) -> int:
            return max((depths[t][-1] for t in names if depths.get(t)), default=0)

        def close(wanted, scope) -> None:
            depth = deepest(wanted)
            if not depth or (depth < len(stack) - 1 and deepest(scope) > depth):
                return
            for node in reversed(stack[depth:]):
                pieces.append((node, None))
                depths[tags[node]].pop()
            del stack[depth:]

        for found in _TAG.finditer(source):
            start = found.start()
            if start < at:
                continue  # within the text of a raw element
            if start > at:
                pieces.append((stack[-1], source[at:start]))
            at = found.end()
            ending, tag, attributes = found[1] or found[4], found[2] or found[5], found[3] or found[6] or ""
            if not tag:
                continue
            tag = tag.lower()
            if ending:
                close({tag}, ("article", "main", "table") if tag not in ("article", "main", "table", "body", "html") else ())
                continue
            if tag in ("html", "body") and depths.get(tag):
                continue
            if tag in CLOSES_P:
                close({"p"}, SCOPE)
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            node = self._open(tag, attributes, stack[-1])
            pieces.append((node, None))
            if tag in RAW:
                end = re.compile(f"</{tag}[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
            elif tag not in VOID:
                depths.setdefault(tag, []).append(len(stack))
                stack.append(node)
        if at < len(source):
            pieces.append((stack[-1], source[at:]))


def densities(page: Page) -> tuple[list[float], list[float], list[float]]:
    """(composite density, sum of the children's densities, share of link characters) of every node."""
    n = len(page.tags)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for node in range(1, n):
        in_link[node] = page.tags[node] == "a" or in_link[page.parents[node]]
    for node, text in page.pieces:
        if text is not None:
            size = sum(map(len, text.split()))
            chars[node] += size
            if in_link[node]:
                link_chars[node] += size
    for node in range(n - 1, 0, -1):
        up = page.parents[node]
        chars[up] += chars[node]
        link_chars[up] += link_chars[node]
        tags[up] += tags[node] + 1
        link_tags[up] += link_tags[node] + (page.tags[node] == "a")
    body_share = link_chars[0] / chars[0] if chars[0] else 0.0
    density, total = [0.0] * n, [0.0] * n
    for node in range(n - 1, -1, -1):
        c, t = chars[node], max(1, tags[node])
        if c:
            lc = link_chars[node]
            base = math.log(c / max(1, c - lc) * lc + body_share * c + math.e)
            density[node] = c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, link_tags[node])) + 1e-9) / math.log(max(base, 1.1))
        if node and not page.furniture[node]:
            total[page.parents[node]] += density[node]
    return density, total, [lc / c if c else 0.0 for lc, c in zip(link_chars, chars, strict=True)]


def kept_nodes(page: Page) -> list[bool]:
    """Which nodes' own text belongs to the article."""
    n = len(page.tags)
    density, total, link_share = densities(page)
    # a node without children competes with its own density, so a page of one paragraph has a best node too
    leaf = [True] * n
    for node in range(1, n):
        leaf[page.parents[node]] = False
    scored = [(-(density[k] if leaf[k] else total[k]), k) for k in range(n) if not page.furniture[k]]
    best = min(scored)[1]
    keep = [False] * n
    path = [best]
    while page.parents[path[-1]] >= 0:
        path.append(page.parents[path[-1]])
    # the outermost article of the path, or else its outermost main
    root = next((k for tag in ("article", "main") for k in reversed(path) if page.tags[k] == tag), None)
    outer = next((k for k in reversed(path) if page.tags[k] in ROOTS), None)
    if root is None:
        root = next((k for k in path if page.tags[k] in CONTAINER), path[-1])
        above = set(path[path.index(root) + 1 :])
        threshold = min((density[k] for k in above), default=0.0)
        keep[0] = bool(above)
        for node in range(1, n):
            up = page.parents[node]
            if up in above and node not in above:  # beside the path
                keep[node] = density[node] >= threshold and link_share[node] < 0.5
            else:
                keep[node] = keep[up]
    elif outer != root:  # an article within main: what main has beside the path is judged as well
        above = set(path[path.index(root) + 1 : path.index(outer) + 1])
        threshold = min(density[k] for k in path[path.index(root) + 1 :])
        keep[outer] = True
        for node in range(outer + 1, n):
            up = page.parents[node]
            if up in above and node not in above:
                keep[node] = page.tags[node] in HEADINGS or (density[node] >= threshold and link_share[node] < 0.5)
            else:
                keep[node] = keep[up]
    keep[root] = True
    inside = [False] * n
    inside[root] = True
    for node in range(root + 1, n):
        inside[node] = inside[page.parents[node]]
    return [(k or i) and not f for k, i, f in zip(keep, inside, page.furniture, strict=True)]


def main_text(source: str | None) -> str:
    """The article of a page: blocks in page order, one per line; empty if there is none."""
    page = Page(source or "")
    keep = kept_nodes(page)
    blocks, current = [], []
    for node, text in page.pieces:
        if text is None:
            if page.tags[node] in BLOCK:
                blocks.append("".join(current))
                current = []
            elif page.tags[node] == "br":
                current.append(" ")
        elif keep[node]:
            current.append(entities.unescape(text))
    blocks.append("".join(current))
    return "\n".join(line for line in (" ".join(b.split()) for b in blocks) if line)


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(``id_col``, ``url_col``, text, n_chars) per row; null, empty and article-less pages have an empty text.

    Whole pages are read, one at a time; ids and urls may be null or repeated, other columns are ignored. No shuffle.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [main_text(html) for html in rows.column(2).to_pylist()]
            yield batch(
                {
                    id_col: (rows.column(0), None),
                    url_col: (rows.column(1), None),
                    "text": (texts, pa.string()),
                    "n_chars": ([len(t) for t in texts], pa.int64()),
                }
            )

    frame = pages.select(F.col(f"`{id_col}`"), F.col(f"`{url_col}`"), F.col(f"`{html_col}`").cast("string").alias("__html"))
    kinds = [f.dataType.simpleString() for f in frame.schema.fields]
    return scan(frame, each, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
