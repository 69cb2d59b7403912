"""Main text of web pages by wrapper induction.

Pages of one host are aligned with a page of that host (the one of the least page_id) by simple tree matching, which
pairs the most nodes of equal label while keeping order and ancestry. A node whose text stays the same in nearly all
pages that differ from that one belongs to the host's template; what varies is a slot. A page's content are its slots
that no markup marks as a menu, header, footer, sidebar, notice, advert, form or comment; where an article or main
element is marked, that slot alone and all of it, so that passages that many articles share stay. On a host with a
single text there is nothing to compare, and the marks alone decide.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Share of a host's differing pages in which a node of the template has the same text, and how many there must be.
CONSTANT, LEAST_PAGES = 0.9, 2
#: Reference pages are broadcast up to so many characters in all, else joined by host.
BROADCAST_CHARS = 16_000_000
#: Levels of the tree that are aligned node by node; what is deeper is compared as a whole.
DEPTH = 60

# Element names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_CLOSES_P = _BLOCK - {"br", "body", "head", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "title", "dd", "dt", "li"} | {"dd", "dt", "li"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("article aside body button caption div footer form header html main nav object section table td th ul ol dl blockquote figure details".split())
_DROPPED = frozenset("nav footer aside form script style noscript template iframe object embed svg math canvas button select textarea input label head title dialog menu audio video map".split())
# Words of class and id names that mark what isn't content; words that go with them; words that deny them.
_MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside cookie cookies consent gdpr notice notices alert comment comments disqus respond menu nav navbar navigation breadcrumb breadcrumbs footer social share sharing related recommended newsletter subscribe signup popup modal overlay widget toolbar pagination pager masthead skip".split())
_NEUTRAL = frozenset("list box bar block wrap wrapper container section area button buttons link links item items top bottom left right main site page inner outer unit slot group row col column header title head body form thread post posts article articles module panel view primary secondary global local sticky fixed mobile desktop icon icons text".split())
_DENIED = frozenset("no with has without".split())
_HEADERS = re.compile(r"(?:^|[\s_-])(?:header|site-header|topbar)(?:$|[\s_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][^\s=/>]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


def _marked(names: str, inside: bool) -> bool:
    """Whether a class or id name marks what isn't content. Within an article a name must consist of marks and words that
    go with them (comment-list), since share-price or notice-period may be what the article is about; elsewhere one mark
    is enough, unless the name denies it (no-sidebar)."""
    for name in names.lower().split():
        parts = [p for p in re.split(r"[-_]+", name) if p]
        marks = [p in _MARKS for p in parts]
        if "".join(parts) in _MARKS:
            return True
        if any(marks) and not _DENIED.intersection(parts) and (not inside or all(m or p in _NEUTRAL or p.isdigit() for m, p in zip(marks, parts, strict=True))):
            return True
    return False


class Node:
    __slots__ = ("tag", "label", "dropped", "firm", "items")

    def __init__(self, tag: str, label: str = "", dropped: bool = False, firm: bool = False):
        """firm: dropped whatever it contains."""
        self.tag, self.label, self.dropped, self.firm, self.items = tag, label or tag, dropped, firm, []

    def children(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]


def _open(tag: str, attributes: str, inside: bool) -> Node:
    """inside: within an article or main element, where a header holds the headline."""
    found = {k.lower(): html.unescape(v[1:-1] if v[:1] in "\"'" else v) for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip(" /") else {}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    role = found.get("role", "").lower()
    firm = tag in _DROPPED - {"form"} or role in _ROLES - {"form"} or "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
    dropped = firm or tag == "form" or role == "form" or (tag == "header" and not inside)
    if tag not in ("html", "body", "article", "main"):
        dropped = dropped or bool(names.strip() and (_marked(names, inside) or (not inside and _HEADERS.search(names))))
    return Node("main" if role == "main" else tag, f"{tag}.{found.get('class', '')}", dropped, firm)


def parse(page: str) -> Node:
    """A tree of the page; never fails. Tags that HTML lets one leave out are implied, stray end tags are ignored."""
    root = Node("root")
    stack, at, n = [root], 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            stack[-1].items.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if m[0].startswith("<![CDATA[") or not tag:
            continue
        tag = tag.lower()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag or (tag == "main" and stack[k].tag == "main"):
                    del stack[k:]
                    break
                if stack[k].tag in _SCOPE and tag not in _SCOPE:
                    break
            continue
        if not page[m.end() - 1 : m.end()] == ">":
            break  # cut off within a tag
        ends = _SIBLINGS.get(tag, set()) | ({"p"} if tag in _CLOSES_P else set())
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    del stack[k:]
                    break
                if stack[k].tag in _SCOPE and not (tag in ("td", "th", "tr") and stack[k].tag in ("td", "th")):
                    break
        node = _open(tag, attributes, any(x.tag in ("article", "main") for x in stack))
        stack[-1].items.append(node)
        if tag in _VOID:
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            end = stop.start() if stop else n
            if tag in ("title", "textarea"):
                node.items.append(html.unescape(page[at:end]))
            close = page.find(">", end)
            at = n if close < 0 else close + 1
            continue
        stack.append(node)
    return root


def block_text(roots: list[Node], skip: set[int]) -> str:
    """The roots' blocks in page order, white space made single, without dropped nodes and those whose id() is in skip."""
    parts: list[str] = []
    work: list = list(reversed(roots))
    while work:
        x = work.pop()
        if isinstance(x, str):
            parts.append(x)
        elif not x.dropped and id(x) not in skip:
            edge = " " if x.tag in _BLOCK or x.tag in ("option", "img") else ""
            parts.append(edge)
            work.append(edge)
            work += reversed(x.items)
    return " ".join("".join(parts).split())


def _outermost(root: Node, tag: str) -> list[Node]:
    """The outermost elements of this name that aren't in a dropped node."""
    out, work = [], [root]
    while work:
        x = work.pop()
        if x.tag == tag:
            out.append(x)
        else:
            work += [c for c in reversed(x.children()) if not c.dropped]
    return out


def _keep_wrappers(root: Node) -> None:
    """Nodes that hold an article or main element aren't dropped for their class, id or form, since such names may be
    those of the layout; menus, sidebars, footers and what isn't shown stay dropped."""
    order, work = [], [root]
    while work:
        x = work.pop()
        if not x.firm:
            order.append(x)
            work += x.children()
    holds: set[int] = set()
    for x in reversed(order):
        if x.tag in ("article", "main") or any(id(c) in holds for c in x.children()):
            holds.add(id(x))
            x.dropped = False


def main_roots(root: Node) -> list[Node]:
    """The outermost article elements that aren't dropped, but a main element around them where it says more outside of
    them (a lead with cards beneath); else main elements, else those in wrappers dropped for their name alone, else none."""
    mains = _outermost(root, "main")
    if out := _outermost(root, "article"):
        held = {id(a) for m in mains for a in _outermost(m, "article")}
        if held == {id(a) for a in out} and len(block_text(mains, held)) > len(block_text(out, set())):
            return mains
        return out
    _keep_wrappers(root)
    return mains or _outermost(root, "article") or _outermost(root, "main")


def skeleton(node: Node, depth: int = 0) -> list:
    """[label, checksum of the text, children]; marked articles are one slot, as is all below DEPTH."""
    whole = depth >= DEPTH or node.tag in ("article", "main", "svg")
    own = block_text([node], set()) if whole else "".join(x for x in node.items if isinstance(x, str)).strip()
    return [node.label, crc32(" ".join(own.split()).encode("utf-8", "replace")), [] if whole else [skeleton(c, depth + 1) for c in node.children()]]


def align(a: list, b: list) -> list[tuple[list, list]]:
    """Pairs of nodes of two skeletons with equal labels, by simple tree matching: the largest match that keeps order
    and ancestry. Children of the same shape at either end are paired at once: no match of a child is larger than with
    its like, so some largest match pairs them; only what lies between goes into the table."""
    shapes: dict[int, int] = {}

    def shape(x: list) -> int:
        """A number that trees of equal labels share."""
        for y in reversed(_numbered(x)):
            if id(y) not in shapes:
                shapes[id(y)] = hash((y[0], tuple(shapes[id(c)] for c in y[2])))
        return shapes[id(x)]

    memo: dict[tuple[int, int], tuple[int, list]] = {}

    def match(x: list, y: list) -> tuple[int, list]:
        if x[0] != y[0]:
            return 0, []
        if (k := (id(x), id(y))) in memo:
            return memo[k]
        p, q = x[2], y[2]
        pairs: list = []
        low = 0
        while low < min(len(p), len(q)) and shape(p[low]) == shape(q[low]):
            low += 1
        high = 0
        while high < min(len(p), len(q)) - low and shape(p[-1 - high]) == shape(q[-1 - high]):
            high += 1
        alike = list(zip([*p[:low], *p[len(p) - high :]], [*q[:low], *q[len(q) - high :]], strict=True))
        p, q = p[low : len(p) - high], q[low : len(q) - high]
        table = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i, c in enumerate(p, 1):
            for j, d in enumerate(q, 1):
                table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + match(c, d)[0])
        i, j, size = len(p), len(q), table[-1][-1] + sum(match(c, d)[0] for c, d in alike)
        while i and j:
            if table[i][j] == table[i - 1][j - 1] + (w := match(p[i - 1], q[j - 1])[0]) and w:
                pairs.append((p[i - 1], q[j - 1]))
                i, j = i - 1, j - 1
            elif table[i][j] == table[i - 1][j]:
                i -= 1
            else:
                j -= 1
        pairs += alike
        memo[k] = (size + 1, pairs)
        return memo[k]

    out, work = [], [(a, b)] if match(a, b)[0] else []
    while work:
        x, y = work.pop()
        out.append((x, y))
        work += match(x, y)[1]
    return out


def _numbered(tree: list) -> list[list]:
    """The nodes of a skeleton in page order."""
    out, work = [], [tree]
    while work:
        x = work.pop()
        out.append(x)
        work += reversed(x[2])
    return out


def _nodes(node: Node) -> list[Node]:
    """The nodes of a page in the order in which _numbered() has its skeleton's."""
    out, work = [], [(node, 0)]
    while work:
        x, depth = work.pop()
        out.append(x)
        if not (depth >= DEPTH or x.tag in ("article", "main", "svg")):
            work += [(c, depth + 1) for c in reversed(x.children())]
    return out


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html, reference) to (host, node, pages, same), summed over each batch."""
    for batch in batches:
        pages, same, kept = Counter(), Counter(), {}
        for host, page, reference in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if host not in kept:
                tree = json.loads(reference)
                kept[host] = tree, {id(x): k for k, x in enumerate(_numbered(tree))}
            tree, number = kept[host]
            own = skeleton(parse(page or ""))
            if own == tree:
                continue
            for x, y in align(tree, own):
                pages[host, number[id(x)]] += 1
                same[host, number[id(x)]] += x[1] == y[1]
        rows = list(pages)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([pages[r] for r in rows], pa.int64()), pa.array([same[r] for r in rows], pa.int64())], names=["host", "node", "pages", "same"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html, host, reference, constant) to (page_id, url, text)."""
    for batch in batches:
        texts, kept = [], {}
        for _, _, page, host, reference, constant in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            root = parse(page or "")
            roots, skip = main_roots(root), set()
            if not roots:
                roots = [root]
                if constant:
                    if host not in kept:
                        tree = json.loads(reference)
                        order = _numbered(tree)
                        kept[host] = tree, {id(order[k]) for k in constant}
                    tree, fixed = kept[host]
                    own = skeleton(root)
                    node = {id(s): x for s, x in zip(_numbered(own), _nodes(root), strict=True)}
                    # A constant node goes only if all below it is constant too: else it holds a slot.
                    pairs = {id(y): id(x) in fixed and x[1] == y[1] for x, y in align(tree, own)}
                    whole: dict[int, bool] = {}
                    for y in reversed(_numbered(own)):
                        whole[id(y)] = pairs.get(id(y), False) and all(whole[id(c)] for c in y[2])
                    skip = {id(node[k]) for k, v in whole.items() if v}
            texts.append(block_text(roots, skip))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees = [json.dumps(skeleton(parse(page or ""))) for page in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees, pa.string())], names=["host", "reference"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars (code points).

    Null and empty pages have an empty text. Pages without a URL count as one host. Repeated rows are returned as often
    as they come. Votes on the template are summed in each task before they are shuffled, so a host with a third of all
    pages is no larger group than any other; references go to all tasks only while they are small, else by a join.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    first = rows.groupBy("host").agg(F.min_by("html", F.struct(F.col("html").isNull(), F.col("page_id"))).alias("html"))
    references = materialise(first.mapInArrow(_skeletons, "host string, reference string"), "references")
    size = references.agg(F.sum(F.length("reference"))).first()[0] or 0
    near = F.broadcast if size <= BROADCAST_CHARS else (lambda df: df)
    votes = rows.join(near(references), "host").select("host", "html", "reference").mapInArrow(_votes, "host string, node int, pages long, same long")
    summed = votes.groupBy("host", "node").agg(F.sum("pages").alias("pages"), F.sum("same").alias("same"))
    constant = summed.where((F.col("pages") >= LEAST_PAGES) & (F.col("same") >= CONSTANT * F.col("pages"))).groupBy("host").agg(F.collect_list("node").alias("constant"))
    wrappers = materialise(references.join(constant, "host", "left"), "wrappers")
    joined = rows.join(near(wrappers), "host", "left").select("page_id", "url", "html", "host", "reference", "constant")
    return joined.mapInArrow(_texts, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
