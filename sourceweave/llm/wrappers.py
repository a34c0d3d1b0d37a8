"""Main text of web pages by wrapper inference.

Pages of a host mostly come from one template. A page's tags are read as a nested
token stream; equal neighbours fold into a repeated group. The streams of a host
are then aligned one after the other: a text that differs becomes a slot, tags
that only some pages have become optional groups, runs of the same tags become
repeated groups. The result is a regular expression without unions, the host's
wrapper. It says which texts are part of the template: those at one place of the
wrapper that enough pages with different articles share, inside the article too.
A page's article is what its ``article`` or ``main`` elements hold besides; where no
tag names it, the smallest element that holds all of the page's texts that are no
template and no links.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceweave.llm.common import batches_of, written
from sourceweave.llm.urlrules import with_host_path

#: Different pages of a host before a text that they all share counts as part of the template.
TEMPLATE_PAGES = 5
#: Streams a task holds before it hands them on.
HELD = 20_000

_TOKEN = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|/([a-zA-Z][^\s>/]*)[^>]*>?|([a-zA-Z][^\s>/]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*(?:[\"'][^>]*)?)>?|[!?/][^>]*>?)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg annotation annotation-xml object select".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An element of the first kind is closed when one of the second begins.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "button": {"button"}}
#: Elements whose parts may be template; those of lists, tables and paragraphs belong together.
_FRAMES = frozenset(["", "html", "body", "div", "section", "center"])
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SCOPE = frozenset("ul ol dl table article section main body html".split())
_OUT_TAGS = frozenset("nav footer aside form menu dialog button head".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu".split())
_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login "
    "menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo related recommended share sharing sidebar "
    "signup social sponsor sponsored subscribe subscription toolbar widget".split()
)

#: Words that discard an element whatever its length, as long as the page has other text.
_SURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus gdpr newsletter pagination "
    "promo recommended related sidebar sponsored subscribe".split()
)
#: Words that tell an ``article`` element to be none, and those that tell it to be one.
_NO_ARTICLE = frozenset("ad ads advert advertisement comment comments promo recommended related sponsored teaser".split())
_ARTICLE = frozenset("article content entry hentry post story".split())
#: Class names such as ``has-sidebar`` or ``comments-open`` tell a state and no role.
_STATES = frozenset("closed disabled enabled has hide is no off on open show with without".split())


class Node:
    __slots__ = ("chars", "common", "fixed", "key", "kids", "link", "main", "optional", "out", "pages", "repeated", "seen", "soft", "sure", "tag", "text", "weight")

    def __init__(self, tag: str, key: str, out: bool = False, main: bool = False):
        self.tag, self.key, self.out, self.main = tag, key, out, main
        self.kids: list[Node] = []
        self.text: str | int | None = None  # of a "#" node: raw text, or what all pages have, or None for a slot
        self.optional = self.repeated = False
        self.pages, self.chars, self.link = 1, 0, 0
        self.seen: list[int] = []  # of a "#" node of a pattern: contents of pages that have it, TEMPLATE_PAGES at most
        self.common: list[int] = []  # of a "#" node of a pattern: the texts that all pages have here
        self.soft = self.sure = False  # a word of its class or id tells that it is no article
        self.weight, self.fixed = 0, False  # of a page: running text that is no template; a text of the template


def _element(tag: str, attributes: str, in_main: bool) -> Node:
    """An element with the part of its attributes that tells its role."""
    words, names, key, soft, out = [], [], tag, False, tag in _OUT_TAGS or (tag == "header" and not in_main)
    main = tag in ("article", "main")
    if attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                names += [[w.lower() for w in _WORD.findall(part)] for part in value.split()]
            elif name == "role":
                out, main = out or value in _OUT_ROLES, main or value in ("main", "article")
            elif name == "itemprop":
                main = main or value == "articleBody"
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                out = True
        words = [w for part in names for w in part]
        if words:
            key = f"{tag}.{'.'.join(sorted(set(words)))}"
            soft = not _OUT_WORDS.isdisjoint(words) or ("header" in words and not in_main)
    node = Node(tag, key, out, main and not out)
    if tag not in ("html", "body", "main"):
        roles = [part for part in names if _STATES.isdisjoint(part)]
        if node.main:
            plain = any(not _ARTICLE.isdisjoint(part) and _NO_ARTICLE.isdisjoint(part) for part in roles)
            node.sure = any(len(part) == 1 and part[0] in _NO_ARTICLE or not plain and part and part[0] in _NO_ARTICLE for part in roles)
        else:
            node.soft, node.sure = soft, soft and any(not _SURE_WORDS.isdisjoint(part) for part in roles)
    return node


def parse(page: str) -> Node:
    """The block elements of a page as a tree; ``#`` nodes hold the raw text between their borders."""
    root = Node("", "")
    stack, mains = [root], 0
    parts: list[str] = []
    linked, in_link = 0, 0

    def close_text() -> None:
        nonlocal parts, linked
        if parts:
            raw = "".join(parts)
            if raw and not raw.isspace():
                node = Node("#", "#")
                node.text, node.chars, node.link = raw, len(raw), linked
                stack[-1].kids.append(node)
            parts = []
        linked = 0

    def pop_to(tags, scope) -> None:
        nonlocal mains
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                close_text()
                mains -= sum(n.main for n in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in scope:
                return

    at, skip_to = 0, 0
    for m in _TOKEN.finditer(page):
        start = m.start()
        if start < skip_to:
            continue
        if start > at:
            parts.append(page[at:start])
            if in_link:
                linked += start - at
        at = m.end()
        closing, opening = m[1], m[2]
        if closing:
            tag = closing.lower()
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag in _BLOCK or tag == "button":
                pop_to((tag,), () if tag in ("body", "html", "article", "main") else ("article", "main", "body"))
        elif opening:
            tag = opening.lower()
            if tag in _RAW:
                end = re.compile(rf"</{tag}\s*[^>]*>?", re.I).search(page, at) if not m[3].endswith("/") else None
                if not m[3].endswith("/"):
                    at = skip_to = end.end() if end else len(page)
            elif tag == "a":
                in_link = 1
            elif tag in ("br", "wbr", "img", "hr", "input"):
                parts.append(" " if tag != "wbr" else "")
                if tag == "hr":
                    close_text()
            elif tag in _BLOCK or tag == "button":
                close_text()
                in_link = 0
                if tag in _CLOSES:
                    pop_to(_CLOSES[tag], _SCOPE)
                elif tag not in ("html", "head", "body"):
                    pop_to(("p",), ("td", "th", *_SCOPE))
                node = _element(tag, m[3], mains > 0)
                stack[-1].kids.append(node)
                if tag not in _VOID:
                    stack.append(node)
                    mains += node.main
    if at < len(page):
        parts.append(page[at:])
    close_text()
    return root


def clean(raw: str) -> str:
    return " ".join(html.unescape(raw).split())


def settled(root: Node, fixed: frozenset[str] = frozenset()) -> Node:
    """Discards the elements that a word of their class or id tells to be no article.

    Comments, sidebars, teasers and the like go however long they are, unless the
    page would have no text without them. Of the others those stay that stand
    around an element named as the article, or hold more than half of the page's
    running text that is no template.
    """
    gone: list[Node] = []

    def discard(node: Node, sheltered: bool) -> bool:
        """Whether an article that nothing marks as something else lies below."""
        if node.out:
            return False
        if node.sure and (node.main or sheltered):
            gone.append(node)
            return False
        holds = any([discard(k, sheltered) for k in node.kids])
        if node.sure and not holds:
            gone.append(node)
        return holds or node.main

    def free(node: Node) -> bool:
        """Whether an article lies outside of all elements with such words."""
        return not node.out and not node.sure and (node.main or any(free(k) for k in node.kids))

    discard(root, free(root))
    for node in gone:
        node.out = True
    if gone and not weighed(root, fixed, False):
        for node in gone:
            node.out = False
    total = weighed(root, fixed, False) or weighed(root, fixed, True)

    def walk(node: Node) -> bool:
        if node.out:
            return False
        holds = any([walk(k) for k in node.kids]) or node.main
        node.out = node.soft and not holds and 2 * node.weight <= total
        return holds

    walk(root)
    return root


def crc(raw: str, before: int = 0) -> int:
    return zlib.crc32(raw.encode("utf-8", "surrogatepass"), before)


def content(node: Node, before: int = 0) -> int:
    """Tells pages with different texts apart; what is never part of an article doesn't count."""
    if node.out:
        return before
    if node.tag == "#":
        return crc(f"{clean(node.text)}\n", before)
    for kid in node.kids:
        before = content(kid, before)
    return before


def folded(node: Node, page: int | None = None) -> tuple[str, Node]:
    """The element's stream and pattern, with equal neighbours as one repeated group."""
    if page is None:
        page = 0
        for part in named(settled(node)) or [node]:
            page = content(part, page)
    if node.tag == "#":
        out = Node("#", "#")
        out.text, out.chars, out.link, out.seen = crc(node.text), node.chars, node.link, [page]
        out.common = [out.text]
        return "#", out
    out = Node(node.tag, node.key, node.out, node.main)
    streams: list[str] = []
    for kid in node.kids:
        stream, pattern = folded(kid, page)
        if streams and streams[-1] == stream:
            pattern.repeated = True
            out.kids[-1] = merged(out.kids[-1], pattern, same_page=True)
        else:
            streams.append(stream)
            out.kids.append(pattern)
    return f"{node.key}({' '.join(streams)})", out


def merged(a: Node, b: Node, same_page: bool = False, turn: bool = False) -> Node:
    """The pattern of what either pattern describes; ``turn``: another turn of a group, that not all pages have."""
    out = Node(a.tag, a.key, a.out and b.out, a.main)
    out.pages = max(a.pages, b.pages) if same_page else a.pages + b.pages
    out.chars, out.link = a.chars + b.chars, a.link + b.link
    out.optional, out.repeated = a.optional or b.optional, a.repeated or b.repeated
    if a.tag == "#":
        out.text = a.text if a.text == b.text else None
        if a.common != b.common:
            both = {*a.common, *b.common} if same_page and not turn else {*a.common} & {*b.common}
            out.common = sorted(both)
        else:
            out.common = a.common
        out.seen = a.seen if a.seen == b.seen else sorted({*a.seen, *b.seen})[:TEMPLATE_PAGES]
        return out
    left, right = [k.key for k in a.kids], [k.key for k in b.kids]
    if left == right:
        out.kids = [merged(x, y, same_page, turn) for x, y in zip(a.kids, b.kids, strict=True)]
        return out
    for kind, i, j, k, l in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():  # noqa: E741
        if kind == "equal":
            out.kids += [merged(x, y, same_page, turn) for x, y in zip(a.kids[i:j], b.kids[k:l], strict=True)]
            continue
        for kid in [*a.kids[i:j], *b.kids[k:l]]:
            if out.kids and out.kids[-1].key == kid.key and kid.tag != "#":
                out.kids[-1] = merged(out.kids[-1], kid, True, True)  # another turn of the group before it
                out.kids[-1].repeated = True
            else:
                kid.optional = True
                out.kids.append(kid)
    return out


def expression(node: Node) -> str:
    """The wrapper as a regular expression: ``#`` is a slot, ``"`` a fixed text, ``?`` optional, ``+`` repeated."""
    body = ("#" if node.text is None else '"') if node.tag == "#" else f"{node.key}({' '.join(expression(k) for k in node.kids)})"
    return f"{body}{'+' if node.repeated else ''}{'?' if node.optional else ''}"


def dumped(node: Node) -> list:
    return [node.tag, node.key, node.out, node.main, node.text, node.optional, node.repeated, node.pages, node.chars, node.link, node.seen, node.common, [dumped(k) for k in node.kids]]


def loaded(x: list) -> Node:
    out = Node(*x[:4])
    out.text, out.optional, out.repeated, out.pages, out.chars, out.link, out.seen, out.common = x[4:12]
    out.kids = [loaded(k) for k in x[12]]
    return out


def decided(wrapper: Node) -> dict:
    """``fixed``: path and checksum of the texts that enough different pages share.

    Inside an article they count only where other texts of the article differ.
    """

    def varies(node: Node) -> bool:
        return not node.out and (node.text is None if node.tag == "#" else any(varies(k) for k in node.kids))

    fixed: set[str] = set()

    def walk(node: Node, path: str) -> None:
        if node.out or node.main and not varies(node):
            return
        at = f"{path}/{node.key}"
        if len(node.seen) >= TEMPLATE_PAGES:
            fixed.update(f"{at} {text}" for text in node.common)
        for kid in node.kids:
            walk(kid, at)

    walk(wrapper, "")
    return {"fixed": sorted(fixed)}


def weighed(node: Node, fixed: frozenset[str], links: bool, path: str = "") -> int:
    """Sets the weight of every element: its running text outside the template, and of its links if ``links``."""
    at = f"{path}/{node.key}"
    if node.out:
        node.weight = 0
    elif node.tag != "#":
        node.weight = sum([weighed(k, fixed, links, at) for k in node.kids])
    else:
        node.fixed = bool(fixed) and f"{at} {crc(node.text)}" in fixed
        node.weight = 0 if node.fixed else node.chars if links else max(0, node.chars - 2 * node.link)
    return node.weight


def texts(node: Node) -> list[str]:
    """The element's blocks, template or not."""
    if node.out:
        return []
    if node.tag == "#":
        return [text] if (text := clean(node.text)) else []
    return [t for k in node.kids for t in texts(k)]


def named(node: Node) -> list[Node]:
    """The outermost elements that a tag, role or property names as the article."""
    if node.out:
        return []
    return [node] if node.main else [m for k in node.kids for m in named(k)]


def own(node: Node) -> list[str]:
    """The blocks of an article without its template.

    Lists, tables and paragraphs stay or go whole; a heading that all pages share
    stays where text of the page follows it.
    """
    if node.out or template(node):
        return []
    if node.tag not in _FRAMES and not node.main and node.tag != "header":
        return texts(node)
    out: list[str] = []
    held: list[str] = []
    for kid in node.kids:
        if not template(kid):
            out += held + own(kid)
            held = []
        elif kid.tag in _HEADINGS:
            held += texts(kid)
        elif not kid.out and kid.kids or kid.tag == "#":
            held = []
    return out


def template(node: Node) -> bool:
    return node.out or (node.fixed if node.tag == "#" else all(template(k) for k in node.kids))


def framed(root: Node, fixed: frozenset[str]) -> list[str]:
    """Blocks of the smallest element that holds all of a page's texts that are no template and no links.

    Before the first and behind the last part with such text, parts of template or
    of lists of links are left out, but no headings; between them only larger parts
    of template are.
    """
    if not weighed(root, fixed, False):
        weighed(root, fixed, True)

    def within(node: Node) -> list[str]:
        if node.tag not in _FRAMES:
            return texts(node)
        held = [i for i, k in enumerate(node.kids) if k.weight]
        out: list[str] = []
        for i, kid in enumerate(node.kids):
            leaf = all(k.tag == "#" for k in kid.kids)
            between = i < held[-1] and (i > held[0] or kid.tag in _HEADINGS)
            if kid.weight:
                out += within(kid)
            elif leaf and between or (leaf or between) and not template(kid):
                out += texts(kid)
        return out

    at = root
    while only := [k for k in at.kids if k.weight == at.weight and k.weight and k.tag != "#"]:
        at = only[0]
    return within(at) if root.weight else []


def extract(page: str | None, decision: dict | None = None) -> str:
    """The article's blocks, joined by an empty line; a page of nothing but template decides for itself."""
    if not page:
        return ""

    def found(fixed: frozenset[str]) -> list[str]:
        root = settled(parse(page), fixed)
        return [t for m in named(root) for t in own(m)] or framed(root, fixed)

    fixed = frozenset(decision["fixed"]) if decision else frozenset()
    return "\n\n".join(found(fixed) or (found(frozenset()) if fixed else []))


def infer_wrappers(pages: DataFrame, page: str = "html", host: str = "host") -> DataFrame:
    """``host, pages, wrapper, decision`` of every host, over all its pages.

    ``wrapper`` is the expression, ``decision`` what follows from it as JSON.
    Pages are folded to their streams where they are; equal streams of a host are
    counted in the task and then across tasks, so a host's many pages arrive at
    its alignment as few patterns. Null and empty pages take no part.
    """
    schema = pa.schema([("host", pa.string()), ("stream", pa.string()), ("pattern", pa.string())])
    rows_schema = "host string, stream string, pattern string"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held: dict[tuple[str, str], Node] = {}
            for b in batches:
                for at, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    stream, pattern = folded(parse(text.as_py()))
                    known = held.get((at, stream))
                    held[at, stream] = merged(known, pattern) if known else pattern
                    if len(held) >= HELD:
                        yield from ((h, s, json.dumps(dumped(p))) for (h, s), p in held.items())
                        held = {}
            yield from ((h, s, json.dumps(dumped(p))) for (h, s), p in held.items())

        return batches_of(rows(), schema, 1024)

    def meet(batches: Iterator[pa.RecordBatch], by_stream: bool) -> Iterator[pa.RecordBatch]:
        """Merges neighbouring rows of a host (and stream)."""
        at, kept = None, None
        for b in batches:
            for h, s, p in zip(*[c.to_pylist() for c in b.columns], strict=True):
                key = (h, s) if by_stream else (h,)
                if key != at and kept is not None:
                    yield at, kept
                    kept = None
                pattern = loaded(json.loads(p))
                at, kept = key, merged(kept, pattern) if kept is not None else pattern
        if kept is not None:
            yield at, kept

    def by_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(((*at, json.dumps(dumped(p))) for at, p in meet(batches, True)), schema, 1024)

    found = pa.schema([("host", pa.string()), ("pages", pa.int64()), ("wrapper", pa.string()), ("decision", pa.string())])

    def by_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(((at[0], p.pages, expression(p), json.dumps(decided(p))) for at, p in meet(batches, False)), found, 1024)

    read = pages.filter(F.length(page) > 0).select(F.col(host).alias("host"), F.col(page).alias("html"))
    streams = read.mapInArrow(fold, rows_schema).repartition("host", "stream").sortWithinPartitions("host", "stream", "pattern")
    one = streams.mapInArrow(by_stream, rows_schema).repartition("host").sortWithinPartitions("host", "stream")
    return one.mapInArrow(by_host, "host string, pages long, wrapper string, decision string")


def main_text(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, from its whole source.

    Null and empty pages have the empty text. Pages without a host stand for
    themselves. Repeated pages are extracted one by one. Other columns are not
    read.
    """
    given = with_host_path(pages.select("page_id", F.col(url).alias("url"), F.col(page).alias("html"))).drop("path")
    wrappers = written(infer_wrappers(given.filter("host != ''"))).select("host", "decision")
    kind = dict(given.dtypes)["page_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, decision = None, None
        for b in batches:
            texts = []
            for source, raw in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                if raw != at:
                    at, decision = raw, json.loads(raw) if raw else None
                texts.append(extract(source.as_py(), decision))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    joined = given.join(wrappers, "host", "left").select("page_id", "url", "html", "decision")
    return joined.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")
