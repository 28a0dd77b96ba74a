"""Main text of web pages by nearest-URL page differencing.

A page is read into lines, one per block element. Elements that never hold the article (menus, footers, forms, scripts,
adverts by class, reader comments and so on) give none. Pages of a host stand in order of their URL paths, and each is
aligned with its neighbours by the longest common subsequence of their lines; lines they share are the site's, not the page's, and
are deleted. Pages with equal lines that stand together are copies: they are aligned with the nearest pages that differ, not with each other.
Lines inside ``article`` or ``main`` are the page's own even if another page repeats them.

Pages are dealt to blocks of neighbouring paths, with bounds from a bounded sample of URLs, so that a host with many pages
is spread. A block's first and last run have their other neighbour in another block; a copy of that page is sent along, so blocks change no text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?>[^<>\"']*(?:\"[^\"]*\"[^<>\"']*|'[^']*'[^<>\"']*)*)|[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements whose content is not markup, and those that never hold an article.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
NEVER = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "noscript", "template", "svg", "canvas", "object", "audio", "video", "header"}
BLOCKS = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html",
          "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", *NEVER}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Words in a class or id, and roles, that mark what is not the article.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "sidebar", "nav",
         "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "comment", "comments", "reply", "replies", "respond", "disqus", "newsletter", "subscribe", "signup", "login", "popup", "modal",
         "overlay", "share", "sharing", "social", "related", "widget", "masthead", "topbar", "pagination", "pager", "skip"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
DROP, OPEN, OWN = 0, 1, 2


def marked(attributes: str) -> bool:
    for m in ATTRIBUTE.finditer(attributes):
        words = set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[2] or m[3] or m[4] or "").lower()))
        if words & (ROLES if m[1].lower() == "role" else MARKS):
            return True
    return False


def read(html: str | None) -> list[tuple[int, str]]:
    """Lines as (zone, text) in page order; zone is OWN inside an article, else OPEN. A cut-off page is read as far as it goes."""
    html = html or ""
    lines: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    words: list[str] = []
    zone, at = OPEN, 0

    def flush() -> None:
        line = " ".join(unescape("".join(words)).split())
        if line:
            lines.append((zone, line))
        words.clear()

    while True:
        m = TAG.search(html, at)
        if zone != DROP:
            words.append(html[at:m.start() if m else len(html)])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag closes its element and what is open inside; articles are not closed from within
            if tag in BLOCKS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    zone = stack[-1][1] if stack else OPEN
                    break
                if stack[k][0] in ("article", "main", "body", "td", "th") and tag not in ("article", "main", "body", "html", "table", "tr"):
                    break
            continue
        if tag in BLOCKS:
            flush()
            if stack and stack[-1][0] == "p":
                stack.pop()
                zone = stack[-1][1] if stack else OPEN
        elif tag == "br":
            words.append(" " if zone != DROP else "")
        if tag == "body":
            stack, zone = [s for s in stack if s[0] != "head"], OPEN
        if tag in RAW:
            end = re.compile(rf"</{tag}[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        inside = zone
        if tag in NEVER and not (tag == "header" and zone == OWN):
            zone = DROP
        elif tag not in ("html", "body", "main") and marked(m[3]):
            zone = DROP
        elif tag in ("article", "main") and (zone != DROP or not any(s[0] in NEVER for s in stack)) and not (tag == "article" and any(s[0] in ("article", "main") and s[1] == DROP for s in stack)):
            zone = OWN  # also inside an element that only its class marks
        if tag in BLOCKS or zone != inside:
            stack.append((tag, zone))
    flush()
    return lines


def shared(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of a longest common subsequence with b: equal ends first, then the shortest chains of matches (Hunt and Szymanski)."""
    lo, hi_a, hi_b = 0, len(a), len(b)
    while lo < min(hi_a, hi_b) and a[lo] == b[lo]:
        lo += 1
    while min(hi_a, hi_b) > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
    found = {*range(lo), *range(hi_a, len(a))}
    where: dict[str, list[int]] = {}
    for j in range(lo, hi_b):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    tails: list[tuple | None] = []
    for i in range(lo, hi_a):
        for j in reversed(where.get(a[i], ())):
            k = bisect_left(ends, j)
            link = (i, tails[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                tails.append(link)
            elif ends[k] != j:
                ends[k], tails[k] = j, link
    link = tails[-1] if tails else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def place(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; numbers in the path are padded, so that they sort by value."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)(?::[0-9]*)?([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", url or "")
    return host, re.sub(r"[0-9]+", lambda d: d[0].zfill(12), path.rstrip("/"))


def _key(url: str | None, page_id: int | None) -> str:
    host, path = place(url)
    return f"{host}\x01{path}\x01{(page_id if page_id is not None else -1) + (1 << 63):020d}"


def own_text(lines: list[tuple[int, str]], *neighbours: list[tuple[int, str]]) -> str:
    here = [t for _, t in lines]
    gone: set[int] = set()
    if any(z == OPEN for z, _ in lines):
        for other in neighbours:
            gone |= shared(here, [t for _, t in other])
    return "\n".join(t for i, (z, t) in enumerate(lines) if z == OWN or i not in gone)


def _placed(url: str | None, page_id: int | None, lines: list[tuple[int, str]]) -> str:
    """A page's place among all pages; pages of one place have equal lines, so their order is nothing to a neighbour."""
    digest = blake2b("\n".join(t for _, t in lines).encode(), digest_size=16).hexdigest()
    return f"{_key(url, page_id)}\x01{digest}"


def _host(place: str) -> str:
    return place.split("\x01")[0]


def _same_run(a: str, b: str) -> bool:
    return _host(a) == _host(b) and a[-32:] == b[-32:]


def _beyond(edges: list[tuple[int, str, str | None, str, str | None]]) -> list[tuple[str, int]]:
    """Places of the pages that stand before the first run of a block, in the same host, with the block: going through the blocks in order.

    An edge is (block, a place in its first run, in the run after it, in its last run, in the run before that), runs of other hosts being null.
    """
    out, last, before = [], None, None
    for block, first, _, end, inside in edges:
        other = None
        if last is not None and _host(last) == _host(first):
            other = before if _same_run(last, first) else last
        if other is not None:
            out.append((other, block))
        before = inside if inside is not None else other if _same_run(first, end) else None
        last = end
    return out


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", sample: int = 20_000, least: int = 50) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. Null or empty html gives an empty text; a page without a neighbour keeps its lines.

    A null URL counts as a host of its own. Copies keep the same text; if a host's pages are all equal, they keep their lines. ``sample``
    bounds the URLs that set the blocks, ``least`` is the pages a block should have; neither changes a text. Pages are parsed twice, first to find
    what stands beside each block. Other columns are not read.
    """
    spark = pages.sparkSession
    src = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    total = src.count()
    n = max(1, min(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // least))
    some = src.select("page_id", "url").sample(min(1.0, sample / max(1, total)), 1).collect()
    keys = sorted(_key(r["url"], r["page_id"]) for r in some)
    bounds = sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = [_placed(u, i, read(h.as_py())) for i, u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))]
            yield pa.RecordBatch.from_arrays([pa.array([bisect_right(bounds, k) for k in order], pa.int32()), pa.array(order, pa.string())], ["block", "place"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b, p) for batch in batches for b, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for block, some in groupby(rows, key=lambda r: r[0]):
            first = second = end = inside = None
            alone = True
            for _, here in some:
                if end is None:
                    first = here
                elif not _same_run(end, here):
                    if alone:
                        second = here if _host(here) == _host(first) else None
                        alone = False
                    inside = end if _host(here) == _host(end) else None
                end = here
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([v], pa.string()) for v in (first, second, end, inside))], ["block", "first", "second", "last", "inside"])

    # one row per block comes to the driver: the places of its outer runs
    guests: dict[str, list[int]] = {}
    if bounds:
        placed = src.mapInArrow(places, "block int, place string").repartition(n, "block").sortWithinPartitions("block", "place")
        outer = sorted(tuple(r) for r in placed.mapInArrow(edges, "block int, first string, second string, last string, inside string").collect())
        for page, block in _beyond(outer) + _beyond([(b, end, inside, first, second) for b, first, second, end, inside in reversed(outer)]):
            guests.setdefault(page, []).append(block)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[str] = set()
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                ids, urls = part.column(0).to_pylist(), part.column(1).to_pylist()
                lines = [read(h.as_py()) for h in part.column(2)]
                order = [_placed(u, i, x) for i, u, x in zip(ids, urls, lines)]
                block, at, guest = [bisect_right(bounds, k) for k in order], list(range(len(order))), [False] * len(order)
                for k, page in enumerate(order):
                    if page in guests and page not in sent:
                        sent.add(page)
                        block += guests[page]
                        at += [k] * len(guests[page])
                        guest += [True] * len(guests[page])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int32())), part.column(1).take(pa.array(at, pa.int32())), pa.array(block, pa.int32()), pa.array([order[k] for k in at], pa.string()),
                                                  pa.array([[z for z, _ in lines[k]] for k in at], pa.list_(pa.int8())), pa.array([[t for _, t in lines[k]] for k in at], pa.list_(pa.string())), pa.array(guest, pa.bool_())],
                                                 ["page_id", "url", "block", "place", "zones", "lines", "guest"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for b in batches:
                for start in range(0, b.num_rows, 64):
                    for r in b.slice(start, 64).to_pylist():
                        yield (r["block"], _host(r["place"])), r["page_id"], r["url"], list(zip(r["zones"], r["lines"])), r["guest"]
            yield None, None, None, None, True

        # pages with equal lines that stand together are one run: all have the same neighbours, the runs beside it
        before = here = None
        run: list[tuple] = []
        out: list[list] = [[], [], [], []]
        for after in stream():
            if here is not None and (after[0] != here[0] or [t for _, t in after[3]] != [t for _, t in here[3]]):
                beside = [x[3] for x in (before, after) if x is not None and x[0] == here[0]]
                texts: dict[tuple, str] = {}
                for page_id, url, zones in run:
                    if zones not in texts:
                        texts[zones] = own_text([(z, t) for z, (_, t) in zip(zones, here[3])], *beside)
                    text = texts[zones]
                    for c, v in zip(out, (page_id, url, text, len(text))):
                        c.append(v)
                    if len(out[0]) >= 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, TYPES)], NAMES)
                        out = [[], [], [], []]
                before, run = here, []
            here = after
            if not after[4]:
                run.append((after[1], after[2], tuple(z for z, _ in after[3])))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, TYPES)], NAMES)

    lines = src.mapInArrow(extract, "page_id long, url string, block int, place string, zones array<tinyint>, lines array<string>, guest boolean")
    near = lines.repartition(n, "block").sortWithinPartitions("block", "place")
    return near.mapInArrow(compare, "page_id long, url string, text string, n_chars long")


NAMES = ["page_id", "url", "text", "n_chars"]
TYPES = (pa.int64(), pa.string(), pa.string(), pa.int64())
