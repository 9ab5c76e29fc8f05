"""Main text of web pages: what markup marks as other than the article goes, then what a page shares with its nearest pages.

Pages become lines, one for each block of text. What stands in menus, headers, footers, sidebars, notices, adverts, forms or
comments by its tag, role or class is no line. The rest is compared with the pages nearest by URL: pages are sorted by host and path
and numbered in one range partitioning, and each is aligned with the page before and the page after it on its host by the
longest common subsequence of lines. Only hashes of lines move for that. A line that the page shares with its nearest pages is part
of their template and is deleted, unless

* one of them is a near copy of the page (shared lines hold over half of either text): copies say nothing about a template;
* the page declares its article by a tag and the line is prose in it: then the markup has said what it is. Lines of links
  (share buttons, "read on" lists) in an article go."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, send_if_small
from .urlfilter import host_and_path

BLOCK = 1024  # pages by number in a group that is aligned in one task
DECLARED, LINKS = 1, 2  # marks of a line

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
RAW = {"script", "style", "textarea", "title", "xmp", "noscript", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img"}
OTHER = {"nav", "footer", "aside", "form", "dialog", "menu", "button", "select", "svg", "template", "head", "object", "canvas", "audio", "video", "map", "datalist", "fieldset"}
#: Elements that a page may wrap around its article by mistake: an article or main inside ends their effect.
LOOSE = {"nav", "footer", "form", "header", "menu", "fieldset", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
#: Words of a class or id that mark an element as no part of an article.
MARKS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "paywall", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "masthead", "topbar", "toolbar", "comments", "comment", "commentlist", "disqus", "replies", "respond", "share", "sharing", "social", "related", "recommended", "recommendations", "pagination", "pager", "widget", "copyright", "hidden", "skip"}
OUTSIDE = {"header", "search"}  # mark an element only outside an article
IN_HEAD = {"meta", "link", "base", "template"} | RAW
LISTED = {"li", "dt", "dd", "tr", "td", "th", "option"}
ENDS_P = {"p", "div", "ul", "ol", "dl", "table", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "figure", "hr", "nav", "aside", "footer", "header", "form"}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _marked(tag: str, raw: str, in_article: bool) -> bool:
    """Whether an element is no part of an article, by its attributes. article, main, body and html are never marked by a mere class."""
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), html.unescape(a or b or c)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return True
        if name == "role" and value.lower().strip() in ROLES:
            return True
        if name in ("class", "id") and tag not in ("main", "body", "html"):
            words = {w.lower() for w in _NAME.findall(_CAMEL.sub(" ", value))}
            if words & MARKS or (not in_article and words & OUTSIDE):
                return True
    return False


def lines_of(page: str) -> list[tuple[str, int]]:
    """The page's text blocks outside marked elements, in order, each with white space turned to one space, and its marks. If the
    page has article elements (else main) that are not marked, only theirs."""
    out: list[tuple[str, int, int]] = []  # text, marks, 0: elsewhere, 1: in main, 2: in article
    stack: list[tuple[str, bool]] = []  # open elements that matter; whether each is marked
    marked = n_article = n_main = n_link = 0
    text: list[str] = []
    linked = total = 0

    def flush() -> None:
        nonlocal linked, total
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                level = 2 if n_article else 1 if n_main else 0
                out.append((line, (DECLARED if level else 0) | (LINKS if 2 * linked > total else 0), level))
            text.clear()
        linked = total = 0

    def add(piece: str) -> None:
        nonlocal linked, total
        if not marked and piece:
            text.append(piece)
            n = len(piece.strip())
            total += n
            linked += n if n_link else 0

    def pop(to: int) -> None:
        nonlocal marked, n_article, n_main
        for tag, bad in stack[to:]:
            marked -= bad
            n_article -= tag == "article" and not bad
            n_main -= tag == "main" and not bad
        del stack[to:]

    at = 0
    while (m := _TOKEN.search(page, at)) is not None:
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        if m[1]:
            if tag == "a":
                n_link = 0
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i][0]
                if name == tag:
                    pop(i)
                    break
                # an end without a start does not reach over what holds it
                if (tag in INLINE or tag == "p") and name not in INLINE or name in ("article", "main") and tag not in ("article", "main", "body", "html"):
                    break
            continue
        if stack and stack[-1][0] == "head" and tag not in IN_HEAD:
            pop(len(stack) - 1)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = end.start() if end else len(page)
            continue
        if tag == "br":
            add(" ")
        if tag in VOID:
            continue
        if tag == "a":
            n_link = 1
        if tag in ENDS_P and stack and stack[-1][0] == "p" or tag in LISTED and stack and stack[-1][0] == tag:
            pop(len(stack) - 1)
        if tag in ("article", "main"):
            for i, (name, bad) in enumerate(stack):
                if bad and name in LOOSE:
                    marked -= 1
                    stack[i] = (name, False)
        inside = bool(n_article or n_main)
        bad = tag in OTHER or (tag == "header" and not inside) or (bool(m[3].strip()) and _marked(tag, m[3], inside))
        if tag not in INLINE or bad or (stack and stack[-1][0] in INLINE):
            stack.append((tag, bad))
            marked += bad
            n_article += tag == "article" and not bad
            n_main += tag == "main" and not bad
    rest = page[at:]
    cut = re.search(r"<[/!a-zA-Z][^>]*\Z", rest)
    add(rest[: cut.start()] if cut else rest)
    flush()
    level = max((x[2] for x in out), default=0)
    return [(line, marks) for line, marks, x in out if x == level]


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (i, j), rising in both, of a longest common subsequence.

    Equal ends are matched first and values of one side only are left out; the rest is by bit-parallel rows, one whole number each.
    Rows are kept at every root of n only and made again on the way back."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ends = [(i, i) for i in range(head)], [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    x = [i for i in range(head, len(a) - tail) if a[i] in both]
    y = [j for j in range(head, len(b) - tail) if b[j] in both]
    if not x:
        return ends[0] + ends[1]
    full, masks = (1 << len(y)) - 1, {}
    for k, j in enumerate(y):
        masks[b[j]] = masks.get(b[j], 0) | 1 << k

    def after(v: int, i: int) -> int:
        u = v & masks[a[x[i]]]
        return ((v + u) | (v - u)) & full

    step = max(1, math.isqrt(len(x)))
    marks, v = [full], full
    for i in range(len(x)):
        v = after(v, i)
        if (i + 1) % step == 0:
            marks.append(v)
    found, row, col = [], len(x), len(y)
    base, rows = -1, []
    while row and col:
        if (row - 1) // step != base:
            base = (row - 1) // step
            rows = [marks[base]]
            for i in range(base * step, min(len(x), (base + 1) * step)):
                rows.append(after(rows[-1], i))
        if rows[row - base * step] >> (col - 1) & 1:
            col -= 1
        else:
            row -= 1
            if row == 0 or rows[row - base * step] >> (col - 1) & 1:
                col -= 1
                found.append((x[row], y[col]))
    return ends[0] + found[::-1] + ends[1]


LINES = ["lines", "marks", "hashes", "sizes"]


def _lines(pages: pa.Array) -> list[pa.Array]:
    """LINES of each page."""
    found = [lines_of(x or "") for x in pages.to_pylist()]
    hashes = [[xxhash.xxh3_64_intdigest(x.encode()) - (1 << 63) for x, _ in page] for page in found]
    columns = [[x for x, _ in page] for page in found], [[m for _, m in page] for page in found], hashes, [[len(x) for x, _ in page] for page in found]
    return [pa.array(c, pa.list_(kind)) for c, kind in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int32()))]


def _template(table: pa.Table, block: range, copy: float) -> tuple[list[int], list[list[int]]]:
    """Rows of a block, and the places of the lines that each shares with its nearest pages; table has the pages next to the block too."""
    t = table.sort_by("at").to_pydict()
    n = len(t["at"])
    shared: list[list[set[int]]] = [[] for _ in range(n)]
    for k in range(n - 1):
        if t["host"][k] != t["host"][k + 1] or t["at"][k] + 1 != t["at"][k + 1]:
            continue
        pairs = common(t["hashes"][k], t["hashes"][k + 1])
        size = sum(t["sizes"][k][i] for i, _ in pairs)
        if size > copy * min(sum(t["sizes"][k]), sum(t["sizes"][k + 1])):
            continue
        shared[k].append({i for i, _ in pairs})
        shared[k + 1].append({j for _, j in pairs})
    rows, gone = [], []
    for k in range(n):
        if t["at"][k] not in block or not shared[k]:
            continue
        places = [i for i in sorted(set.intersection(*shared[k])) if t["marks"][k][i] != DECLARED]
        if places:
            rows.append(t["row"][k])
            gone.append(places)
    return rows, gone


def shared_lines(lines: DataFrame, copy: float = 0.8) -> DataFrame:
    """row and gone, the places of lines to delete, of written lines (row, host, path, hashes, sizes, marks); only rows that lose some."""
    order = ["host", "path", "row"]
    keys = lines.where("host <> '' AND size(hashes) > 0").select(*order, "hashes", "sizes", "marks").repartitionByRange(*order).sortWithinPartitions(*order)
    keys = materialize(keys.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("turn")), "page-order")
    # a row for each partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = keys.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))
    keys = keys.join(F.broadcast(offsets), "part").withColumn("at", F.col("before") + F.col("turn"))
    own, place = F.expr(f"at div {BLOCK}"), F.col("at") % BLOCK
    blocks = F.filter(F.array(own, F.when(place == 0, own - 1), F.when(place == BLOCK - 1, own + 1)), lambda x: x.isNotNull())
    size = BLOCK
    dealt = keys.select(F.explode(blocks).alias("block"), "at", "row", "host", "hashes", "sizes", "marks")

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        first = key[0].as_py() * size
        rows, gone = _template(table, range(first, first + size), copy)
        return pa.table({"row": pa.array(rows, pa.int64()), "gone": pa.array(gone, pa.list_(pa.int32()))})

    return dealt.groupBy("block").applyInArrow(compare, "row long, gone array<int>")


def main_text(pages: DataFrame, copy: float = 0.8, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages' columns but the html, with text and n_chars in place of columns of those names: lines joined by one line feed, and their code points.

    A page's nearest pages are those before and after it on its host, by path and then by its place in the input. Lines that it shares
    with both (with one, if the other is of another host or a near copy) are deleted by the rule above. Null pages are empty; pages without a host
    are compared with none; repeated pages are near copies, so they lose nothing to each other; an empty table gives an empty result."""
    own = [f for f in pages.schema if f.name not in ("text", "n_chars")]
    host, path = host_and_path(F.col("_url"))
    flat = pages.select(F.monotonically_increasing_id().alias("row"), F.struct(*(pages[f"`{f.name}`"] for f in own if f.name != html_col)).alias("own"), pages[f"`{url_col}`"].alias("_url"), pages[f"`{html_col}`"].alias("html"))
    flat = flat.select("row", "own", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "html")
    kinds = f"own {flat.schema['own'].dataType.simpleString()}, host string, path string"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "own", "host", "path")), *_lines(part.column("html"))], ["row", "own", "host", "path", *LINES])

    lines = materialize(flat.mapInArrow(extract, f"row long, {kinds}, lines array<string>, marks array<int>, hashes array<long>, sizes array<int>"), "page-lines")
    gone = send_if_small(materialize(shared_lines(lines, copy), "page-shared"), row_bytes=200)
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.array_contains("gone", i)))
    text = lines.join(gone, "row", "left").select("own", F.array_join(left, "\n").alias("text"))
    back = [F.col("own").getField(f.name).alias(f.name) for f in own if f.name != html_col]
    return text.select(*back, "text", F.length("text").cast("long").alias("n_chars"))


def digests(pages: DataFrame) -> DataFrame:
    return main_text(pages.select("page_id", "url", "html"))
