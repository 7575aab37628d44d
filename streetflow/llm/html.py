"""Main text of web pages by nearest-URL page differencing, with markup as the hint that aligns boilerplate.

1. Pages are sorted by (host, path, id, URL, page) and dealt by ranges of that order, so a host of any size spreads over
   many tasks. A page's partner is whichever neighbour within the same host shares the longer path prefix (the earlier one
   on a tie). The first and the last two pages of each range also go on in a table of their own, at most four rows per
   range, in which the pages at the edges find their neighbours beyond; so the partner does not depend on the ranges.
2. A page becomes text lines, one per block element, with character references decoded and white space collapsed. Lines
   of menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are marked as
   boilerplate. Each line also knows whether an article or main element encloses it.
3. The lines of page and partner are aligned by longest common subsequence; marked lines align by the kind of their
   block, for their words differ from page to page. Shared lines are deleted, and marked ones that no partner confirms go
   as well. Lines inside an article or main element are the page's own text even if a copy of it stands next door, so
   they stay unless they consist of links alone; where such an element has text, other lines go.

A page without a partner on its host keeps its unmarked lines. Nulls: null html is empty and gives an empty text; a null
URL is an empty one; a null id is kept. Ties in the order are equal pages. Repeated rows each get a row. An empty table
gives no rows. Very long pages are read in one pass and aligned in memory linear in their lines. Only the id, URL and html
columns are read, whatever others are called.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

# Element names.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template textarea title svg iframe object select xmp".split())
SKIP = {"nav": "menu", "menu": "menu", "footer": "footer", "aside": "sidebar", "form": "form", "head": "head", "button": "form",
        "dialog": "notice"}
MAIN = frozenset(["article", "main"])
MARKABLE = frozenset("div section header ul ol li p span table figure details h2 h3 h4 h5 h6 dl body".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of class, id and role that mark boilerplate.
MARKS = [
    ("advert", "ad ads adv advert adverts advertisement advertising adsense banner promo promoted sponsor sponsored"),
    ("menu", "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager"),
    ("header", "header masthead topbar"),
    ("footer", "footer copyright colophon contentinfo"),
    ("sidebar", "sidebar aside related recommended widget share sharing social complementary"),
    ("notice", "cookie cookies consent gdpr notice notices disclaimer popup modal newsletter subscribe alert"),
    ("comments", "comment comments respond replies disqus"),
    ("form", "form search login signup"),
]
NEGATED = frozenset(["has", "no", "not", "with", "without", "is"])
MARK_OF = {w: kind for kind, words in MARKS for w in words.split()}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")


def _mark(name: str, attrs: str, in_main: bool) -> str | None:
    """The kind of boilerplate that an element opens."""
    if name in SKIP:
        return SKIP[name]
    if name == "header":
        return None if in_main else "header"
    if attrs and name not in ("html", "body", "main"):
        for m in NAMED.finditer(attrs):
            for word in next(x for x in m.groups() if x is not None).lower().split():
                parts = re.split("[-_]+", word)
                # A wrapper that says what it has or lacks is not the thing itself.
                if parts[0] in NEGATED:
                    continue
                kind = next((MARK_OF[x] for x in parts if x in MARK_OF), None)
                if kind is None or (kind == "header" and in_main) or (name == "article" and kind not in ("comments", "advert")):
                    continue
                return kind
    return None


def lines_of(page: str | None) -> list[tuple[str, str | None, bool, bool]]:
    """(text, kind of boilerplate or None, inside article or main, links only) of each block with text."""
    if not page:
        return []
    out, words, linked, plain = [], [], False, False
    stack: list[tuple[str, str | None, bool]] = []  # open containers: name, kind, main
    kind, main, anchors, at = None, False, 0, 0

    def flush():
        nonlocal words, linked, plain
        if words:
            text = SPACE.sub(" ", entities.unescape("".join(words))).strip()
            if text:
                out.append((text, kind, main, linked and not plain))
            words, linked, plain = [], False, False

    def add(text):
        nonlocal linked, plain
        if text:
            words.append(text)
            if not text.isspace():
                linked, plain = linked or anchors > 0, plain or anchors == 0

    closes = None
    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at, name = m.end(), m[2]
        if name is None:
            continue
        name, closing = name.lower(), bool(m[1])
        if name in BLOCKS:
            flush()
        if closing:
            if name == "a":
                anchors = max(0, anchors - 1)
            elif any(x[0] == name for x in stack):
                while stack:
                    top = stack.pop()
                    if top[0] == name:
                        break
                kind, main = (stack[-1][1], stack[-1][2]) if stack else (None, False)
            continue
        if name in BLOCKS and name != "br" and stack and stack[-1][0] == "p":
            # Paragraphs are often left open; the next block closes the last.
            while stack and stack[-1][0] == "p":
                stack.pop()
            kind, main = (stack[-1][1], stack[-1][2]) if stack else (None, False)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page) if name in ("script", "style") else at
            continue
        if name == "a":
            anchors += 1
        elif name not in VOID and (name in MAIN or name in SKIP or name in MARKABLE):
            found = _mark(name, m[3], main)
            if found and kind is None and name != "p":
                if closes is None:
                    closes = set(x.lower() for x in re.findall(r"</([a-zA-Z][^\s>]*)", page))
                found = found if name in closes else None
            if name != "span" or found:
                flush()
                kind, main = kind or found, main or name in MAIN
                stack.append((name, kind, main))
    flush()
    return out


def common(a: list, b: list) -> list[bool]:
    """Which items of a a longest common subsequence of a and b contains."""
    n, keep = len(a), [False] * len(a)
    low = 0
    while low < min(n, len(b)) and a[low] == b[low]:
        keep[low] = True
        low += 1
    high = 0
    while high < min(n, len(b)) - low and a[n - 1 - high] == b[len(b) - 1 - high]:
        keep[n - 1 - high] = True
        high += 1
    x, y = a[low : n - high], b[low : len(b) - high]
    # Items that only one side has cannot be shared.
    has_x, has_y = set(x), set(y)
    places, x = [i + low for i, v in enumerate(x) if v in has_y], [v for v in x if v in has_y]
    y = [v for v in y if v in has_x]
    if x and y:
        for i in _hirschberg(x, y):
            keep[places[i]] = True
    return keep


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Longest common subsequence of x with each prefix of y, in memory linear in y."""
    row = np.zeros(len(y) + 1, np.int32)
    for v in x:
        best = np.maximum(row[1:], np.where(y == v, row[:-1] + 1, 0))
        row[1:] = np.maximum.accumulate(best)
    return row


def _hirschberg(x: list, y: list) -> list[int]:
    ids = {v: i for i, v in enumerate(dict.fromkeys(chain(x, y)))}
    p, q = np.array([ids[v] for v in x]), np.array([ids[v] for v in y])
    out, todo = [], [(0, len(p), 0, len(q))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if b - a == 1:
            if (q[c:d] == p[a]).any():
                out.append(a)
            continue
        mid = (a + b) // 2
        first = _lengths(p[a:mid], q[c:d])
        second = _lengths(p[mid:b][::-1], q[c:d][::-1])[::-1]
        cut = c + int(np.argmax(first + second))
        todo += [(a, mid, c, cut), (mid, b, cut, d)]
    return out


def _key(line) -> str:
    return f"\0{line[1]}" if line[1] else line[0]


def main_text(lines: list, partner: list | None) -> str:
    """The lines of a page that stay, one per row of the text."""
    shared = common([_key(x) for x in lines], [_key(x) for x in partner]) if partner else [False] * len(lines)
    marked = any(x[2] and not x[1] for x in lines)
    out = []
    for line, both in zip(lines, shared):
        if line[1] or (marked and not line[2]):
            continue
        if both and not (line[2] and not line[3]):
            continue
        out.append(line[0])
    return "\n".join(out)


def _closeness(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and path of a URL; empty and ``/`` where there is none."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    host = F.lower(F.regexp_extract(rest, r"^//([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^(?://[^/?#]*)?([^?#]*)", 1)
    return host, F.when(path == "", F.lit("/")).otherwise(path)


#: Ranges per shuffle partition, and sampled rows per range, from which the bounds come.
RANGES, SAMPLED = 8, 4
PAGE = ("page_id", "url", "host", "path", "digest", "html")


def _texts(pages: list[tuple]) -> Iterator[tuple]:
    """(page, text) of consecutive pages but the first and the last; a page is None or (host, path, lines, ...)."""
    for before, now, after in zip(pages, pages[1:], pages[2:]):
        mates = [x for x in (before, after) if x is not None and x[0] == now[0]]
        mate = max(mates, key=lambda x: _closeness(x[1], now[1]), default=None)
        yield now, main_text(now[2], mate and mate[2])


def _inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """page_id, url, text of all pages of the ranges but their first and last ones. Three pages are held at a time."""
    seen, number = [], None
    for b in batches:
        rows = []
        for n, i, url, host, path, page in zip(b.range_no, b.page_id, b.url, b.host, b.path, b.html):
            if n != number:
                seen, number = [], n
            seen = [*seen[-2:], (host, path, lines_of(page), i, url)]
            rows += [(now[3], now[4], text) for now, text in _texts(seen)]
        if rows:
            yield pd.DataFrame(rows, columns=["page_id", "url", "text"], dtype=object).astype({"page_id": "Int64"})


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first and the last two pages of each range; ``edge`` marks the very first and last."""

    def frame(held):
        out = [[*row, at in (0, len(held) - 1)] for at, row in enumerate(held)]
        return pd.DataFrame(out, columns=[*PAGE, "edge"], dtype=object).astype({"page_id": "Int64", "digest": "Int64"})

    held, number = [], None
    for b in batches:
        for n, *row in zip(b.range_no, *(b[c] for c in PAGE)):
            if n != number and held:
                yield frame(held)
                held = []
            number = n
            # Beyond four, a new last page takes the place of the last but one.
            held = [*held[:2], held[3], row] if len(held) == 4 else [*held, row]
    if held:
        yield frame(held)


@F.pandas_udf(T.StringType())
def _edge_text(host: pd.Series, path: pd.Series, html: pd.Series, beside: pd.DataFrame) -> pd.Series:
    out = []
    for h, p, page, (bh, bp, b, ah, ap, a) in zip(host, path, html, beside.itertuples(index=False)):
        before, after = (None if x is None else (x, y, lines_of(z)) for x, y, z in ((bh, bp, b), (ah, ap, a)))
        out += [text for _, text in _texts([before, (h, p, lines_of(page)), after])]
    return pd.Series(out, dtype=object)


def _bounds(rows: DataFrame, ranges: int) -> list[tuple]:
    """(host, path, id) that divide the pages into about as many ranges, from a sample; any bounds give the same texts."""
    keys = rows.select("host", "path", "page_id")
    n = keys.count()
    if n <= 2 * ranges or ranges < 2:
        return []
    some = keys.sample(min(1.0, SAMPLED * ranges / n), seed=1).collect()
    some = sorted((r.host, r.path, -(1 << 63) if r.page_id is None else r.page_id) for r in some)
    return sorted({some[len(some) * k // ranges] for k in range(1, ranges)}) if some else []


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text for every row of pages."""
    host, path = host_path(F.col(url_col))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"),
        F.xxhash64(html_col).alias("digest"), F.col(html_col).alias("html"),
    )
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(rows, RANGES * parts)

    @F.pandas_udf(T.IntegerType())
    def range_no(hosts: pd.Series, paths: pd.Series, ids: pd.Series) -> pd.Series:
        ids = ids.astype(object).where(ids.notna(), -(1 << 63))
        return pd.Series([bisect_right(bounds, x) for x in zip(hosts, paths, ids)], dtype="int32")

    order = ["host", "path", "page_id", "url", "digest"]
    dealt = rows.withColumn("range_no", range_no("host", "path", "page_id")).repartition(parts, "range_no")
    dealt = dealt.sortWithinPartitions("range_no", *order)
    inner = dealt.mapInPandas(_inner, "page_id long, url string, text string")
    page = "page_id long, url string, host string, path string, digest long, html string, edge boolean"
    # Both reads of the dealt pages share one shuffle. At most four pages per range, whatever a host has.
    ends = dealt.mapInPandas(_ends, page)
    by = W.partitionBy("host").orderBy(*order)
    names = [(f, n, c) for f, n in ((F.lag, "before"), (F.lead, "after")) for c in ("host", "path", "html")]
    sides = ends.select("*", *(f(c).over(by).alias(f"{n}_{c}") for f, n, c in names)).where("edge")
    beside = F.struct(*(f"{n}_{c}" for _, n, c in names))
    return inner.union(sides.select("page_id", "url", _edge_text("host", "path", "html", beside).alias("text")))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))
