"""Main text of web pages by differencing pages with neighbouring URLs.

Pages are ordered by host and path; a page is paired with the neighbours before and after it on its host, of which the one that shares more of
the path is the nearer.  Text lines (blocks) of the two are aligned by their longest common subsequence, and shared lines are deleted as
template.

A copy of a page (the same blocks under another URL of the host) tells nothing about the template, so copies are one page when neighbours are sought.

Differencing alone is not enough where the template's words change from page to page, and too much where two articles share a line.  So the
page's own marks are respected: blocks inside an ``article`` or ``main`` element are never deleted for being shared, and what
is marked as something else than text (menus, footers, forms, adverts, comments...) never counts as text.  Differencing decides
on all other blocks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.common import ROWS_AT_ONCE, kind, map_batches, settle
from barflow.llm.url_rules import host_of, path_of

# Elements whose content is not text of the page, by name, by role, and by words in class or id.
_DROPPED = {
    "nav", "footer", "header", "aside", "form", "script", "style", "template", "noscript", "svg", "iframe", "object", "button", "select", "textarea", "menu", "dialog", "head", "title",
}
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|nav|navbar|navigation|newsletter|notices?|"
    r"pagination|popup|promo|promoted|related|replies|reply|respond|share|sharing|sidebar|social|sponsor(?:ed)?|subscribe|toolbar|widget)(?:$|[\s_-])", re.I,
)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small",
    "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_MAIN = {"article", "main"}
# Elements that an opening tag ends when they are open: the tag, and what it ends up to the nearest of the last set.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(?:!|\?)[^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")

PLAIN, MAIN = 0, 1


def _is_dropped(name: str, attributes: str) -> bool:
    if name in _DROPPED:
        return True
    if name in ("body", "html") or not attributes.strip():
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in _ROLES:
            return True
        if key in ("class", "id") and name not in _MAIN and _WORDS.search(value):
            return True
    return False


def blocks(page: str) -> list[tuple[int, str]]:
    """(PLAIN or MAIN, text) of every block that no mark rules out, in page order; white space is one blank, references are decoded."""
    out: list[tuple[int, str]] = []
    stack: list[str] = []  # open elements that matter: block elements
    dropped = main = 0  # depth in the stack (1-based) of the outermost dropped element; open main elements
    parts: list[str] = []
    at = 0

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((MAIN if main else PLAIN, text))
            parts.clear()

    def close(depth: int) -> None:
        nonlocal dropped, main
        for name in stack[depth:]:
            main -= name in _MAIN
        del stack[depth:]
        if dropped > depth:
            dropped = 0

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at and not dropped:
            parts.append(page[at:end])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in _INLINE:
                if dropped and name in stack:
                    close(len(stack) - 1 - stack[::-1].index(name))
                continue
            if not dropped:
                flush()
            if name in stack:
                if not dropped:
                    flush()
                close(len(stack) - 1 - stack[::-1].index(name))
            continue
        drops = _is_dropped(name, m[3])
        if name in _INLINE and not drops:
            if name == "br" and not dropped:
                parts.append("\n")
            continue
        if not dropped:
            flush()
        if name in _VOID:
            continue
        if name in _ENDS and not dropped:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] in _ENDS[name]:
                    close(i)
                    break
                if stack[i] in ("ul", "ol", "dl", "table", "select"):
                    break
        if m[3].rstrip().endswith("/") and name in ("svg", "iframe", "script"):
            continue
        stack.append(name)
        main += name in _MAIN
        if drops and not dropped:
            dropped = len(stack)
        if name in _RAW:  # markup inside is not parsed
            stop = re.compile(f"</{re.escape(name)}[^>]*>", re.I).search(page, at)
            close(len(stack) - 1)
            at = stop.end() if stop else n
    if not dropped:
        flush()
    return out


def shared_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b`` (bit-parallel rows, then one walk back)."""
    lo, n, m = 0, len(a), len(b)
    while lo < min(n, m) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(n, m) - lo and a[n - 1 - hi] == b[m - 1 - hi]:
        hi += 1
    found = {*range(lo), *range(n - hi, n)}
    x, y = a[lo : n - hi], b[lo : m - hi]
    if not x or not y:
        return found
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    row, rows = full, [full]  # a zero bit j: the length grows at j
    for v in x:
        hit = row & where.get(v, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    i, j = len(x), len(y)
    while i and j:
        length = j - (rows[i] & ((1 << j) - 1)).bit_count()
        above = j - (rows[i - 1] & ((1 << j) - 1)).bit_count()
        if above == length:
            i -= 1
        elif j - 1 - (rows[i] & ((1 << (j - 1)) - 1)).bit_count() == length:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.add(lo + i)
    return found


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def shared_with_neighbour(keyed: DataFrame) -> DataFrame:
    """``key, gone``: places of the blocks that a page shares with its nearest neighbour that is no copy of it, for pages that share any.

    ``keyed`` has ``key, host, path, seq, main, places, lines`` (hash of all blocks, whether any is marked as main text, hashes of unmarked blocks and where they
    stand).  Pages of one ``seq`` on a host are copies and count as one, the first.  Without any other page on the host, copies lose
    their unmarked blocks only if they have main text.  Only hashes are ordered: in ranges of
    (host, path), so a hot host is many partitions, joined over the cuts by the first and last page of each.
    """
    order = ["host", "path", "key"]
    size = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pages = settle(keyed, "pages")
    ones = pages.groupBy("host", "seq").agg(F.min(F.struct("path", "key")).alias("at"), (F.min("key") != F.max("key")).alias("copied"), F.max("main").alias("main"), F.first("lines").alias("lines"))
    ones = ones.select("host", "at.path", "at.key", "seq", (F.col("copied") & F.col("main")).alias("alone"), "lines")
    ordered = settle(ones.repartitionByRange(size, *order).withColumn("part", F.spark_partition_id()), "lines")
    edges = ordered.groupBy("part").agg(F.min(F.struct(*order, "lines")).alias("first"), F.max(F.struct(*order, "lines")).alias("last"))
    by = Window.orderBy("part")  # a row for each partition
    around = edges.select("part", F.lag("last").over(by).alias("before"), F.lead("first").over(by).alias("after"))
    rows = ordered.join(around, "part").repartition("part").sortWithinPartitions("part", *order)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous = waiting = None

        def gone(row, before, after) -> list[int]:
            near = max((x for x in (before, after) if x is not None and x["host"] == row["host"]), key=lambda x: _common(x["path"], row["path"]), default=None)
            if near is None:
                return [*range(len(row["lines"]))] if row["alone"] else []
            return sorted(shared_lines(row["lines"], near["lines"])) if row["lines"] and near["lines"] else []

        def rows_of(found) -> pa.RecordBatch:
            found = [(r["host"], r["seq"], g) for r, g in found if g]
            types = [pa.string(), pa.int64(), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(types)], ["host", "seq", "gone"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                found = []
                for row in batch.slice(at, ROWS_AT_ONCE).to_pylist():
                    if waiting is not None:
                        same = waiting["part"] == row["part"]
                        found.append((waiting, gone(waiting, previous or waiting["before"], row if same else waiting["after"])))
                        previous = waiting if same else None
                    waiting = row
                yield rows_of(found)
        if waiting is not None:
            yield rows_of([(waiting, gone(waiting, previous or waiting["before"], waiting["after"]))])

    gone_of = settle(rows.mapInArrow(compare, "host string, seq bigint, gone array<int>"), "gone")
    return pages.join(gone_of, ["host", "seq"]).select("key", F.transform("gone", lambda i: F.get("places", i)).alias("gone"))


def extract(pages: DataFrame, keep: list[str] | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``keep`` (default: all columns but the html) and ``text`` of every page: blocks joined by line feeds, empty if none is left.

    Null html is empty; a null URL has empty host and path and is paired with such pages.  Repeated rows are one page, and pages of the same blocks on one
    host are compared as one.  A page alone on its host keeps all blocks that no mark rules out.  A column ``text`` of the input is replaced.
    """
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("text", html_col)]
    page, url = F.coalesce(html_col, F.lit("")), F.coalesce(url_col, F.lit(""))
    key = F.xxhash64(url, page)

    def read_lines(batch: pa.RecordBatch) -> pa.RecordBatch:
        all_of = [blocks(x) for x in batch.column(3).to_pylist()]
        plain = [[(i, t) for i, (k, t) in enumerate(x) if k == PLAIN] for x in all_of]
        seq = pa.array([xxhash.xxh64_intdigest("\n".join(f"{k}{t}" for k, t in x).encode()) - 2**63 for x in all_of], pa.int64())
        main = pa.array([any(k == MAIN for k, _ in x) for x in all_of], pa.bool_())
        places = pa.array([[i for i, _ in x] for x in plain], pa.list_(pa.int32()))
        lines = pa.array([[xxhash.xxh64_intdigest(t.encode()) - 2**63 for _, t in x] for x in plain], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], seq, main, places, lines], ["key", "host", "path", "seq", "main", "places", "lines"])

    def read_texts(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [[t for _, t in blocks(x)] for x in batch.column(len(keep) + 1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.list_(pa.string()))], [*keep, "_key", "_texts"])

    keyed = map_batches(
        pages.select(key.alias("key"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), page.alias("html")),
        read_lines, "key bigint, host string, path string, seq bigint, main boolean, places array<int>, lines array<bigint>",
    )
    gone = shared_with_neighbour(keyed).groupBy(F.col("key").alias("_key")).agg(F.max("gone").alias("_gone"))
    fields = ", ".join([*(f"`{c}` {kind(pages, c)}" for c in keep), "_key bigint, _texts array<string>"])
    read = map_batches(pages.select(*keep, key.alias("_key"), page.alias("_html")), read_texts, fields)
    left = F.filter("_texts", lambda t, i: ~F.coalesce(F.array_contains("_gone", i), F.lit(False)))
    return read.join(gone, "_key", "left").select(*keep, F.array_join(left, "\n").alias("text"))
