"""Main text of web pages by nearest-URL differencing.

Pages of a host are sorted by URL path; each is compared with the neighbour of
the longer common path. Their text lines are aligned by a longest common
subsequence, and a page's lines that its neighbour has too are boilerplate.
Articles do repeat sentences of each other, so a shared line inside an article
goes only if it is no evident prose and the host shows that it belongs to its
frame: at least ``LEAST_PAGES`` of its pages, and half of them, share that line at
the same place, counted from the article's first or from its last line. Lines of
menus, headers, footers, sidebars, notices, adverts, forms and comments go by
their markup alone, shared or not.

Only line hashes travel to the neighbour. Rows are range-partitioned by host
and path, so a host of any size spreads over tasks; the first and last row of
each range, two per task, are joined with their outer neighbours in a second step.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm.shared import map_arrow, written

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>?|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Elements by what they mean for the text.
MAIN = {"article", "main"}
BOILERPLATE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "template", "noscript", "iframe", "object", "svg", "head", "canvas", "audio", "video"}
RAW = {"script", "style", "title", "textarea", "xmp"}
CONTAINERS = {"div", "section", "header", "ul", "ol", "dl", "table", "blockquote", "figure", "fieldset", "details", "body", "center"} | MAIN | BOILERPLATE
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "pre", "figcaption", "hr", "address", "summary", "html", "caption", "legend", "thead", "tbody", "tfoot"}
SPACES = {"br", "td", "th", "wbr"}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "menu", "menubar"}
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "menu", "nav", "navbar",
    "navigation", "sidebar", "footer", "header", "masthead", "breadcrumb", "breadcrumbs", "comment", "comments", "respond", "disqus", "related", "share", "sharing", "social",
    "newsletter", "subscribe", "popup", "modal", "pagination", "pager", "skip",
}

#: Of an article's lines: one that is no sentence, a sentence of few words, a sentence of ``LEAST_WORDS`` or more. Others are OUTSIDE.
OUTSIDE, FRAGMENT, SHORT, PROSE = range(4)
LEAST_WORDS = 4
#: Sentences of so many words outside an article, longer than it in sum, show that it isn't the page's body.
LEAST_BODY_WORDS = 8
#: So many pages of a host, and so many hundredths of them, share a line of the frame.
LEAST_PAGES, LEAST_PERCENT = 3, 50
SENTENCE = re.compile(r"""[.!?…。！？]["'”’»)\]]*\Z""")


def _is_boilerplate(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in BOILERPLATE or (tag == "header" and not in_main):
        return True
    if not attributes or "=" not in attributes:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        words = set(re.split(r"[^a-z]+", "".join(values).lower()))
        if words & (ROLES if name.lower() == "role" else NAMES) and tag not in ("body", "html") and not (tag in MAIN):
            return True
    return False


def lines(page: str) -> list[tuple[str, bool, bool]]:
    """(text, in the article, boilerplate by its markup) of each block of a page that has text.

    Markup may be broken: an end tag closes the nearest open element of its
    name or nothing, a paragraph ends where the next block begins, and what is
    open at the end of the page ends there.
    """
    out: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = [("", False, False)]

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((text, stack[-1][1], stack[-1][2]))

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if not m[0].startswith(("<!", "<?")):
                parts.append(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    flush()
                    del stack[k:]
                    break
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in SPACES:
            parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            while stack[-1][0] in ("p", "li") and tag not in VOID and (tag != "li" or stack[-1][0] == "li" or stack[-1][0] == "p"):
                stack.pop()
        if tag in VOID:
            continue
        _, main, bad = stack[-1]
        own = _is_boilerplate(tag, m[3], main)
        if tag in CONTAINERS or own:
            if own and tag not in BLOCKS:
                flush()
            if not m[3].endswith("/") or tag in CONTAINERS:
                stack.append((tag, main or tag in MAIN, bad or own))
    flush()
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _place(url: str) -> tuple[str, str]:
    """Host and path with query; a URL without a host is all path."""
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^#]*)", url)
    return (m[1].lower(), m[2]) if m else ("", url.partition("#")[0])


def line_kind(text: str, least_words: int = LEAST_WORDS) -> int:
    """What an article's line is."""
    if not SENTENCE.search(text):
        return FRAGMENT
    return PROSE if len(text.split()) >= least_words else SHORT


PARSED = "page_id long, url string, host string, path string, same long, hashes array<long>, texts array<string>, at array<int>, kinds array<int>"


def parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Per page its place, line hashes, a hash of those, and the lines that its markup leaves with their kinds: those of the article, if the body is in it."""

    def rows(columns):
        for key, url, raw in zip(*columns, strict=True):
            url = None if url is None else url.decode("utf-8", "replace")
            found = lines((raw or b"").decode("utf-8", "replace"))
            hashes = [_signed(xxhash.xxh64_intdigest(t)) for t, _, _ in found]
            left = [i for i, (_, _, bad) in enumerate(found) if not bad]
            main = [i for i in left if found[i][1]]
            body = sum(len(found[i][0]) for i in left if not found[i][1] and line_kind(found[i][0], LEAST_BODY_WORDS) == PROSE)
            keep = main if main and body <= sum(len(found[i][0]) for i in main) else left
            kinds = [line_kind(found[i][0]) if found[i][1] else OUTSIDE for i in keep]
            same = _signed(xxhash.xxh64_intdigest(",".join(map(str, hashes))))
            yield key, url, *_place(url or ""), same, hashes, [found[i][0] for i in keep], keep, kinds

    cols = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    return map_arrow(cols, ["_id", "_url", "_html"], PARSED, rows)


def common_lines(a: list[int], b: list[int], most_bits: int = 1 << 28) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``.

    Equal ends are taken off and lines that the other side lacks left out; a
    bit-parallel table of the rest (one bit a cell) is walked back, and halved
    first while it is larger than ``most_bits``.
    """
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    tail = 0
    while tail < min(len(a), len(b)) - start and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    inner_a, inner_b = a[start : len(a) - tail], b[start : len(b) - tail]
    in_a, in_b = set(inner_a), set(inner_b)
    x = [(i + start, v) for i, v in enumerate(inner_a) if v in in_b]
    y = [v for v in inner_b if v in in_a]
    middle = _walk(x, y, most_bits)
    return [*range(start), *middle, *range(len(a) - tail, len(a))]


def _table(values: list[int], other: list[int], keep: bool) -> list[int]:
    """After each value, the bits of ``other`` at which the common length doesn't rise; all rows or the last."""
    masks: dict[int, int] = {}
    for j, v in enumerate(other):
        masks[v] = masks.get(v, 0) | 1 << j
    full = (1 << len(other)) - 1
    row, rows = full, [full]
    for v in values:
        hit = row & masks.get(v, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row) if keep else rows.__setitem__(0, row)
    return rows


def _walk(x: list[tuple[int, int]], y: list[int], most_bits: int) -> list[int]:
    if not x or not y:
        return []
    values = [v for _, v in x]
    if len(x) * len(y) > most_bits and len(x) > 1:
        half = len(x) // 2
        upper = _table(values[:half], y, False)[0]
        lower = _table(values[half:][::-1], y[::-1], False)[0]
        best, cut, left = -1, 0, 0
        right = len(y) - lower.bit_count()
        n = len(y)
        for j in range(n + 1):
            if left + right > best:
                best, cut = left + right, j
            if j < n:
                left += not upper >> j & 1
                right -= not lower >> (n - 1 - j) & 1
        return _walk(x[:half], y[:cut], most_bits) + _walk(x[half:], y[cut:], most_bits)
    rows = _table(values, y, True)
    out, i, j = [], len(x), len(y)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            out.append(x[i - 1][0])
            i, j = i - 1, j - 1
    return out[::-1]


def _alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def nearest_shared(row: tuple, before: tuple | None, after: tuple | None) -> list[int]:
    """Shared lines of a row (host, path, same, hashes) with the neighbour of the longer common path; ties go to the one before.

    A neighbour of another host, or with the very same lines, tells nothing.
    """
    near = [n for n in (before, after) if n is not None and n[0] == row[0] and n[2] != row[2]]
    if not near:
        return []
    return common_lines(list(row[3]), list(max(near, key=lambda n: _alike(n[1], row[1]))[3]))


_NEAR = "host string, path string, same long, shared array<int>, part int, last boolean, hashes array<long>, near_host string, near_path string, near_same long, near_hashes array<long>"


def _near_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]
    names = [x.split()[0] for x in _NEAR.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def shared_lines(places: DataFrame) -> DataFrame:
    """(host, path, same, shared) for distinct (host, path, same, hashes): positions of the lines shared with the nearest page."""

    def inner(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        none = (None,) * 4
        held: list[tuple] = []  # the row before and the row
        n, out = 0, []
        for b in batches:
            for at in range(0, b.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True):
                    n += 1
                    if n == 2:
                        out.append((*held[0][:3], None, part, False, held[0][3], *row))
                    elif n > 2:
                        out.append((*held[1][:3], nearest_shared(held[1], held[0], row), None, None, None, *none))
                    held = [*held[-1:], row]
                    if len(out) >= 256:
                        yield _near_batch(out)
                        out = []
        if n == 1:
            out.append((*held[0][:3], None, part, False, held[0][3], *none))
        elif n > 1:
            out.append((*held[1][:3], None, part, True, held[1][3], *held[0]))
        if out:
            yield _near_batch(out)

    def outer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                out = []
                for host, path, same, _, part, last, hashes, *more in zip(*(c.to_pylist() for c in b.slice(at, 64).columns), strict=True):
                    near, before, after = (tuple(x) if x[0] is not None else None for x in (more[:4], more[4:8], more[8:]))
                    before, after = (near, after) if last else (before, near or after)
                    out.append((host, path, same, nearest_shared((host, path, same, hashes), before, after), part, last, None, None, None, None, None))
                yield _near_batch(out)

    order = ["host", "path", "same"]
    near = written(places.select(*order, "hashes").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(inner, _NEAR), "near")
    # The first and the last row of each range, or its only one, meet the neighbours in the ranges before and after.
    edges = near.where("part is not null")
    parts = [r["part"] for r in edges.select("part").distinct().orderBy("part").collect()]  # a number for each task
    steps = places.sparkSession.createDataFrame(list(zip(parts, parts[1:], strict=False)), "_from int, _to int")
    side = lambda name: [F.col(x).alias(f"{name}_{x}") for x in (*order, "hashes")]
    before = edges.where("last or near_host is null").join(steps, F.col("part") == F.col("_from")).select(F.col("_to").alias("_before"), *side("before"))
    after = edges.where("not last").join(steps, F.col("part") == F.col("_to")).select(F.col("_from").alias("_after"), *side("after"))
    met = edges.join(before, F.col("part") == F.col("_before"), "left").join(after, F.col("part") == F.col("_after"), "left").drop("_before", "_after")
    edges = met.mapInArrow(outer, _NEAR)
    return near.where("part is null").unionByName(edges).select(*order, "shared")


def frame_lines(places: DataFrame, shared: DataFrame) -> DataFrame:
    """(host, path, same, frame): positions of the shared article lines that the host's pages place alike, of (…, at, kinds) of distinct pages."""
    key = ["host", "path", "same"]
    lines_ = F.filter(F.transform("at", lambda x, i: F.struct(x.alias("at"), F.get("kinds", i).alias("kind"))), lambda x: x["kind"] != OUTSIDE)
    place = lambda x, i: F.struct(x["at"].alias("at"), F.get("hashes", x["at"]).alias("line"), x["kind"].alias("kind"), i.alias("first"), (i + 1 - F.size("_article")).alias("last"))
    found = places.join(shared, key).withColumn("_article", lines_).withColumn("_x", F.transform("_article", place))
    found = found.select(*key, F.explode(F.filter("_x", lambda x: (x["kind"] != PROSE) & F.array_contains("shared", x["at"]))).alias("_x"))
    # Places from the front are 0 and more, from the back 0 and less; the first and the last line are told apart by the side.
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("_x")["first"].alias("place")), F.struct(F.lit(1).alias("side"), F.col("_x")["last"].alias("place")))
    found = written(found.select(*key, F.col("_x")["at"].alias("at"), F.col("_x")["line"].alias("line"), F.explode(sides).alias("_s")).select(*key, "at", "line", "_s.*"), "shared-lines")
    pages = places.groupBy(F.col("host").alias("_host")).agg(F.count("*").alias("pages"))
    often = found.groupBy("host", "line", "side", "place").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    often = often.join(pages, F.col("host") == F.col("_host")).where(100 * F.col("n") >= LEAST_PERCENT * F.col("pages")).select("host", "line", "side", "place")
    return found.join(often, ["host", "line", "side", "place"], "left_semi").groupBy(*key).agg(F.collect_set("at").alias("frame"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each page.

    A page has all lines that neither its markup nor its neighbour marks as
    boilerplate; one with its body in an article has none outside it. A shared
    line of an article stays unless the host's pages show that it is of the
    frame (``frame_lines``); sentences of four words or more always stay. So
    two pages alone never take a line from each other's articles.

    Nulls: a null html is an empty page, a null url a page of no host; null
    ids stay. Repeated rows have a row each, aren't each other's neighbours
    and are one page of the host. An empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    rows = parsed(pages, id_col, url_col, html_col)
    key = ["host", "path", "same"]
    places = written(rows.select(*key, "hashes", "at", "kinds").dropDuplicates(key), "places")
    shared = written(shared_lines(places), "shared")
    is_in = lambda name, x: F.coalesce(F.array_contains(name, x), F.lit(False))
    goes = F.filter("at", lambda x, i: F.when(F.get("kinds", i) == OUTSIDE, is_in("shared", x)).otherwise(is_in("frame", x)))
    gone = places.join(shared, key).join(frame_lines(places, shared), key, "left").select(*key, goes.alias("gone")).where(F.size("gone") > 0)
    # Written, so that the planner knows its size: texts stay where they are if few pages lose a line.
    out = rows.drop("hashes").join(written(gone, "gone"), key, "left")
    kept = F.filter(F.transform("texts", lambda t, i: F.struct(t.alias("t"), is_in("gone", F.get("at", i)).alias("gone"))), lambda x: ~x["gone"])
    out = out.withColumn("text", F.array_join(F.transform(kept, lambda x: x["t"]), "\n\n"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_page_text(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
