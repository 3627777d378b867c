"""Paths and references: cleaning, resolving, extensions, routes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdant.functions.text import _c

# Extensions and patterns of references in sources.
IMAGE_EXT = ["png", "jpg", "jpeg", "webp", "gif", "svg", "tif", "tiff", "bmp", "pdf"]
DATA_EXT = ["csv", "tsv", "xlsx", "xls", "rds", "geojson", "json", "yml", "yaml", "parquet"]
IMAGE_PATTERNS = {
    "markdown_image": r"!\[[^\]]*\]\(([^)]+)\)",
    "html_img": r"""<img[^>]+src\s*=\s*['"]([^'"]+)['"]""",
    "css_url": r"""url\(\s*['"]?([^'")]+)['"]?\s*\)""",
    "quoted_image": r"""['"]([^'"]+\.(?:%s)(?:[?#][^'"]*)?)['"]""" % "|".join(IMAGE_EXT),
}
LINK_PATTERNS = {
    "markdown_link": r"(?<!!)\[[^\]]*\]\(([^)]+)\)",
    "html_href": r"""<a[^>]+href\s*=\s*['"]([^'"]+)['"]""",
}
DATA_PATTERNS = {"data_file": r"""['"]([^'"]+\.(?:%s)(?:[?#][^'"]*)?)['"]""" % "|".join(DATA_EXT)}
PACKAGE_PATTERN = r"""(?:library|require)\s*\(\s*['"]?([A-Za-z][A-Za-z0-9.]+)['"]?"""
EXTERNAL = r"(?i)^(https?:)?//|^mailto:|^tel:|^data:|^javascript:|^www\."
MAX_CHARS = 180


def ends_with_ext(x: Column | str, exts: list[str]) -> Column:
    return _c(x).rlike(rf"(?i)\.({'|'.join(map(re.escape, exts))})([?#].*)?$")


def clean_ref(x: Column | str) -> Column:
    """Trimmed, without quotes at the ends, query and fragment, percent signs decoded; a plus stays a plus."""
    bare = F.regexp_replace(F.regexp_replace(_c(x), r"^\s+|\s+$", ""), r"""^['"]|['"]$""", "")
    bare = F.regexp_replace(bare, r"(?s)[?#].*$", "")
    return F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)


def is_external(x: Column | str) -> Column:
    return _c(x).rlike(EXTERNAL)


def is_invalid(cleaned: Column | str, max_chars: int = MAX_CHARS) -> Column:
    """Null, empty, too long, with brackets or line ends: no reference to a file."""
    c = _c(cleaned)
    return c.isNull() | (c == "") | (F.length(c) > max_chars) | c.rlike(r"[{}<>\n\r]")


def fold_path(x: Column | str) -> Column:
    """A path without empty, ``.`` and ``..`` parts; ``..`` at the root is dropped."""
    parts = F.split(_c(x), "/")
    step = lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p.isin("", "."), acc).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def dirname(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), "[^/]*$", "")


def resolve(cleaned: Column | str, source: Column | str) -> Column:
    """The path from the root that a reference in ``source`` names; null for external, fragment-only and invalid ones."""
    c = _c(cleaned)
    path = F.when(c.startswith("/"), c).otherwise(F.concat(dirname(source), c))
    return F.when(~is_invalid(c) & ~c.startswith("#") & ~is_external(c), fold_path(path))


def extension(x: Column | str) -> Column:
    """Lower-case extension without its point, empty if there is none."""
    return F.lower(F.regexp_extract(_c(x), r"\.([A-Za-z0-9]+)$", 1))


def mebibytes(x: Column | str) -> Column:
    return _c(x) / (1024**2)


def clean_folder(x: Column | str, prefixes: tuple[str, ...] = ()) -> Column:
    """A folder name: no-break spaces and backslashes made plain, ``./``, outer slashes and known prefixes off; blank is null."""
    out = F.trim(F.replace(_c(x), F.lit("\xa0"), F.lit(" ")))
    out = F.regexp_replace(F.replace(out, F.lit("\\"), F.lit("/")), r"^\./+", "")
    out = F.regexp_replace(out, "^/+|/+$", "")
    for p in prefixes:
        out = F.regexp_replace(out, f"^{re.escape(p)}/+", "")
    return F.nullif(out, F.lit(""))


def under_root(x: Column | str, root: str) -> Column:
    """A path with plain slashes, without a root folder that it begins with."""
    return F.regexp_replace(F.replace(_c(x), F.lit("\\"), F.lit("/")), f"^{re.escape(root)}/?", "")


def clean_route(x: Column | str) -> Column:
    """Single slashes, no index.html, a slash at the end."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(F.nullif(_c(x), F.lit("")), F.lit("/")), "/+", "/"), r"index\.html$", "")
    return F.when(out.endswith("/"), out).otherwise(F.concat(out, F.lit("/")))


def route(x: Column | str, routes: dict[str, str], other: str = "/en/") -> Column:
    """The other language's page: looked up as given, then cleaned; else the other language's start page."""
    table = F.create_map(*[F.lit(v) for kv in routes.items() for v in kv])
    cleaned = clean_route(x)
    return F.coalesce(F.try_element_at(table, _c(x)), F.try_element_at(table, cleaned), F.when(cleaned.startswith(other), F.lit("/")).otherwise(F.lit(other)))


def up_prefix(x: Column | str) -> Column:
    """``../`` for each folder that a page lies under the root."""
    depth = F.size(F.filter(F.split(_c(x), "/"), lambda p: p != ""))
    return F.repeat(F.lit("../"), F.greatest(depth - 1, F.lit(0)))


def is_web(x: Column | str) -> Column:
    return F.coalesce(_c(x).rlike("^https?://"), F.lit(False))


def split_escaped(x: Column | str, sep: str) -> Column:
    """Parts between separators that no backslash stands before; escaped ones lose theirs."""
    parts = F.split(_c(x), rf"(?<!\\){re.escape(sep)}")
    return F.transform(parts, lambda p: F.replace(p, F.lit(f"\\{sep}"), F.lit(sep)))
