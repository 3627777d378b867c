"""Text, number and date columns: blanks, folding, slugs, tolerant parsing, formatting."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that Unicode doesn't decompose, one to one and one to several.
_SINGLE = {"Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Ł": "L", "ł": "l", "Ħ": "H", "ħ": "h", "Ŧ": "T", "ŧ": "t", "ı": "i"}
SEVERAL = {"Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "ss", "Þ": "TH", "þ": "th"}


def _decomposed() -> dict[str, str]:
    """Each Latin letter with marks (Latin-1 to Extended-B, Extended Additional) and the ASCII letter under its marks."""
    letters = (chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)))
    under = {c: unicodedata.normalize("NFD", c)[0] for c in letters}
    return {c: x for c, x in under.items() if x != c and x.isascii() and x.isalpha()}


#: Letters with marks and what they fold to, position by position; marks that stand by themselves go.
MARKED, PLAIN = map("".join, zip(*_decomposed().items(), strict=True))
MARKS = "".join(map(chr, range(0x300, 0x370)))
#: Text that counts as true (fixed values); nothing else does.
TRUE_TEXT = ("TRUE", "true", "1")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_filled(x: Column | str) -> Column:
    """Whether a value is neither null nor made of blanks, tabs and line ends only; never null."""
    return F.coalesce(_c(x).cast("string").rlike(r"[^ \t\r\n]"), F.lit(False))


def squish(x: Column | str) -> Column:
    """Trimmed, with every run of white space, no-break spaces included, as one space."""
    return F.trim(F.regexp_replace(_c(x).cast("string"), r"(?U)\s+", " "))


def blank_to_null(x: Column | str) -> Column:
    """Squished text, null if nothing is left."""
    return F.nullif(squish(x), F.lit(""))


def first_filled(*xs: Column | str) -> Column:
    """The first of several columns that isn't blank, squished."""
    return F.coalesce(*map(blank_to_null, xs)) if xs else F.lit(None).cast("string")


def sentence_case(x: Column | str) -> Column:
    """First letter upper, all others lower (not each word's)."""
    return F.concat(F.upper(F.substring(_c(x), 1, 1)), F.lower(F.substring(_c(x), 2, 2**30)))


def unaccent(x: Column | str) -> Column:
    """Latin letters without their marks, composed or not; letters that no mark makes stay."""
    return F.translate(_c(x), MARKED + MARKS, PLAIN)


def transliterated(x: Column | str) -> Column:
    """``unaccent``, and letters that Unicode doesn't decompose as the ones they stand for."""
    one = F.translate(_c(x), MARKED + "".join(_SINGLE) + MARKS, PLAIN + "".join(_SINGLE.values()))
    for letter, by in SEVERAL.items():
        one = F.replace(one, F.lit(letter), F.lit(by))
    return one


def plain(text: str) -> str:
    """``transliterated``, of a name in the program."""
    return text.translate(str.maketrans(MARKED, PLAIN, MARKS) | str.maketrans(_SINGLE | SEVERAL))


def _joined(x: Column, sep: str) -> Column:
    runs = F.regexp_replace(F.lower(x), "[^a-z0-9]+", sep or "")
    return F.regexp_replace(runs, f"^{sep}+|{sep}+$", "") if sep else runs


def fold(x: Column | str, sep: str = " ") -> Column:
    """Lower-case letters and digits without marks; runs of anything else become ``sep``, none at the ends."""
    return _joined(unaccent(x), sep)


def slug(x: Column | str) -> Column:
    """As ``fold`` with hyphens, of transliterated letters: a slug keeps ł, ø, œ and ß as l, o, oe and ss, where a search takes them for gaps."""
    return _joined(transliterated(x), "-")


def normal_name(x: Column | str) -> Column:
    return fold(x, " ")


def normal_key(x: Column | str) -> Column:
    return fold(x, "")


def photo_file(x: Column | str, ext: str = ".jpg") -> Column:
    return F.concat(_joined(transliterated(x), "_"), F.lit(ext))


def first_letter(x: Column | str) -> Column:
    return F.upper(F.substring(normal_name(x), 1, 1))


def is_true(x: Column | str) -> Column:
    """TRUE, true or 1, as text, boolean or number; null is false."""
    return F.coalesce(_c(x).cast("string").isin(*TRUE_TEXT), F.lit(False))


def as_number(x: Column | str) -> Column:
    """A double, only the first comma read as a point; null if that isn't a number."""
    return F.trim(F.regexp_replace(_c(x).cast("string"), "^([^,]*),", "$1.")).try_cast("double")


def to_number(x: Column | str) -> Column:
    """A double, every comma read as a point."""
    return F.replace(F.trim(_c(x).cast("string")), F.lit(","), F.lit(".")).try_cast("double")


#: Date forms tried in order: year first, day first, month first.
DATE_FORMS = ("yyyy-M-d", "yyyy/M/d", "yyyyMMdd", "d/M/yyyy", "d-M-yyyy", "M/d/yyyy", "M-d-yyyy", "yyyy-M", "yyyy")


def to_year(x: Column | str, latest: int, numeric: bool = False) -> Column:
    """An integer year.

    A number is truncated, and is null outside 1500 to ``latest``. Text that
    isn't such a number is parsed as a date in the order of ``DATE_FORMS``;
    a parsed year isn't checked against the bounds.
    """
    n = squish(x).try_cast("double").try_cast("int")
    bounded = F.when(n.between(1500, latest), n)
    if numeric:
        return bounded
    text = squish(x)
    parsed = F.coalesce(*[F.year(F.try_to_timestamp(text, F.lit(f))) for f in DATE_FORMS])
    return F.coalesce(bounded, F.when(is_filled(text), parsed)).cast("int")


def to_date(x: Column | str) -> Column:
    """An ISO date, else null."""
    return F.try_to_timestamp(F.trim(_c(x)), F.lit("yyyy-MM-dd")).cast("date")


def format_int(x: Column | str) -> Column:
    """Whole numbers with points between thousands; points are taken out first, blank is a dash, other text stays."""
    text = F.trim(_c(x).cast("string"))
    n = F.replace(text, F.lit("."), F.lit("")).try_cast("double")
    grouped = F.translate(F.format_number(F.bround(n), 0), ",", ".")
    return F.when(~is_filled(_c(x)), F.lit("—")).otherwise(F.coalesce(grouped, text))


def plural(n: Column | str, one: str, many: str) -> Column:
    return F.when(_c(n) == 1, one).otherwise(many)


def html_escape(x: Column | str, attribute: bool = False) -> Column:
    """Ampersands first, then angle brackets, quotes in attributes only; blank is a dash."""
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;"), ("'", "&#39;")] if attribute else [])
    out = _c(x)
    for a, b in pairs:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(is_filled(x), out).otherwise(F.lit("—"))


def western_longitude(x: Column | str) -> Column:
    """Longitudes of more than 0 and up to 80 lost their sign: they get it back."""
    return F.when((_c(x) > 0) & (_c(x) <= 80), -_c(x)).otherwise(_c(x))


def round5(x: Column | str) -> Column:
    """Five decimals, halves to even."""
    return F.bround(_c(x), 5)


def contains_all(text: Column | str, query: Column | str) -> Column:
    """Whether every word of a query is somewhere in a text, marks and case aside; an empty query is in all."""
    words = F.filter(F.split(normal_name(query), " "), lambda w: w != "")
    hay = normal_name(text)
    return F.forall(words, lambda w: F.contains(hay, w))
