"""Column functions: one small frame per trap."""

import pytest
from pyspark.sql import functions as F

from verdant.functions import refs as R
from verdant.functions import text as T


def values(spark, xs, f, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = [
    (T.is_filled, [None, "", " \t\r\n", "\xa0", "a"], [False, False, False, True, True]),
    (T.blank_to_null, [None, " ", "\xa0 ", " a\xa0\t\n b "], [None, None, None, "a b"]),
    (T.sentence_case, ["PAU BRASIL", "ábc DE", "", None], ["Pau brasil", "Ábc de", "", None]),
    (T.slug, ["Rio Cuieiras/2", "--", "São João!", None], ["rio-cuieiras-2", "", "sao-joao", None]),
    (T.photo_file, ["Ana Lúcia Sá"], ["ana_lucia_sa.jpg"]),
    (T.first_letter, ["Érica", " 7x", ""], ["E", "7", ""]),
    (T.is_true, ["TRUE", "true", "1", "True", "T", "yes", None], [True, True, True, False, False, False, False]),
    (T.as_number, ["1,5", "1,234,5", "abc", " 2.5 ", None], [1.5, None, None, 2.5, None]),
    (T.to_number, ["1,5", "1,234,5", None], [1.5, None, None]),
    (lambda c: T.to_year(c, 2028), ["2020", "2020.7", "1499", "2029", "31/12/2019", "2019-12-31", "20191231", " ", None, "12/31/2018", "x"], [2020, 2020, 1499, 2029, 2019, 2019, 2019, None, None, 2018, None]),
    (T.format_int, ["1234567", "1.5", " ", None, "n/d", "0"], ["1.234.567", "15", "—", "—", "n/d", "0"]),
    (T.html_escape, ["a<b>&\"c\"", " ", None], ["a&lt;b&gt;&amp;\"c\"", "—", "—"]),
    (lambda c: T.contains_all(c, F.lit("ÁGUA  rio")), ["Rio de agua", "rio", None], [True, False, None]),
    (R.clean_ref, [" 'a%20b.png?v=1' ", "a+b#x", "%zz", None], ["a b.png", "a+b", "%zz", None]),
    (R.fold_path, ["a/b/../c", "/a/./b//", "../../x", None], ["a/c", "a/b", "x", None]),
    (R.extension, ["a/b.PNG", "a.b/c", "x"], ["png", "", ""]),
    (lambda c: R.clean_folder(c, ("_in/fotos",)), [" .//a\xa0b/", "\\x\\y\\", "_in/fotos/z", "\xa0", None], ["a b", "x/y", "z", None, None]),
    (lambda c: R.route(c, {"/a/": "/en/a/", "/": "/en/"}), ["//a/index.html", "", None, "/en/x", "/b"], ["/en/a/", "/en/", "/en/", "/", "/en/"]),
    (R.up_prefix, ["index.html", "a/b.html", "a/b/c.html"], ["", "../", "../../"]),
]


@pytest.mark.parametrize("f,xs,want", CASES)
def test_columns(spark, f, xs, want):
    assert values(spark, xs, f) == want


def test_numeric_years_are_bounded(spark):
    assert values(spark, [2020.9, 1499.0, 2029.0, None], lambda c: T.to_year(c, 2028, True), "double") == [2020, None, None, None]


def test_longitudes(spark):
    assert values(spark, [-67.0, 67.0, 80.0, 81.0, 0.0, None], T.western_longitude, "double") == [-67.0, -67.0, -80.0, 81.0, 0.0, None]


def test_resolve(spark):
    df = spark.createDataFrame([(r,) for r in ["x.png", "../a.png", "/b.png", "#top", "https://x/y.png", "", "a{b}"]], "r string")
    got = [r[0] for r in df.select(R.resolve("r", F.lit("en/team/index.qmd"))).collect()]
    assert got == ["en/team/x.png", "en/a.png", "b.png", None, None, None, None]


def test_split_escaped(spark):
    assert values(spark, [r"a,b\,c,d"], lambda c: R.split_escaped(c, ",")) == [["a", "b,c", "d"]]


def test_all_latin_letters_fold(spark):
    """Against Unicode's own decomposition, for the search; slugs write the letters that it leaves as well."""
    import unicodedata

    names = ["Čapek", "Erdős", "Erdo\u030bs", "Şahin", "Nguyễn", "Żółć", "Ærø", "Œuvre", "Straße", "İstanbul", "ŠĐ", "ǅ"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["n"]: (r["a"], r["b"]) for r in df.select("n", T.normal_name("n").alias("a"), T.slug("n").alias("b")).collect()}
    for n in names:
        bare = "".join(c for c in unicodedata.normalize("NFD", n) if not unicodedata.combining(c))
        assert got[n][0] == " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in bare.lower()).split()), n
    assert got["Żółć"][1] == "zolc" and got["Ærø"][1] == "aero" and got["Œuvre"][1] == "oeuvre" and got["Straße"][1] == "strasse" and got["Erdo\u030bs"][1] == got["Erdős"][1] == "erdos"
    assert T.plain("Čłæß") == "Claess"
