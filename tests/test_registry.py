"""Registries, sources, integrity and linked selections."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from verdant.operators import integrity as I
from verdant.operators import links as L
from verdant.operators import registry as G
from verdant.plans import queries
from verdant.plans import schema as S
from verdant.sources import files, preview, tables, xlsx


def test_unique_slugs_skip_names_that_are_there(spark):
    df = spark.createDataFrame([(1, "A"), (2, "a"), (3, "a-1"), (4, "a"), (5, "á"), (6, ""), (7, "")], "pos int, name string")
    assert [r["slug"] for r in G.unique_slugs(df, "name", "pos").orderBy("pos").collect()] == ["a", "a-2", "a-1", "a-3", "a-4", "", "-1"]


def test_pick_orders(spark):
    assert S.pick(["lat", "Latitude"], ["Latitude", "lat"]) == "Latitude"
    assert S.pick_like(["x", "Nome!", "NÓME"], ["nome"]) == "Nome!"
    with pytest.raises(ValueError):
        S.pick(["a"], ["b"])
    df = spark.createDataFrame([(" ", "b"), (None, None)], "Email string, `E-mail` string")
    assert [r[0] for r in df.select(S.first_value(df, ["Email", "E-mail"], "-")).collect()] == ["b", "-"]
    assert [r[0] for r in df.select(S.value_or(df, ["Email"], "d")).collect()] == [" ", "d"]


def test_expeditions(spark):
    df = spark.createDataFrame([(1, "Rio", "-0.1", "67,5", None), (2, " ", None, "1", "./fotos/x/"), (3, "Rio", "1", "-1", None)], "row int, nome string, lat string, long string, fotos string")
    got = G.expeditions(df, "row", "Viagem", ("fotos",)).orderBy("pos").collect()
    assert [(r["name"], r["expedition_id"], r["folder"], r["longitude"], r["has_coords"]) for r in got] == [("Rio", "rio", "rio", -67.5, True), ("Viagem 2", "viagem-2", "x", -1.0, False), ("Rio", "rio-1", "rio-1", -1.0, True)]
    shown = G.with_photos(G.palette(G.expeditions(df, "row"), "name", "pos", ["red", "blue"]), spark.createDataFrame([("rio", "b.jpg"), ("rio", "a.jpg")], "folder string, file string"))
    assert [(r["colour"], r["photos"]) for r in shown.orderBy("pos").collect()] == [("red", ["a.jpg", "b.jpg"]), ("blue", []), ("red", [])]


def test_media_ties_come_in_reverse_order(spark):
    df = spark.createDataFrame([(1, "u1", None), (2, "u2", "x"), (3, "u3", "2020-01-01"), (4, "u4", "")], "pos int, url string, data string")
    got = G.media_order(G.media(df, "youtube", "pos"), "title").collect()
    assert [r["pos"] for r in got] == [3, 4, 2, 1] and got[0]["title"] == "title" and got[0]["url"] == "u3"
    assert [r["next_page"] for r in G.pages_of(G.media_order(G.media(df, "x", "pos")), "position", 3).orderBy("position").collect()] == [1, 1, 1, 0]


def test_institutions_yaml(spark, tmp_path):
    path = tmp_path / "i.yml"
    path.write_text("- {id: cn, group: parceira, order: 2, name: Ñ}\n- {acronym: B, order: x}\n- {id: f, group: fomento, url: 'https://x'}\n", encoding="utf-8")
    df = tables.read_institutions(spark, str(path))
    assert [(r["id"], r["group"], r["order"], r["acronym"], r["name"]) for r in df.orderBy("pos").collect()] == [("cn", "parceira", 2, "cn", "Ñ"), ("inst_2", "parceira", 999, "B", "B"), ("f", "fomento", 3, "f", "Instituição")]
    got = [(r["section"], r["id"], r["is_link"]) for r in G.institution_groups(df, "cn").collect()]
    assert sorted(got) == [("fomento", "cn", False), ("fomento", "f", True), ("parceira", "inst_2", False)]
    assert [r["id"] for r in G.institution_order(df).collect()] == ["f", "cn", "inst_2"]
    assert tables.read_institutions(spark, "/no/such.yml").count() == 0


def test_csv_with_trailing_blanks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿"a","b " \n"x ""y""","NA" \n"","z " \n', encoding="utf-8")
    df = tables.read_csv(spark, str(path))
    assert df.columns == ["a", "b"] and [tuple(r) for r in df.collect()] == [('x "y"', None), (None, "z ")]
    with pytest.raises(FileNotFoundError):
        tables.read_csv(spark, str(tmp_path / "no.csv"))
    assert tables.read_optional_csv(spark, str(tmp_path / "no.csv"), "a string, n int").columns == ["a", "n"]
    assert I.sources_flagged(tables.read_optional_csv(spark, str(tmp_path / "no.csv"), "file string")).count() == 0


def test_geojson_box(spark, tmp_path):
    path = tmp_path / "g.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": 1}, "geometry": {"type": "Polygon", "coordinates": [[[-67.5, 0.25], [-66, 1], [-67, -2]]]}}]}))
    assert tuple(tables.bounding_box(tables.read_geojson(spark, str(path))).first()) == (-67.5, -2.0, -66.0, 1.0)


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "w.xlsx")
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c><c r="C1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2" t="b"><v>1</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Other" r:id="r2"/><sheet name="DwC_records" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/none.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t> a </t></si><si><r><t>x</t></r><r><t>y</t></r></si></sst>')
        z.writestr("xl/worksheets/s1.xml", sheet)
    df = xlsx.read_xlsx(spark, path)
    assert df.columns == ["a...1", "n", "a...3"] and [tuple(r) for r in df.collect()] == [("xy", None, "TRUE")]


def test_site_files(spark, tmp_path):
    (tmp_path / "_in").mkdir()
    (tmp_path / "docs").mkdir()
    (tmp_path / "_in" / "a.PNG").write_bytes(b"")
    (tmp_path / "docs" / "b.png").write_bytes(b"x")
    (tmp_path / "index.qmd").write_text("![x](_in/a.png) [t](team.html) <img src='no.png?v=1'> library(dplyr)\n", encoding="utf-8")
    inv = files.inventory(spark, str(tmp_path), I.IGNORED_DIRS)
    assert [r["path"] for r in inv.collect()] == ["_in/a.PNG", "index.qmd"] and [r["path"] for r in I.empty(inv).collect()] == ["_in/a.PNG"]
    text = files.texts(spark, str(tmp_path), I.IGNORED_DIRS)
    every = files.inventory(spark, str(tmp_path))
    images = I.checked(I.cleaned(I.references(text, I.R.IMAGE_PATTERNS), I.R.IMAGE_EXT), every)
    assert {(r["target"], r["case_match"]) for r in I.wrong_case(images, every).collect()} == {("_in/a.png", "_in/a.PNG")}
    assert {r["target"] for r in I.missing(images, every).collect()} == {"no.png"}
    assert I.unused(inv.where("ext = 'png'"), images).count() == 0
    assert [r[0] for r in I.packages(text).collect()] == ["dplyr"]
    moved = files.apply_moves([("index.qmd", "q/index.qmd")], str(tmp_path))
    assert moved == [("index.qmd", "q/index.qmd", False)] and (tmp_path / "index.qmd").exists()
    assert files.apply_fixes(str(tmp_path), ["index.qmd", "none"], [("team.html", "team/")], "backup", dry_run=False) == [("index.qmd", True, True)]
    assert files.find_up("index.qmd", str(tmp_path / "_in")) == str(tmp_path / "index.qmd")
    assert files.input_paths("d")[0] == "_input_data/d_validado.xlsx"


def test_html_pages_may_be_sources_and_the_unresolved_count_as_there(spark):
    refs = spark.createDataFrame([("index.qmd", "l", r) for r in ["team.html", "no.html", "#x", "https://a"]], "file string, type string, ref string")
    paths = spark.createDataFrame([("team.qmd",)], "path string")
    got = {r["ref"]: r["exists"] for r in I.checked(refs.withColumn("target", I.R.resolve("ref", "file")), paths, html_sources=True).collect()}
    assert got == {"team.html": True, "no.html": False, "#x": True, "https://a": True}


def test_quarantine_move_rule_wins(spark):
    df = spark.createDataFrame([("docs/a.png",), ("figures/brand/x.png",), ("p.png",)], "path string")
    assert [r["action"] for r in I.quarantine(df, move=["^docs/"]).collect()] == ["quarantine_candidate", "keep", "quarantine_candidate"]


def test_preview_order():
    page = "<title> T  x</title><meta name='twitter:title' content=' tw '><meta name=description content=d><meta property='og:image' content='/i.png'>"
    assert preview.preview(page, "https://h/a/b") == ("tw", "d", "https://h/i.png")
    assert preview.preview("<title> T  x</title>", None) == ("T x", "", "") and preview.preview(None, None) == ("", "", "")


def test_references_without_an_end_are_text(spark):
    """Titles that are cut within a reference, against the query's SQL."""
    titles = ["a&amp;&amp", "b &am", "c&quot; &quot", "&amp;amp", "d &ampx; & e&", "&amp;quot;", "  f\n g&amp", ""]
    rows = [(k, f"<html><head><title>{t}</title><style>p{{}}</style></head><body><p>&amp x</p></body></html>") for k, t in enumerate(titles)] + [(99, None)]
    got = preview.previews(spark.createDataFrame(rows, "url long, html string").selectExpr("cast(url as string) as url", "html")).select("url", "title").collect()
    con = pytest.importorskip("duckdb").connect()
    con.execute("create table pages (page_id bigint, html varchar)")
    con.executemany("insert into pages values (?, ?)", rows)
    assert {(int(r["url"]), r["title"]) for r in got} == set(con.execute(queries.ORACLE_SQL["page_title"]).fetchall())


def test_linked_keys(spark):
    df = spark.createDataFrame([("h1", 1), ("h1", 2), ("h2", 2), ("h2", 2)], "h string, k int")
    keys = lambda x: [r[0] for r in x.collect()]
    assert keys(L.linked_keys(df, "h", "k")) == [2] and keys(L.linked_keys(df, "h", "k", 3)) == [] and L.linked_keys(df, "h", "k", 0) is None
    rows = spark.createDataFrame([(None,), (1,), (2,)], "k int")
    assert rows.where(L.matches("k", [1])).count() == 2 and rows.where(L.matches("k", [])).count() == 1 and rows.where(L.matches("k", None)).count() == 3
    a = spark.createDataFrame([(["x", "y"], [1, 5])], "v array<string>, i array<int>")
    assert a.select(L.subset("v", "i"), L.recycled("v", F.lit(3)), L.matches_all("v", ["x"])).first()[:] == (["y", None], "y", False)
    assert a.select(L.rows_of({"a": F.col("v"), "b": F.col("i")}).alias("r")).first()["r"][1].asDict() == {"a": "y", "b": 5}


def test_broken_rows_are_told_and_good_ones_kept(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('a,b ,c\n1,2,3\n4,5\n6,"x, ""y""\nz",7\n8,9,10,11\n , NA,12\n')
    good, broken = tables.read_csv_checked(spark, str(path))
    assert good.columns == ["a", "b", "c"] and sorted((tuple(r) for r in good.collect()), key=repr) == sorted([("1", "2", "3"), ("6", 'x, "y"\nz', "7"), (None, None, "12")], key=repr)
    assert sorted(tuple(r) for r in broken.collect()) == [("4,5", "fewer values than names"), ("8,9,10,11", "more values than names")]
    with pytest.raises(FileNotFoundError):
        tables.read_csv_checked(spark, str(tmp_path / "no.csv"))
