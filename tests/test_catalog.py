"""Harmonising, coercion and indicators."""

from pyspark.sql import functions as F

from verdant.operators import catalog as C
from verdant.operators import kpi as K
from verdant.plans import schema as S


def one(df):
    return [r.asDict() for r in df.collect()]


def test_alias_chains_and_traps(spark):
    df = spark.createDataFrame([(" ", "Aa bb", "abc", "1,5", "PLANTAE", None), (None, None, None, "2", "fungi", "Magnoliopsida"), ("X", None, "3", "4", "PLANTAE", "magnoliopsida ")], "scientificName string, species string, decLat_final string, decimalLatitude string, kingdom string, class string")
    got = one(S.coerced(S.harmonised(df), "lab", "lab", 2028))
    assert [r["scientificName"] for r in got] == ["Aa bb", None, "X"]
    # An alias that is no number hides a later good one.
    assert [r["latitude"] for r in got] == [None, 2.0, 3.0]
    # A plant without a class is a cryptogam.
    assert [r["group"] for r in got] == ["Criptógamas", "Fungos", "Fanerógamas"]
    assert all(r["is_project_source"] and r["source"] == "lab" for r in got)
    assert [f.name for f in S.CATALOG] == list(got[0])


def test_stated_group_wins_and_unknown_is_kept_apart(spark):
    df = spark.createDataFrame([("Fungos", "PLANTAE"), ("Algas", "PLANTAE"), (" ", "ANIMALIA")], "group string, kingdom string")
    assert [r["group"] for r in one(S.coerced(S.harmonised(df), "x", "y", 2028))] == ["Fungos", "Indeterminado", "Indeterminado"]


def test_one_true_flag_disables_derivation(spark):
    rows = [("SPECIES", None, "a"), ("GENUS", "TRUE", "b"), ("FORM", None, "c")]
    df = spark.createDataFrame(rows, "taxonRank string, is_species_level string, species_key string")
    assert [r["species_key"] for r in one(S.coerced(S.harmonised(df), "x", "y", 2028))] == [None, "b", None]
    assert [r["species_key"] for r in one(S.coerced(S.harmonised(df.drop("is_species_level")), "x", "y", 2028))] == ["a", None, "c"]


def test_coordinate_flag_without_coordinates(spark):
    df = spark.createDataFrame([("1", None), (None, None), (None, "1,5")], "has_coordinates string, latitude string").withColumn("longitude", F.lit(999))
    assert [r["has_coordinates"] for r in one(S.coerced(S.harmonised(df), "x", "y", 2028))] == [True, False, True]


def test_extra_columns_of_clashing_types_do_not_break_the_union(spark):
    a = C.catalog_input(spark.createDataFrame([("a", 1)], "species string, extra int"), spark, "p", True, "p", 2028)
    b = C.catalog_input(spark.createDataFrame([("b", "text")], "species string, extra string"), spark, "h", False, "p", 2028)
    assert C.union([a, b, C.empty_catalog(spark), C.catalog_input(None, spark, "none", False, "p", 2028)]).count() == 2


CATALOG = "source string, group string, species_key string, is_species_level boolean, genus string, family string, year int, has_coordinates boolean"
ROWS = [
    ("project", "A", "Sp one", True, "G", "F", 2001, True),
    ("project", "A", "sp ONE", True, "G", "F2", 2003, False),
    ("historical", "B", "Sp one", True, "H", " ", None, True),
    ("project", "B", None, True, None, "F", 2003, None),
    ("project", "B", "x", False, "K", "F", 2003, False),
]


def test_new_species_per_group_need_not_add_up(spark):
    df = spark.createDataFrame(ROWS, CATALOG)
    assert {r[0] for r in K.new_species(df, "project").collect()} == {"sp ONE"}
    assert {tuple(r) for r in K.new_species(df, "project", True).collect()} == {("A", "Sp one"), ("A", "sp ONE")}
    panel = one(K.overall(df, "project"))[0]
    assert (panel["n_records"], panel["n_species"], panel["n_genera"], panel["n_families"], panel["n_new_species"], panel["n_georeferenced"]) == (5, 2, 3, 2, 1, 2)
    assert sum(r["n_records"] for r in one(K.by_group(df, "project"))) == 5


def test_species_list_joins_case_variants(spark):
    got = one(K.species_list(spark.createDataFrame(ROWS, CATALOG), "project"))
    assert [(r["family"], r["species"], r["n_records"], r["is_new"]) for r in got] == [("F", "Sp one", 1, True), ("F2", "Sp one", 1, True), ("—", "Sp one", 1, True)]


def test_years(spark):
    df = spark.createDataFrame(ROWS, CATALOG)
    assert [tuple(r) for r in K.by_year(df, True).collect()] == [(2001, 1), (2002, 0), (2003, 3)]
    assert K.by_year(df.where("year is null"), True).count() == 0


def test_empty_catalog_gives_zeros(spark):
    empty = C.empty_catalog(spark)
    assert one(K.overall(empty, "project"))[0]["n_species"] == 0
    assert K.by_group(empty, "project").count() == 0 and K.species_list(empty).count() == 0 and K.richness(empty, "genus", 7).count() == 0


def test_richness_ties_by_name(spark):
    df = spark.createDataFrame([("s", "A", k, True, g, "F", 1, True) for g, k in [("b", "1"), ("a", "2"), ("c", "3"), ("c", "4")]], CATALOG)
    assert [r[0] for r in K.richness(df, "genus", 2).collect()] == ["c", "a"]


def test_panels_scan_the_catalog_once(spark, tmp_path):
    """One scan of the records and no distinct count, for the general panel and the panels by group."""
    rows = [("p", "g", "S", True, "a b", "A", "F", 2000, True), ("h", "g", "S", True, "a b", "A", "F", 2001, False), ("p", "g", "S", True, "c d", "C", None, 2001, True), (None, None, None, False, None, None, " ", None, None)]
    spark.createDataFrame(rows, "source string, group string, taxonRank string, is_species_level boolean, species_key string, genus string, family string, year int, has_coordinates boolean").write.parquet(f"{tmp_path}/c")
    df = spark.read.parquet(f"{tmp_path}/c")
    for panel in (K.overall(df, "p"), K.by_group(df, "p")):
        plan = panel._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("FileScan") == 1 and "Expand" not in plan
    assert K.overall(df, "p").first().asDict() == {"n_records": 4, "n_project": 2, "n_historical": 1, "n_species": 2, "n_genera": 2, "n_families": 1, "n_georeferenced": 2, "n_new_species": 1}
    assert K.overall(df.limit(0), "p").first()["n_records"] == 0 and {r["group"]: r["n_new_species"] for r in K.by_group(df, "p").collect()} == {"g": 1, None: 0}
