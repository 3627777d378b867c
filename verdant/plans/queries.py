"""The operators as queries over the driver's tables, and independent SQL for each.

The catalog is a view over lineitem and part; dirt (blanks, decimal commas,
mixed date forms) is put in by CASE on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdant.functions import refs as R
from verdant.functions import text as T
from verdant.operators import catalog as C
from verdant.operators import integrity as I
from verdant.operators import kpi as K
from verdant.operators import links as L
from verdant.operators import polygons as P
from verdant.operators import registry as G
from verdant.sources import preview, xlsx
from verdant.plans import schema as S
from verdant.scratch import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_COLUMNS = {
    "source": "CASE l_linestatus WHEN 'O' THEN 'project' ELSE 'historical' END",
    "group": "l_returnflag",
    "taxonRank": "CASE p_size % 5 WHEN 0 THEN ' species ' WHEN 1 THEN 'GENUS' WHEN 2 THEN 'FAMILY' WHEN 3 THEN 'VARIETY' END",
    "is_species_level": "p_size % 5 IN (0, 3)",
    "species_key": "CASE WHEN p_partkey % 97 = 0 THEN '  ' ELSE concat(CASE WHEN l_linenumber = 7 THEN 'SP ' ELSE 'sp ' END, p_partkey, '-', l_suppkey) END",
    "genus": "CASE WHEN p_partkey % 19 = 0 THEN ' ' ELSE p_brand END",
    "family": "CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_type END",
    "year": "CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(year(l_shipdate) AS INT) END",
    "latitude": "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END",
    "longitude": "l_tax",
}


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(*[F.expr(e).alias(c) for c, e in _COLUMNS.items()])
    return rows.withColumn("has_coordinates", F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


CATALOG_SQL = (
    "WITH cat AS (SELECT "
    + ", ".join(f'{e} AS "{c}"' for c, e in _COLUMNS.items())
    + f", ({_COLUMNS['latitude']}) IS NOT NULL AND l_tax IS NOT NULL AS has_coordinates FROM lineitem JOIN part ON l_partkey = p_partkey), "
    "sp AS (SELECT * FROM cat WHERE is_species_level AND trim(species_key) <> '') "
)
_MEASURES_SQL = """count(*) AS n_records, count(*) FILTER (source = 'project') AS n_project, count(*) FILTER (source <> 'project') AS n_historical,
 count(DISTINCT CASE WHEN is_species_level AND trim(species_key) <> '' THEN species_key END) AS n_species, count(DISTINCT nullif(trim(genus), '')) AS n_genera,
 count(DISTINCT nullif(trim(family), '')) AS n_families, count(*) FILTER (has_coordinates) AS n_georeferenced"""


@query(CATALOG_SQL + f"SELECT {_MEASURES_SQL}, (SELECT count(*) FROM (SELECT species_key FROM sp WHERE source = 'project' EXCEPT SELECT species_key FROM sp WHERE source <> 'project')) AS n_new_species FROM cat")
def kpi_overall(spark, sf_dir):
    return K.overall(catalog(spark, sf_dir), "project")


@query(
    CATALOG_SQL
    + f""", new AS (SELECT "group" AS g, count(*) AS n FROM (SELECT DISTINCT "group", species_key FROM sp a WHERE source = 'project' AND NOT EXISTS
 (SELECT 1 FROM sp b WHERE b."group" = a."group" AND b.species_key = a.species_key AND b.source <> 'project')) GROUP BY 1)
 SELECT c.*, coalesce(n, 0) AS n_new_species FROM (SELECT "group", {_MEASURES_SQL} FROM cat GROUP BY 1) c LEFT JOIN new ON g = c."group" """
)
def kpi_by_group(spark, sf_dir):
    return K.by_group(catalog(spark, sf_dir), "project")


@query(CATALOG_SQL + "SELECT species_key FROM sp WHERE source = 'project' EXCEPT SELECT species_key FROM sp WHERE source <> 'project'")
def new_species_keys(spark, sf_dir):
    return K.new_species(catalog(spark, sf_dir), "project")


@query(CATALOG_SQL + """SELECT "group", species_key FROM sp WHERE source = 'project' EXCEPT SELECT "group", species_key FROM sp WHERE source <> 'project'""")
def new_species_per_group(spark, sf_dir):
    return K.new_species(catalog(spark, sf_dir), "project", by_group=True)


@query(CATALOG_SQL + "SELECT coalesce(CASE WHEN upper(trim(taxonRank)) IN ('SPECIES', 'VARIETY') THEN 'species' WHEN taxonRank = 'GENUS' THEN 'genus' WHEN taxonRank = 'FAMILY' THEN 'family' END, 'other') AS resolution, count(*) AS n_records FROM cat GROUP BY 1")
def taxon_resolution_counts(spark, sf_dir):
    rows = catalog(spark, sf_dir).withColumn("resolution", K.resolution("taxonRank"))
    return K.balance(rows, "resolution", ["species", "genus", "family", "other"]).drop("place")


@query(CATALOG_SQL + "SELECT source, count(*) AS n_records FROM cat GROUP BY 1")
def source_balance(spark, sf_dir):
    return K.balance(catalog(spark, sf_dir), "source", ["project", "historical"]).drop("place")


@query(CATALOG_SQL + """SELECT "group", count(*) AS n_records, CASE "group" WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS place FROM cat GROUP BY 1""")
def group_balance(spark, sf_dir):
    return K.balance(catalog(spark, sf_dir), "group", ["R", "A"])


@query(CATALOG_SQL + "SELECT year, count(*) AS n_records FROM cat WHERE year IS NOT NULL GROUP BY 1")
def records_by_year(spark, sf_dir):
    return K.by_year(catalog(spark, sf_dir))


@query(CATALOG_SQL + ", y AS (SELECT * FROM cat WHERE year <> 1998) SELECT CAST(u.y AS INT) AS year, count(y.year) AS n_records FROM (SELECT unnest(generate_series((SELECT min(year) FROM y), (SELECT max(year) FROM y))) AS y) u LEFT JOIN y ON y.year = u.y GROUP BY 1")
def records_by_year_filled(spark, sf_dir):
    return K.by_year(catalog(spark, sf_dir).where("year <> 1998"), fill=True)


@query(CATALOG_SQL + "SELECT family, count(DISTINCT species_key) AS n_species FROM sp WHERE trim(family) <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4")
def top_families(spark, sf_dir):
    return K.richness(catalog(spark, sf_dir), "family", 4)


@query(CATALOG_SQL + "SELECT genus, count(DISTINCT species_key) AS n_species FROM sp WHERE trim(genus) <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7")
def top_genera(spark, sf_dir):
    return K.richness(catalog(spark, sf_dir), "genus", 7)


_LIST_SQL = "SELECT coalesce(nullif(trim(family), ''), '—') AS family, upper(species_key[1:1]) || lower(species_key[2:]) AS species, source, species_key FROM sp"


@query(CATALOG_SQL + f"SELECT family, species, count(*) AS n_records, count(DISTINCT source) AS n_sources FROM ({_LIST_SQL}) GROUP BY 1, 2")
def species_list(spark, sf_dir):
    return K.species_list(catalog(spark, sf_dir))


@query(
    CATALOG_SQL
    + f""", new AS (SELECT DISTINCT lower(species_key) AS k FROM (SELECT species_key FROM sp WHERE source = 'project' EXCEPT SELECT species_key FROM sp WHERE source <> 'project'))
 SELECT family, species, count(*) AS n_records, count(DISTINCT source) AS n_sources, lower(species) IN (SELECT k FROM new) AS is_new FROM ({_LIST_SQL}) GROUP BY 1, 2"""
)
def species_list_flagged(spark, sf_dir):
    return K.species_list(catalog(spark, sf_dir), "project")


@query("SELECT l_orderkey AS id, l_shipdate AS at, 'project' AS source, l_tax AS extra FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT o_orderkey, o_orderdate, 'historical', NULL FROM orders")
def catalog_union(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("at"), F.lit("project").alias("source"), F.col("l_tax").alias("extra"))
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.lit("historical").alias("source"))
    return C.union([a, b])


@query(CATALOG_SQL + """SELECT "group", species_key, genus FROM sp WHERE "group" IN ('A', 'R')""")
def species_level_rows(spark, sf_dir):
    return C.species_level(catalog(spark, sf_dir), ["A", "R"]).select("group", "species_key", "genus")


@query(CATALOG_SQL + """SELECT 'lineitem' AS label, true AS found, count(*) AS n_rows, count(*) FILTER ("group" IN ('A', 'N')) AS n_usable, 'ok' AS message FROM cat""")
def input_status(spark, sf_dir):
    return C.input_status(catalog(spark, sf_dir), spark, "lineitem", ["A", "N"])


@query(
    """SELECT p_partkey, coalesce(nullif(trim(regexp_replace(CASE WHEN p_partkey % 3 = 0 THEN ' \t' ELSE NULL END, '\\s+', ' ', 'g')), ''),
 nullif(trim(regexp_replace(CASE WHEN p_partkey % 2 = 0 THEN '  ' || p_name || '  x' END, '\\s+', ' ', 'g')), ''), p_brand) AS "scientificName" FROM part"""
)
def alias_coalesce(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.expr("CASE WHEN p_partkey % 3 = 0 THEN ' \t' END").alias("scientificName"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN concat('  ', p_name, '  x') END").alias("acceptedScientificName"), F.col("p_brand").alias("species"))
    return S.harmonised(df).select("p_partkey", "scientificName")


_COORD = "CASE WHEN l_linenumber = 1 THEN replace(CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) || '.5', '.', ',') WHEN l_linenumber = 2 THEN '1,234,5' WHEN l_linenumber = 3 THEN 'abc' WHEN l_linenumber = 4 THEN NULL ELSE '7.25' END"


@query(f"SELECT l_orderkey, l_linenumber, TRY_CAST(regexp_replace({_COORD}, ',', '.') AS DOUBLE) AS first_comma, TRY_CAST(replace({_COORD}, ',', '.') AS DOUBLE) AS every_comma FROM lineitem")
def typed_coercion(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("t", F.expr(_COORD))
    return df.select("l_orderkey", "l_linenumber", T.as_number("t").alias("first_comma"), T.to_number("t").alias("every_comma"))


_FLAG = "CASE p_size % 7 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'true' WHEN 2 THEN '1' WHEN 3 THEN 'True' WHEN 4 THEN 'T' WHEN 5 THEN 'yes' END"


@query(f"SELECT p_partkey, coalesce(({_FLAG}) IN ('TRUE', 'true', '1'), false) AS flag FROM part")
def truthy_flags(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.is_true(F.expr(_FLAG)).alias("flag"))


@query(
    """SELECT o_orderkey, CAST(CASE o_orderkey % 6 WHEN 0 THEN year(o_orderdate) WHEN 1 THEN year(o_orderdate) WHEN 2 THEN year(o_orderdate) WHEN 3 THEN year(o_orderdate) WHEN 4 THEN NULL ELSE NULL END AS INT) AS year FROM orders"""
)
def year_parse_mixed(spark, sf_dir):
    text = F.expr("CASE o_orderkey % 6 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 2 THEN concat(' ', year(o_orderdate), '.7') WHEN 3 THEN date_format(o_orderdate, 'yyyyMMdd') WHEN 4 THEN 'sem data' ELSE ' ' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.to_year(text, 2100).alias("year"))


_KINGDOM = "CASE p_size % 4 WHEN 0 THEN 'Fungi' WHEN 1 THEN 'plantae' WHEN 2 THEN 'Plantae' END"
_CLASS = "CASE WHEN p_partkey % 3 = 0 THEN 'Magnoliopsida' WHEN p_partkey % 3 = 1 THEN 'Bryopsida' END"
_STATED = "CASE WHEN p_partkey % 11 = 0 THEN 'Fungos' WHEN p_partkey % 13 = 0 THEN 'Algas' END"


@query(
    f"""SELECT p_partkey, CASE WHEN g IN ('Fanerógamas', 'Criptógamas', 'Fungos') THEN g ELSE 'Indeterminado' END AS "group" FROM (SELECT p_partkey, coalesce({_STATED},
 CASE WHEN p_size % 4 = 0 THEN 'Fungos' WHEN p_size % 4 IN (1, 2) AND p_partkey % 3 = 0 THEN 'Fanerógamas' WHEN p_size % 4 IN (1, 2) THEN 'Criptógamas' END) AS g FROM part)"""
)
def derived_group(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), F.expr(_KINGDOM).alias("kingdom"), F.expr(_CLASS).alias("class"), F.expr(_STATED).alias("group"))
    return S.coerced(S.harmonised(df), "x", "y", 2100).select(F.col("record_id").cast("long").alias("p_partkey"), "group")


@query("SELECT p_partkey, p_size = 7 AS stated, p_size % 5 IN (0, 3) AS derived FROM part")
def column_fallback(spark, sf_dir):
    """One true flag in the whole input keeps the stated flags; none derives them from ranks."""
    base = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), F.expr("CASE p_size % 5 WHEN 0 THEN 'SPECIES' WHEN 1 THEN 'GENUS' WHEN 3 THEN 'form' END").alias("taxonRank"), "p_size")
    stated = S.harmonised(base.withColumn("is_species_level", F.when(F.col("p_size") == 7, "TRUE"))).select("record_id", F.col("is_species_level").alias("stated"))
    derived = S.harmonised(base.withColumn("is_species_level", F.lit("no"))).select("record_id", F.col("is_species_level").alias("derived"))
    return stated.join(derived, "record_id").select(F.col("record_id").cast("long").alias("p_partkey"), "stated", "derived")


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS record_id, p_brand AS "scientificName", 'Até espécie' AS taxon_resolution, CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE NULL END AS latitude,
 CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE NULL END AS longitude, p_size % 2 = 0 OR p_size % 3 = 0 AS has_coordinates, lower(p_brand) AS species_key, 'origin' AS source, false AS is_project_source FROM part"""
)
def coerced_catalog(spark, sf_dir):
    price = F.expr("CASE WHEN p_size % 2 = 0 THEN CAST(p_retailprice AS STRING) ELSE 'n/a' END")
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gbifID"), F.concat(F.lit(" "), "p_brand").alias("species"), F.lit("form").alias("verbatimTaxonRank"), price.alias("decimalLatitude"), F.expr("CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS STRING) END").alias("decimalLongitude.new"), F.expr("CASE WHEN p_size % 3 = 0 THEN 1 END").alias("has_coordinates"), F.lower("p_brand").alias("species_key"))
    return S.coerced(S.harmonised(df), "origin", "project", 2100).select("record_id", "scientificName", "taxon_resolution", "latitude", "longitude", "has_coordinates", "species_key", "source", "is_project_source")


@query(CATALOG_SQL + "SELECT species_key, latitude, longitude FROM cat WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def georef_filter(spark, sf_dir):
    return catalog(spark, sf_dir).where("has_coordinates").select("species_key", "latitude", "longitude")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_acctbal <= 80 THEN -c_acctbal ELSE c_acctbal END AS longitude FROM customer")
def coord_sign_fix(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.western_longitude("c_acctbal").alias("longitude"))


@query("SELECT p_partkey, b || CASE WHEN n = 0 THEN '' ELSE '-' || n END AS slug FROM (SELECT p_partkey, b, row_number() OVER (PARTITION BY b ORDER BY p_partkey) - 1 AS n FROM (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS b FROM part))")
def slug_unique(spark, sf_dir):
    return G.unique_slugs(table(spark, sf_dir, "part"), "p_name", "p_partkey").select("p_partkey", "slug")


@query("SELECT doc_id, trim(regexp_replace(replace(lower(strip_accents(text)), 'ß', '-'), '[^a-z0-9]+', ' ', 'g')) AS name FROM documents")
def normalize_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normal_name("text").alias("name"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') AND contains(lower(p_name), 'al')")
def token_search(spark, sf_dir):
    return G.search(table(spark, sf_dir, "part"), "p_name", " RÍNG  al").select("p_partkey", "p_name")


@query("SELECT n_name, CAST(CASE n_name WHEN 'NATION_7' THEN 1 WHEN 'NATION_3' THEN 2 WHEN 'FRANCE' THEN 3 END AS INT) AS leader_rank, CASE WHEN n_name IN ('NATION_7', 'NATION_3', 'FRANCE') THEN 'leader' ELSE 'member' END AS team_role FROM nation")
def ranked_segments(spark, sf_dir):
    return G.team_order(G.ranked(table(spark, sf_dir, "nation"), "n_name", ["Nation 7", "nátion-3", "France", "NATION_7"]), "n_name").select("n_name", "leader_rank", "team_role")


@query("SELECT CASE WHEN c_custkey % 10 = 0 THEN 'leader' ELSE 'member' END AS team_role, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM customer")
def role_counts(spark, sf_dir):
    return G.role_counts(table(spark, sf_dir, "customer").withColumn("team_role", F.expr("CASE WHEN c_custkey % 10 = 0 THEN 'leader' ELSE 'member' END")))


@query("SELECT chr(CAST(65 + i AS INT)) AS letter, (SELECT arg_min(c_name, c_custkey) FROM customer WHERE upper(c_mktsegment)[1] = chr(CAST(65 + i AS INT))) AS c_name FROM range(26) t(i)")
def letter_index(spark, sf_dir):
    return G.letter_index(table(spark, sf_dir, "customer").withColumn("l", T.first_letter("c_mktsegment")), "l", "c_name", "c_custkey")


@query(
    f"""SELECT s_suppkey, (['{"', '".join(G.PALETTE)}'])[1 + (r % 8)] AS colour FROM supplier JOIN (SELECT s_nationkey AS k, row_number() OVER (ORDER BY min(s_suppkey)) - 1 AS r FROM supplier GROUP BY 1) ON k = s_nationkey"""
)
def palette_cycle(spark, sf_dir):
    return G.palette(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey").select("s_suppkey", "colour")


@query(
    """SELECT c_custkey, CAST(row_number() OVER (ORDER BY CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2 ELSE 3 END, c_nationkey NULLS LAST, c_name) AS INT) AS position FROM customer"""
)
def institution_order(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("group"), F.col("c_nationkey").alias("order"), F.col("c_name").alias("name"))
    ordered = G.institution_order(df, ["BUILDING", "AUTOMOBILE"])
    rows = G.numbered(ordered, "position", "place", F.asc_nulls_last("order"), F.expr("collate(name, 'UNICODE')"))
    return rows.select("c_custkey", F.col("position").cast("int"))


@query(
    """WITH i AS (SELECT s_name AS id, CASE s_nationkey % 3 WHEN 0 THEN 'fomento' WHEN 1 THEN 'participante' ELSE 'parceira' END AS "group", CASE WHEN s_suppkey % 2 = 0 THEN 'https://x' ELSE 'see http://x' END AS url FROM supplier),
 x AS (SELECT min(id) AS id FROM i WHERE "group" = 'parceira')
 SELECT 'fomento' AS section, *, url LIKE 'http%' AS is_link FROM (SELECT * FROM i WHERE "group" = 'fomento' UNION SELECT * FROM i WHERE id = (SELECT id FROM x)) UNION ALL
 SELECT 'participante', *, url LIKE 'http%' FROM i WHERE "group" = 'participante' UNION ALL SELECT 'parceira', *, url LIKE 'http%' FROM i WHERE "group" = 'parceira' AND id <> (SELECT id FROM x)"""
)
def institution_groups(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("id"), F.expr("CASE s_nationkey % 3 WHEN 0 THEN 'fomento' WHEN 1 THEN 'participante' ELSE 'parceira' END").alias("group"), F.expr("CASE WHEN s_suppkey % 2 = 0 THEN 'https://x' ELSE 'see http://x' END").alias("url"))
    extra = df.where("group = 'parceira'").agg(F.min("id")).first()[0]
    return G.institution_groups(df, extra or "")


_MEDIA = "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'soon' ELSE CAST(CAST(ts AS DATE) AS VARCHAR(10)) END"


@query(
    f"""SELECT event_id, kind, CAST(row_number() OVER (ORDER BY coalesce(TRY_CAST(d AS DATE), DATE '1900-01-01') DESC, event_id DESC) AS INT) AS position FROM
 (SELECT event_id, event_type AS kind, {_MEDIA} AS d FROM events WHERE event_type IN ('view', 'click'))"""
)
def media_order(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("date", F.expr(_MEDIA)).withColumn("titulo", F.col("event_type"))
    both = C.union([G.media(events.where(F.col("event_type") == k), k, "event_id") for k in ("view", "click")])
    return G.media_order(both).select(F.col("pos").alias("event_id"), "kind", "position")


@query("WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS position FROM customer), m AS (SELECT CAST(ceil(count(*) / 3.0) AS INT) AS n_pages FROM n) SELECT c_custkey, CAST((position - 1) // 3 AS INT) AS page, n_pages, CAST(((position - 1) // 3 + 1) % n_pages AS INT) AS next_page FROM n, m")
def carousel_pages(spark, sf_dir):
    rows = G.numbered(table(spark, sf_dir, "customer").select("c_custkey"), "position", "c_custkey")
    return G.pages_of(rows, "position", 3).select("c_custkey", "page", "n_pages", "next_page")


_HREF = r"""<a[^>]+href\s*=\s*[''"]([^''"]+)[''"]"""
_REFS = f"refs AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '{_HREF}', 1, 'i')) AS ref FROM pages)"


def _site_refs(spark, sf_dir) -> DataFrame:
    """References of all pages; a page's source is its path on its host."""
    pages = table(spark, sf_dir, "pages").withColumn("file", F.concat(F.lit("site/p"), F.col("page_id").cast("string")))
    return I.references(pages, {"html_href": R.LINK_PATTERNS["html_href"]}, "file", "html")


@query(f"WITH {_REFS} SELECT 'site/p' || page_id AS file, 'html_href' AS type, ref FROM refs")
def html_refs(spark, sf_dir):
    return _site_refs(spark, sf_dir).dropDuplicates(["file", "type", "ref"])


@query("SELECT page_id, regexp_replace(trim(url), '[?#].*$', '') AS ref, regexp_matches(url, '^(https?:)?//', 'i') AS is_external, length(regexp_replace(url, '[?#].*$', '')) > 40 OR regexp_replace(url, '[?#].*$', '') = '' AS is_invalid FROM pages")
def clean_refs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", R.clean_ref("url").alias("ref"), R.is_external("url").alias("is_external"), R.is_invalid(R.clean_ref("url"), 40).alias("is_invalid"))


#: What is there: the first word of each nation's pages, as a site's files.
_PATHS = r"paths AS (SELECT DISTINCT CASE WHEN page_id % 3 = 0 THEN upper(p) ELSE p END AS path FROM (SELECT page_id, regexp_extract(html, 'href=\"/([^\"]+)\"', 1) AS p FROM pages) WHERE p <> '')"


def _paths(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r'href="/([^"]+)"', 1).alias("p")).where("p <> ''")
    return p.select(F.expr("CASE WHEN page_id % 3 = 0 THEN upper(p) ELSE p END").alias("path")).distinct()


_TARGETS = f"{_REFS}, {_PATHS}, t AS (SELECT DISTINCT 'site/p' || page_id AS file, ref, ltrim(ref, '/') AS target FROM (SELECT page_id, regexp_replace(ref, '[?#].*$', '') AS ref FROM refs) WHERE ref <> '')"


@query(f"WITH {_TARGETS} SELECT file, target, target IN (SELECT path FROM paths) AS \"exists\" FROM t")
def checked_refs(spark, sf_dir):
    return I.checked(I.cleaned(_site_refs(spark, sf_dir)), _paths(spark, sf_dir)).select("file", "target", "exists")


@query(f"WITH {_TARGETS} SELECT file, target FROM t WHERE lower(target) NOT IN (SELECT lower(path) FROM paths)")
def missing_refs(spark, sf_dir):
    paths = _paths(spark, sf_dir)
    return I.missing(I.checked(I.cleaned(_site_refs(spark, sf_dir)), paths), paths).select("file", "target")


@query(f"WITH {_TARGETS} SELECT file, target, (SELECT min(path) FROM paths WHERE lower(path) = lower(target)) AS case_match FROM t WHERE target NOT IN (SELECT path FROM paths) AND lower(target) IN (SELECT lower(path) FROM paths)")
def case_match(spark, sf_dir):
    paths = _paths(spark, sf_dir)
    return I.wrong_case(I.checked(I.cleaned(_site_refs(spark, sf_dir)), paths), paths).select("file", "target", "case_match")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_quantity = 50 AND l_discount = 0)")
def unused_assets(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    used = table(spark, sf_dir, "lineitem").where("l_quantity = 50 and l_discount = 0").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.upper("p_name").alias("target"))
    return I.unused(parts.select("p_partkey", "p_name"), used, "p_name")


@query("SELECT p_partkey, path, lower(path) AS lower_path FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END || p_size AS path FROM part) QUALIFY count(*) OVER (PARTITION BY lower(path)) > 1")
def case_duplicates(spark, sf_dir):
    return I.case_duplicates(table(spark, sf_dir, "part").select("p_partkey", F.expr("concat(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END, p_size)").alias("path")))


@query("SELECT doc_id, n_chars / 1024.0 AS size FROM documents WHERE n_chars / 1024.0 > 8")
def large_items(spark, sf_dir):
    return I.large(table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 1024).alias("size")), "size", 8)


@query("SELECT doc_id FROM documents WHERE doc_id % 29 = 0")
def empty_items(spark, sf_dir):
    return I.empty(table(spark, sf_dir, "documents").select("doc_id", F.expr("CASE WHEN doc_id % 29 = 0 THEN 0 ELSE length(text) END").alias("n_bytes"))).select("doc_id")


@query("SELECT e AS expected_file, e IN (SELECT n_name FROM nation) AS \"exists\" FROM (VALUES ('NATION_1'), ('NATION_2'), ('ATLANTIS')) t(e)")
def expected_items(spark, sf_dir):
    return I.expected(spark, ["NATION_1", "NATION_2", "ATLANTIS"], table(spark, sf_dir, "nation"), "n_name")


@query(f"WITH {_TARGETS}, n AS (SELECT (SELECT count(*) FROM t WHERE lower(target) NOT IN (SELECT lower(path) FROM paths)) AS a, (SELECT count(*) FROM documents WHERE n_chars > 8192) AS b) SELECT 'critical' AS kind, 'missing links' AS item, a AS n FROM n UNION ALL SELECT 'warning', 'large files', b FROM n UNION ALL SELECT 'total', 'critical', a FROM n")
def check_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("n_chars").alias("size_mb"))
    return I.summary({"missing links": ("critical", missing_refs(spark, sf_dir)), "large files": ("warning", I.large(docs, most=8192))})


@query(
    """SELECT CASE pr WHEN 1 THEN 'alta' WHEN 2 THEN 'média' WHEN 3 THEN 'baixa' ELSE 'manter' END AS priority, type, file, problem, action, CAST(pr AS INT) AS place FROM (
 SELECT 1 AS pr, 'missing' AS type, s_name AS file, 'no nation ' || s_nationkey AS problem, 'add' AS action FROM supplier WHERE s_acctbal < 0 AND s_name NOT LIKE '%.html'
 UNION ALL SELECT CASE WHEN p_size = 7 THEN 4 ELSE 3 END, 'empty', p_name, 'empty', CASE WHEN p_size = 7 THEN 'keep' ELSE 'remove' END FROM part WHERE p_size IN (7, 8)
 UNION ALL SELECT 2, 'link', c_name, 'broken ' || c_nationkey, 'mend' FROM customer WHERE c_acctbal < -900)"""
)
def action_plan(spark, sf_dir):
    s = I.sources_flagged(table(spark, sf_dir, "supplier").where("s_acctbal < 0"), "s_name").where("not is_generated and not is_optional")
    p, c = table(spark, sf_dir, "part").where("p_size in (7, 8)"), table(spark, sf_dir, "customer").where("c_acctbal < -900")
    return I.action_plan(
        [
            I.issues(s, "alta", "missing", F.col("s_name"), F.concat(F.lit("no nation "), "s_nationkey"), "add"),
            I.issues(p, F.expr("CASE WHEN p_size = 7 THEN 'manter' ELSE 'baixa' END"), "empty", F.col("p_name"), F.lit("empty"), F.expr("CASE WHEN p_size = 7 THEN 'keep' ELSE 'remove' END")),
            I.issues(c, "média", "link", F.col("c_name"), F.concat(F.lit("broken "), "c_nationkey"), "mend"),
        ]
    )


_ASSET = "CASE p_size % 4 WHEN 0 THEN 'figures/brand/' WHEN 1 THEN 'figures/logo_' WHEN 2 THEN 'photos/' ELSE 'docs/old/' END || p_partkey || '.png'"


@query(f"SELECT path, p_size % 4 <> 2 AS keep_by_rule, contains(path, '/old/') AS move_by_extra_rule, CASE WHEN contains(path, '/old/') THEN 'quarantine_candidate' WHEN p_size % 4 <> 2 THEN 'keep' ELSE 'quarantine_candidate' END AS action FROM (SELECT p_size, {_ASSET} AS path FROM part)")
def quarantine_plan(spark, sf_dir):
    return I.quarantine(table(spark, sf_dir, "part").select(F.expr(_ASSET).alias("path")), move=["/old/"])


@query("SELECT p_partkey FROM part WHERE p_size % 4 = 1 AND p_partkey % 2 = 0")
def source_clutter(spark, sf_dir):
    path = F.expr("concat(CASE WHEN p_partkey % 2 = 0 THEN 'pages/' ELSE 'docs/' END, p_partkey, CASE p_size % 4 WHEN 1 THEN ' - Copy.qmd' WHEN 2 THEN ' - copy.txt' ELSE '.qmd' END)")
    return I.clutter(table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))).select("p_partkey")


@query("SELECT p_partkey AS id, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 1)")
def plan_still_there(spark, sf_dir):
    plan = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand")
    return I.still_there(plan, table(spark, sf_dir, "lineitem").where("l_quantity = 1").select(F.col("l_partkey").alias("id")), "id")


@query("SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY 1")
def target_counts(spark, sf_dir):
    return I.target_counts(table(spark, sf_dir, "lineitem").where("l_discount > 0.05"), "l_partkey")


@query("SELECT user_id FROM events WHERE (event_type = 'view' AND value > 80) OR (event_type = 'click' AND value > 60) OR (event_type = 'purchase' AND value > 20) GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events WHERE (event_type = 'view' AND value > 80) OR (event_type = 'click' AND value > 60) OR (event_type = 'purchase' AND value > 20))")
def linked_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("(event_type = 'view' AND value > 80) OR (event_type = 'click' AND value > 60) OR (event_type = 'purchase' AND value > 20)")
    return L.linked_keys(rows, "event_type", "user_id")


@query("SELECT event_id FROM events WHERE user_id % 10 = 0 OR user_id IN (3, 7)")
def null_matches_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("k", F.expr("CASE WHEN user_id % 10 <> 0 THEN user_id END")).where(L.matches("k", [3, 7])).select("event_id")


@query("SELECT event_id FROM events WHERE value BETWEEN 10 AND 12.5")
def range_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").where(L.in_range("value", 10, 12.5)).select("event_id")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice > 50000 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS opacity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_tax BETWEEN 0.02 AND 0.04")
def bbox_brush(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where(L.in_box("l_quantity", "l_tax", 10, 0.02, 20, 0.04)).select("l_orderkey", "l_linenumber", L.opacity(F.col("l_extendedprice") > 50000).alias("opacity"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def group_key_expand(spark, sf_dir):
    return L.keys_of_groups(table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey", ["1-URGENT", "5-LOW"])


@query("WITH a AS (SELECT l_partkey AS k FROM lineitem WHERE l_quantity < 5), b AS (SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45) SELECT k, 'removed' AS change FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'added' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)")
def set_diff_added_removed(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_quantity")
    return L.difference(rows.where("l_quantity < 5"), rows.where("l_quantity > 45"), "k")


@query("SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '\"'), '&amp;', '&'), '&am$', '&am'), '\\s+', ' ', 'g')) AS title FROM pages")
def page_title(spark, sf_dir):
    """Titles by the preview reader; pages are told apart by their ids as urls."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url"), "html")
    return preview.previews(pages).select(F.col("url").cast("long").alias("page_id"), "title")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '—' WHEN o_orderkey % 7 = 0 THEN 'n/d' ELSE replace(format('{:,}', o_custkey * 1234), ',', '.') END AS label FROM orders")
def fmt_ptbr(spark, sf_dir):
    text = F.expr("CASE WHEN o_orderkey % 9 = 0 THEN ' ' WHEN o_orderkey % 7 = 0 THEN 'n/d' ELSE CAST(o_custkey * 1234 AS STRING) END")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.format_int(text).alias("label"))


@query("SELECT page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped, CASE WHEN regexp_matches(url, '^https?://') THEN 'link' ELSE 'text' END AS kind, repeat('../', CAST(greatest(len(string_split(url, '/')) - 3, 0) AS INT)) AS up FROM pages")
def html_labels(spark, sf_dir):
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select("page_id", T.html_escape("url", attribute=True).alias("escaped"), F.when(R.is_web("url"), "link").otherwise("text").alias("kind"), R.up_prefix(F.regexp_replace(path, "/$", "/x")).alias("up"))


_ROUTES = {"/acesso/": "/en/data-access/", "/": "/en/", "/en/": "/", "/team/index.html": "/en/team/"}
_ROUTE = "CASE c_custkey % 6 WHEN 0 THEN '/' WHEN 1 THEN '//acesso/index.html' WHEN 2 THEN '/team/index.html' WHEN 3 THEN '/en/novo' WHEN 4 THEN 'x' ELSE '/acesso' END"


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '/en/' WHEN 1 THEN '/en/data-access/' WHEN 2 THEN '/en/team/' WHEN 3 THEN '/' WHEN 4 THEN '/en/' ELSE '/en/data-access/' END AS target FROM customer")
def language_routes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", R.route(F.expr(_ROUTE), _ROUTES).alias("target"))


@query(
    """WITH a AS (SELECT c_custkey AS pos, CASE WHEN c_custkey % 5 = 0 THEN 'Viagem ' || row_number() OVER (ORDER BY c_custkey) ELSE 'Rio Cuieras' || (c_custkey % 3) END AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'E-' || c_custkey END AS id,
 CASE WHEN c_acctbal > 0 AND c_acctbal <= 80 THEN -c_acctbal ELSE c_acctbal END AS longitude FROM customer),
 b AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM a),
 c AS (SELECT *, s || CASE WHEN row_number() OVER (PARTITION BY id IS NULL, s ORDER BY pos) = 1 THEN '' ELSE '-' || (row_number() OVER (PARTITION BY id IS NULL, s ORDER BY pos) - 1) END AS made FROM b)
 SELECT pos, name, CASE WHEN id IS NULL THEN made ELSE lower(id) END AS expedition_id, CASE WHEN id IS NULL THEN made ELSE lower(id) END AS folder, longitude, true AS has_coords FROM c"""
)
def expeditions(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE concat('Rio Cuieras', c_custkey % 3) END").alias("nome"), F.expr("CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('E-', c_custkey) END").alias("codigo"), F.lit("-0,13").alias("lat"), F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")).alias("lng"))
    return G.expeditions(df, "row", "Viagem").select("pos", "name", "expedition_id", "folder", "longitude", "has_coords")


@query("SELECT s_suppkey, 's ' || (s_suppkey % 3) AS member_key, 'S' AS first_letter, 's_' || (s_suppkey % 3) || '.jpg' AS photo_file, CASE WHEN s_suppkey % 3 = 1 THEN 'leader' ELSE 'member' END AS team_role, coalesce(nullif(s_name, 'x'), '') AS email FROM supplier")
def team_registry(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr("concat(' S-', s_suppkey % 3)").alias("Nome"), F.col("s_name").alias("e mail"))
    return G.team(df, "s_suppkey", ["S 1"]).select("s_suppkey", "member_key", "first_letter", "photo_file", "team_role", "email")


_GROUPED = "SELECT o_orderkey, o_orderpriority AS \"group\" FROM orders"


@query(f"SELECT 'all' AS asked, \"group\", count(*) AS n FROM ({_GROUPED}) GROUP BY ALL UNION ALL SELECT 'one', \"group\", count(*) FROM ({_GROUPED}) WHERE \"group\" = '1-URGENT' GROUP BY ALL")
def optional_group(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("group"))
    parts = [C.of_group(df, g).groupBy("group").agg(F.count("*").alias("n")).select(F.lit(asked).alias("asked"), "group", "n") for asked, g in (("all", None), ("one", "1-URGENT"))]
    return parts[0].unionByName(parts[1])


@query("SELECT o_orderkey, round_even(o_orderkey / 64.0::DOUBLE, 5) AS rounded FROM orders")
def rounded_coords(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.round5(F.col("o_orderkey") / F.lit(64.0)).alias("rounded"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'jpg' WHEN 1 THEN 'gz' ELSE '' END AS ext, o_orderkey / 1048576.0::DOUBLE AS mib FROM orders")
def sized_files(spark, sf_dir):
    path = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'img/a.JPG' WHEN 1 THEN 'data/b.tar.gz' ELSE 'README' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", R.extension(path).alias("ext"), R.mebibytes("o_orderkey").alias("mib"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'docs/' WHEN 1 THEN '/other/' ELSE 'docs/sub/' END || c_name AS path FROM customer")
def paths_under_root(spark, sf_dir):
    path = F.expr(r"concat(CASE c_custkey % 3 WHEN 0 THEN '/srv/a.b+c/docs/' WHEN 1 THEN '/other/' ELSE '\\srv\\a.b+c\\docs\\sub\\' END, c_name)")
    return table(spark, sf_dir, "customer").select("c_custkey", R.under_root(path, "/srv/a.b+c").alias("path"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN NULL ELSE 'trip ' || c_custkey END AS folder FROM customer")
def clean_folders(spark, sf_dir):
    name = F.expr(r"CASE c_custkey % 4 WHEN 0 THEN concat('./photos/trip\u00a0', c_custkey, '/') WHEN 1 THEN concat('\\photos\\trip ', c_custkey) WHEN 2 THEN concat('\u00a0trip ', c_custkey, '//') ELSE ' / ' END")
    return table(spark, sf_dir, "customer").select("c_custkey", F.trim(R.clean_folder(name, ("photos",))).alias("folder"))


@query("SELECT c_custkey, 'a,' || c_custkey AS first_part, 'b' AS last_part, 2 AS n_parts FROM customer")
def split_escaped_parts(spark, sf_dir):
    parts = R.split_escaped(F.concat(F.lit("a\\,"), F.col("c_custkey").cast("string"), F.lit(",b")), ",")
    return table(spark, sf_dir, "customer").select("c_custkey", parts[0].alias("first_part"), F.element_at(parts, -1).alias("last_part"), F.size(parts).alias("n_parts"))


# A concave polygon with a hole for each customer; of every third one a second part, wider than the first.
_SHAPE = """SELECT c_custkey, (c_custkey % 300 - 150)::DOUBLE AS x, (c_custkey % 140 - 70)::DOUBLE AS y, 1.0 + c_custkey % 4 AS k FROM customer"""
_POSITIONS = f"""SELECT c_custkey, part, ring, generate_subscripts(ps, 1) - 1 AS position, unnest(ps) AS p FROM (
 SELECT c_custkey, 0 AS part, 0 AS ring, [[x, y], [x + 6, y], [x + 6, y + 5], [x + 4, y + 5], [x + 4, y + k], [x + 2, y + k], [x + 2, y + 5], [x, y + 5], [x, y]] AS ps FROM ({_SHAPE})
 UNION ALL SELECT c_custkey, 0, 1, [[x + 0.25, y + 0.25], [x + 0.25, y + 0.5], [x + 0.75, y + 0.5], [x + 0.25, y + 0.25]] FROM ({_SHAPE})
 UNION ALL SELECT c_custkey, 1, 0, [[x + 10, y], [x + 20, y + 1], [x + 12, y + 3], [x + 10, y]] FROM ({_SHAPE}) WHERE c_custkey % 3 = 0)"""


def _shapes(spark, sf_dir):
    """(c_custkey, geometry) of the same polygons as GeoJSON text."""
    at = lambda dx, dy: F.array((F.col("x") + dx).cast("double"), (F.col("y") + dy).cast("double"))
    k = F.col("k")
    outer = F.array(at(0, 0), at(6, 0), at(6, 5), at(4, 5), at(4, k), at(2, k), at(2, 5), at(0, 5), at(0, 0))
    hole = F.array(at(0.25, 0.25), at(0.25, 0.5), at(0.75, 0.5), at(0.25, 0.25))
    other = F.array(at(10, 0), at(20, 1), at(12, 3), at(10, 0))
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_custkey % 300 - 150 AS x", "c_custkey % 140 - 70 AS y", "1 + c_custkey % 4 AS k")
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(outer, hole).alias("coordinates")))
    return rows.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, P.multi_polygon(F.array(F.array(outer, hole), F.array(other)))).otherwise(one).alias("geometry"))


@query(f"SELECT c_custkey, part, ring, position, p[1] AS lon, p[2] AS lat FROM ({_POSITIONS})")
def polygon_rings(spark, sf_dir):
    return P.rings(_shapes(spark, sf_dir), "geometry", "c_custkey").drop("altitude")


@query(f"""WITH p AS (SELECT *, p[1] AS px, p[2] AS py FROM ({_POSITIONS})),
m AS (SELECT c_custkey, part, (min(py) + max(py)) / 2 AS mid FROM p GROUP BY 1, 2),
h AS (SELECT c_custkey, part, (max(py) FILTER (py <= mid) + min(py) FILTER (py > mid)) / 2 AS h FROM p JOIN m USING (c_custkey, part) GROUP BY 1, 2),
e AS (SELECT c_custkey, part, px AS ax, py AS ay, lead(px) OVER w AS bx, lead(py) OVER w AS b_y FROM p WINDOW w AS (PARTITION BY c_custkey, part, ring ORDER BY position)),
x AS (SELECT c_custkey, part, h, ax + (h - ay) / (b_y - ay) * (bx - ax) AS x, row_number() OVER (PARTITION BY c_custkey, part ORDER BY ax + (h - ay) / (b_y - ay) * (bx - ax)) - 1 AS n
  FROM e JOIN h USING (c_custkey, part) WHERE bx IS NOT NULL AND (ay <= h) <> (b_y <= h)),
s AS (SELECT c_custkey, part, n // 2 AS n, any_value(h) AS h, max(x) - min(x) AS width, (max(x) + min(x)) / 2 AS mid FROM x GROUP BY 1, 2, 3)
SELECT c_custkey, mid AS lon, h AS lat FROM s QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY width DESC, part, n) = 1""")
def label_points(spark, sf_dir):
    return P.label_points(_shapes(spark, sf_dir), "geometry").select("c_custkey", F.col("label_lon").alias("lon"), F.col("label_lat").alias("lat"))


@query("SELECT o_orderkey, round(-63 + (o_orderkey % 60000) / 10000.0::DOUBLE - 3, 7) AS lon, round((o_orderkey % 7900) / 100.0::DOUBLE - 40, 7) AS lat FROM orders")
def unprojected(spark, sf_dir):
    """Degrees to zone 20 south and back by the zone's inverse series."""
    lon, lat = F.expr("-66 + (o_orderkey % 60000) / 10000D"), F.expr("(o_orderkey % 7900) / 100D - 40")
    there = table(spark, sf_dir, "orders").select("o_orderkey", P.from_degrees(lon, lat, 31980).alias("p"))
    return there.select("o_orderkey", P.to_degrees("p.x", "p.y", 31980).alias("d")).select("o_orderkey", F.round("d.lon", 7).alias("lon"), F.round("d.lat", 7).alias("lat"))


@query("""SELECT s_suppkey, trim(regexp_replace(lower(strip_accents(replace(replace(replace(name, 'Œ', 'OE'), 'ł', 'l'), 'Ø', 'O'))), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  contains(lower(strip_accents(name)), 'sahin') AS found
FROM (SELECT s_suppkey, ['Čapek ', 'Œuvre ', 'Michał ', 'Erdős ', 'Şahin ', 'Nguyễn ', 'Ørsted '][1 + (s_suppkey % 7)::INT] || s_name AS name FROM supplier)""")
def folded_scripts(spark, sf_dir):
    """Names of several scripts of the Latin alphabet, some with their marks apart, as slugs and as found by a search."""
    names = ["Čapek ", "Œuvre ", "Michał ", "Erdo\u030bs ", "Şahin ", "Nguye\u0302\u0303n ", "Ørsted "]
    name = F.concat(F.element_at(F.array(*map(F.lit, names)), (F.col("s_suppkey") % 7 + 1).cast("int")), F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.slug(name).alias("slug"), T.normal_name(name).contains("sahin").alias("found"))


@query("""SELECT o_orderkey::VARCHAR AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate + to_milliseconds(1000 + o_orderkey % 86399000), '%Y-%m-%d %H:%M:%S.%g') AS at,
  CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice / 3 END AS price, CASE o_orderkey % 3 WHEN 0 THEN ' <' || o_orderpriority || '>_x0041_ ' END AS priority, CASE o_orderkey % 2 WHEN 0 THEN 'TRUE' ELSE 'FALSE' END AS even FROM orders""")
def workbook_rows(spark, sf_dir):
    """Orders with dates, times, numbers, flags, text and blanks, through workbooks that the tasks write."""
    df = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "cast(o_orderdate as date) AS day", "timestampadd(MILLISECOND, 1000 + o_orderkey % 86399000, o_orderdate) AS at", "CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice / 3 END AS price",
        "CASE o_orderkey % 3 WHEN 0 THEN ' <' || o_orderpriority || '>_x0041_ ' END AS priority", "o_orderkey % 2 = 0 AS even",
    )
    path = new_folder(spark, "orders")
    xlsx.write_xlsx(df, path)
    at = F.when(F.length("at") == 19, F.concat("at", F.lit(".000"))).otherwise(F.col("at"))
    return xlsx.read_xlsx(spark, path).withColumn("price", F.col("price").cast("double")).withColumn("at", at)
