"""Small registries: expeditions, people, media, institutions. Row order is a column, as Spark keeps none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.functions import refs as R
from verdant.functions import text as T
from verdant.plans.schema import column, first_value, pick, pick_like, value_or

# Names of alternative columns.
EXPEDITION_COLUMNS = {
    "latitude": ["latitude", "Latitude", "lat", "Lat", "LAT", "decimalLatitude", "decimal_latitude", "y", "Y"],
    "longitude": ["longitude", "Longitude", "lon", "Lon", "long", "Long", "LONG", "lng", "Lng", "decimalLongitude", "decimal_longitude", "x", "X"],
    "id": ["expedicao_id", "expedição_id", "id", "ID", "slug", "codigo", "código"],
    "name": ["expedicao", "expedição", "Expedicao", "Expedição", "expedition", "nome", "name"],
    "place": ["localidade", "local", "Localidade", "Local", "site", "ponto", "Ponto", "locality"],
    "date": ["data", "date", "Data", "Date", "periodo", "período", "Periodo"],
    "community": ["comunidade", "Comunidade", "community", "aldeia", "Aldeia"],
    "town": ["municipio", "município", "Municipio", "Município", "city", "cidade"],
    "team": ["equipe", "Equipe", "team", "pesquisadores", "coletores", "collectors"],
    "notes": ["observacoes", "observações", "obs", "Obs", "notes", "Notas", "comentarios", "comentários"],
    "summary": ["resumo", "Resumo", "descricao", "descrição", "Description", "description"],
    "folder": ["pasta_fotos", "fotos", "folder", "photo_folder", "pasta", "imagens"],
}
MEDIA_COLUMNS = {
    "url": (["url", "link", "href"], "#"),
    "title": (["titulo", "título", "title", "post"], ""),
    "image": (["imagem", "image", "thumb", "thumbnail", "capa"], ""),
    "description": (["descricao", "descrição", "resumo", "caption", "texto"], ""),
    "date_text": (["data", "date", "ano"], ""),
    "outlet": (["veiculo", "veículo", "fonte", "source"], ""),
}
MEMBER_COLUMNS = ["Member", "Nome", "Name", "Membro", "Pessoa"]
INSTITUTION_GROUPS = ["fomento", "participante", "parceira"]
MEDIA_LABELS = {"instagram": "Instagram", "reportagem": "Reportagem", "youtube": "YouTube"}
PALETTE = ["#A93632", "#59602F", "#D99A27", "#626A38", "#6B4E9B", "#2F6F83", "#C46A2A", "#8A3D3B"]


def numbered(df: DataFrame, out: str, *order: Column | str) -> DataFrame:
    """``df`` with its rows' numbers, from 1, in an order; no task gets more than its range of the order.

    The rows are sorted by range, each range is counted, and a row's number is
    its place in the range after the ranges before. The order should be total.
    """
    rows = df.orderBy(*order).pandas_api().to_spark(index_col=out)
    return rows.withColumn(out, F.col(out) + 1).select(*df.columns, out)


def placed(df: DataFrame, out: str, key: str, *order: Column | str) -> DataFrame:
    """``df`` with the places, from 0, of its rows among those of the same key (null is one); a key of any size spreads over tasks."""
    rows = numbered(df, "_place_number", F.asc_nulls_first(key), *order)
    first = rows.groupBy(F.col(key).alias("_place_key")).agg(F.min("_place_number").alias("_place_first"))
    return rows.join(first, F.col(key).eqNullSafe(F.col("_place_key"))).withColumn(out, F.col("_place_number") - F.col("_place_first")).drop("_place_number", "_place_key", "_place_first")


def unique_slugs(df: DataFrame, name: str, pos: str, out: str = "slug") -> DataFrame:
    """Slugs, repeated ones with -1, -2 … in row order, the first plain.

    A made slug that some row has of itself gets the next free number. Rows of
    a slug and the numbers that are taken, each at the count of free numbers
    before it, are put into one order: a row's place there is its number.
    """
    based = df.withColumn("_base", T.slug(name))
    parts = lambda k: F.regexp_extract("_full", r"^(.+)-([1-9]\d{0,8})$", k)
    taken = based.select(F.col("_base").alias("_full")).distinct().select(parts(1).alias("_base"), parts(2).cast("string").alias("_t")).where("_t <> ''")
    taken = placed(taken.withColumn("_t", F.col("_t").cast("long")), "_i", "_base", "_t")
    gaps = taken.select("_base", (F.col("_t") - F.col("_i") - 1).alias("_n"), F.lit(1).alias("_taken"))
    rows = placed(based, "_n", "_base", pos).withColumn("_taken", F.lit(0)).unionByName(gaps, allowMissingColumns=True)
    rows = placed(rows, "_number", "_base", "_n", "_taken").where("_taken = 0")
    return rows.withColumn(out, F.when(F.col("_n") == 0, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), F.col("_number").cast("string")))).drop("_base", "_n", "_taken", "_number")


def expeditions(df: DataFrame, pos: str, default_name: str = "Expedição", folder_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Expeditions of any column names: defaults, unique ids, folders, repaired longitudes.

    Missing names count by row; ids are made from names where missing and then
    all slugged again; a missing folder is the id.
    """
    found = {k: pick(df.columns, v, k in ("latitude", "longitude")) for k, v in EXPEDITION_COLUMNS.items()}
    get = lambda k: column(df, found[k]).cast("string") if found[k] else F.lit(None).cast("string")
    rows = df.select(F.col(pos).alias("pos"), T.to_number(get("latitude")).alias("latitude"), T.to_number(get("longitude")).alias("longitude"), *[get(k).alias(k) for k in EXPEDITION_COLUMNS if k not in ("latitude", "longitude")])
    rows = numbered(rows, "_index", "pos")
    rows = rows.withColumn("name", F.when(T.is_filled("name"), F.col("name")).otherwise(F.concat(F.lit(f"{default_name} "), F.col("_index").cast("string")))).drop("_index")
    missing = rows.where(~T.is_filled("id"))
    made = unique_slugs(missing, "name", "pos", "_made").select(F.col("pos").alias("_pos"), "_made")
    rows = rows.join(made, F.col("pos") == F.col("_pos"), "left").withColumn("id", F.coalesce("_made", "id")).drop("_pos", "_made")
    rows = unique_slugs(rows, "id", "pos", "expedition_id").drop("id")
    folder = R.clean_folder("folder", folder_prefixes)
    rows = rows.withColumn("folder", F.when(T.is_filled(folder), folder).otherwise(F.col("expedition_id"))).withColumn("section_id", F.concat(F.lit("exp-"), "expedition_id"))
    return rows.withColumn("longitude", T.western_longitude("longitude")).withColumn("has_coords", F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def palette(df: DataFrame, name: str, pos: str, colours: list[str] = PALETTE) -> DataFrame:
    """``df`` with a colour by the order in which its names first appear, over and over through the palette."""
    first = df.groupBy(name).agg(F.min(pos).alias("_first"))
    ranked = numbered(first.withColumnRenamed(name, "_name"), "_rank", "_first").select("_name", (F.col("_rank") - 1).alias("_rank"))
    table = F.array(*map(F.lit, colours))
    return df.join(ranked, F.col(name).eqNullSafe(F.col("_name"))).withColumn("colour", F.get(table, F.pmod("_rank", F.lit(len(colours))))).drop("_name", "_rank")


def with_photos(df: DataFrame, files: DataFrame, folder: str = "folder") -> DataFrame:
    """``df`` with the sorted photo files (columns folder, file) of each row's folder, none as an empty list."""
    lists = files.groupBy(F.col("folder").alias("_folder")).agg(F.sort_array(F.collect_list("file")).alias("photos"))
    return df.join(lists, F.col(folder) == F.col("_folder"), "left").drop("_folder").withColumn("photos", F.coalesce("photos", F.array().cast("array<string>")))


def ranked(df: DataFrame, name: str, leaders: list[str], leader: str = "leader", other: str = "member") -> DataFrame:
    """``df`` with leader_rank, the place in a list by normalised name (null outside), and team_role."""
    return _with_rank(df, name, leaders).withColumn("team_role", F.when(F.col("leader_rank").isNotNull(), leader).otherwise(other))


def _with_rank(df: DataFrame, name: str, leaders: list[str]) -> DataFrame:
    table: dict[str, int] = {}
    for k, x in enumerate(leaders, 1):
        table.setdefault(" ".join("".join(c if c.isascii() and c.isalnum() else " " for c in T.plain(x).lower()).split()), k)
    if not table:
        return df.withColumn("leader_rank", F.lit(None).cast("int"))
    ranks = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return df.withColumn("leader_rank", F.try_element_at(ranks, T.normal_name(name)))


def team(df: DataFrame, pos: str, leaders: list[str]) -> DataFrame:
    """People of any column names: keys, unique slugs, letters, photos, roles; rows without a name go."""
    name = pick_like(df.columns, MEMBER_COLUMNS)
    rows = df.withColumn("member", F.trim(column(df, name).cast("string"))).where(T.is_filled("member"))
    rows = rows.withColumn("email", first_value(df, ["Email", "E-mail", "Mail"]))
    rows = rows.withColumn("member_key", T.normal_name("member")).withColumn("first_letter", T.first_letter("member")).withColumn("photo_file", T.photo_file("member"))
    return ranked(unique_slugs(rows, "member", pos, "member_slug"), "member", leaders)


def team_order(df: DataFrame, name: str = "member") -> DataFrame:
    """Leaders by rank and then name, all others by name after them."""
    return df.orderBy(F.asc_nulls_last("leader_rank"), name)


def role_counts(df: DataFrame) -> DataFrame:
    """People per role, and in all (role null)."""
    return df.rollup("team_role").agg(F.count("*").alias("n"))


def letter_index(df: DataFrame, letter: str, value: str, pos: str) -> DataFrame:
    """A to Z, each with the value of its first row, or null."""
    letters = df.sparkSession.range(26).select(F.char(F.col("id") + 65).alias("letter"))
    first = df.groupBy(F.col(letter).alias("_letter")).agg(F.min_by(value, pos).alias(value))
    return letters.join(F.broadcast(first.where(F.col("_letter").between("A", "Z"))), F.col("letter") == F.col("_letter"), "left").drop("_letter")


def search(df: DataFrame, text: Column | str, query: str, role: str | None = None) -> DataFrame:
    """Rows whose text has all words of a query, marks and case aside, of a role if given."""
    hit = T.contains_all(text, F.lit(query))
    return df.where(hit if role is None else hit & (F.col("team_role") == role))


def media(df: DataFrame, kind: str, pos: str) -> DataFrame:
    """A media table of any column names as (kind, url, title, image, description, date_text, outlet, pos)."""
    return df.select(F.lit(kind).alias("kind"), *[value_or(df, names, default).alias(k) for k, (names, default) in MEDIA_COLUMNS.items()], F.col(pos).alias("pos"))


def media_order(df: DataFrame, default_title: str = "—") -> DataFrame:
    """Newest first, undated as 1900-01-01, ties in reverse row order; blank titles get the default; position counts from 1."""
    when = F.coalesce(T.to_date("date_text"), F.lit("1900-01-01").cast("date"))
    rows = df.withColumn("title", F.when(T.is_filled("title"), F.col("title")).otherwise(default_title)).withColumn("_when", when)
    return numbered(rows, "position", F.desc("_when"), F.desc("pos")).drop("_when").withColumn("position", F.col("position").cast("int")).orderBy("position")


def media_label(kind: Column | str) -> Column:
    table = F.create_map(*[F.lit(v) for kv in MEDIA_LABELS.items() for v in kv])
    return F.coalesce(F.try_element_at(table, F.col(kind) if isinstance(kind, str) else kind), F.lit("Mídia"))


def pages_of(df: DataFrame, position: str, per_page: int) -> DataFrame:
    """``df`` with page (from 0), n_pages and next_page (wrapping round)."""
    n_pages = df.agg(F.ceil(F.max(position) / per_page).cast("int").alias("n_pages"))
    rows = df.crossJoin(F.broadcast(n_pages)).withColumn("page", F.floor((F.col(position) - 1) / per_page).cast("int"))
    return rows.withColumn("next_page", F.pmod(F.col("page") + 1, F.col("n_pages")).cast("int"))


def institution_order(df: DataFrame, groups: list[str] = INSTITUTION_GROUPS) -> DataFrame:
    """By group in the order of a list (others last), then order, then name by the Unicode collation."""
    from verdant.operators.kpi import place_in

    return df.withColumn("place", place_in("group", groups)).orderBy("place", F.asc_nulls_last("order"), F.expr("collate(name, 'UNICODE')"))


def institution_groups(df: DataFrame, funder_id: str) -> DataFrame:
    """(section, …): funders with one more institution by id, participants, partners without that one; funders are distinct."""
    cols = df.columns
    funders = df.where(F.col("group") == "fomento").unionByName(df.where(F.col("id") == funder_id)).distinct()
    parts = [("fomento", funders), ("participante", df.where(F.col("group") == "participante")), ("parceira", df.where((F.col("group") == "parceira") & (F.col("id") != funder_id)))]
    out = [d.select(F.lit(s).alias("section"), *cols) for s, d in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).withColumn("is_link", R.is_web("url"))
