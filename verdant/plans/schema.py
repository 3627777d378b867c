"""The catalog's schema, and how inputs of any columns are brought to it.

All resolution of columns happens on names, on the driver; the plan is one
projection per input, so only columns that are used reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from verdant.functions import text as T

CATALOG = StructType(
    [StructField(c, StringType()) for c in ("source", "scientificName", "taxonRank", "taxon_resolution")]
    + [StructField("is_species_level", BooleanType())]
    + [StructField(c, StringType()) for c in ("species_key", "genus", "family", "kingdom", "phylum", "class", "order", "group")]
    + [StructField("year", IntegerType()), StructField("record_id", StringType()), StructField("latitude", DoubleType()), StructField("longitude", DoubleType())]
    + [StructField("has_coordinates", BooleanType()), StructField("is_project_source", BooleanType())]
)

# Closed vocabularies, names of alternative columns, classes with seeds.
GROUPS = ["Fanerógamas", "Criptógamas", "Fungos"]
OTHER_GROUP = "Indeterminado"
RESOLUTIONS = ["Até espécie", "Até gênero", "Até família", "Indeterminados"]
SPECIES_RANKS = ["SPECIES", "SUBSPECIES", "VARIETY", "FORM"]
SEED_CLASSES = ["MAGNOLIOPSIDA", "LILIOPSIDA", "PINOPSIDA", "CYCADOPSIDA", "GNETOPSIDA", "GINKGOOPSIDA"]
ALIASES = {
    "scientificName": ["acceptedScientificName", "species", "genus", "family"],
    "taxonRank": ["verbatimTaxonRank"],
    "species_key": ["species", "acceptedScientificName", "scientificName"],
    "record_id": ["occurrenceID", "gbifID", "key", "catalogNumber"],
    "latitude": ["decLat_final", "decimalLatitude", "decimalLatitude.new", "decimalLatitude_plantR"],
    "longitude": ["decLon_final", "decimalLongitude", "decimalLongitude.new", "decimalLongitude_plantR"],
}


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name (points included), or nulls."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def pick(columns: Sequence[str], candidates: Sequence[str], required: bool = True) -> str | None:
    """The first candidate, in the order of candidates, that is a column."""
    found = next((c for c in candidates if c in columns), None)
    if found is None and required:
        raise ValueError(f"none of the columns {', '.join(candidates)} is there")
    return found


def key_of(name: str) -> str:
    """A column name without marks, case and punctuation."""
    return "".join(c for c in T.plain(name).lower() if c.isascii() and c.isalnum())


def pick_like(columns: Sequence[str], candidates: Sequence[str], required: bool = True) -> str | None:
    """An exact candidate, or else the first column, in the order of columns, whose key is a candidate's."""
    keys = set(map(key_of, candidates))
    found = pick(columns, candidates, False) or next((c for c in columns if key_of(c) in keys), None)
    if found is None and required:
        raise ValueError(f"no column is like {', '.join(candidates)}")
    return found


def first_value(df: DataFrame, candidates: Sequence[str], default: str = "") -> Column:
    """Per row the first value that isn't blank among exact names, or else of the first column of a like name."""
    keys = set(map(key_of, candidates))
    exact = [c for c in candidates if c in df.columns]
    names = exact or [c for c in df.columns if key_of(c) in keys][:1]
    return F.coalesce(*[F.when(T.is_filled(column(df, n)), F.trim(column(df, n).cast("string"))) for n in names], F.lit(default))


def value_or(df: DataFrame, candidates: Sequence[str], default: str = "") -> Column:
    """The first column that is there; nulls become the default, blanks stay."""
    found = pick(df.columns, candidates, False)
    return F.lit(default) if found is None else F.coalesce(column(df, found).cast("string"), F.lit(default))


def harmonised(df: DataFrame) -> DataFrame:
    """Alternative columns filled into the catalog's, ranks and groups derived.

    Chains fill in the order of ``ALIASES``; a later one sees columns as
    earlier ones left them, and coordinates are filled as text. Whether
    is_species_level and taxon_resolution are derived is decided for the whole
    input: one true flag, or one value, anywhere keeps the stated ones. That is
    one aggregate row, joined back as such.
    """
    stated_genus = "genus" in df.columns
    for target, others in ALIASES.items():
        df = df.withColumn(target, T.first_filled(column(df, target), *[column(df, o) for o in others]))
    if not stated_genus:
        df = df.withColumn("genus", column(df, "genericName"))
    for c in ("family", "kingdom", "phylum", "class", "order"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    up = lambda c: F.upper(T.squish(c))
    rank, kingdom = F.coalesce(up("taxonRank"), F.lit("")), up("kingdom")
    species = rank.isin(*SPECIES_RANKS)
    resolution = F.when(species, RESOLUTIONS[0]).when(rank == "GENUS", RESOLUTIONS[1]).when(rank == "FAMILY", RESOLUTIONS[2]).otherwise(RESOLUTIONS[3])
    any_flag = F.bool_or(T.is_true(column(df, "is_species_level")))
    any_resolution = F.bool_or(T.is_filled(column(df, "taxon_resolution")))
    stated = [c for c in ("is_species_level", "taxon_resolution") if c in df.columns]
    if stated:
        whole = df.agg(F.coalesce(any_flag, F.lit(False)).alias("_any_flag"), F.coalesce(any_resolution, F.lit(False)).alias("_any_resolution"))
        df = df.crossJoin(F.broadcast(whole))  # one row
        flag = F.when(F.col("_any_flag"), T.is_true(column(df, "is_species_level"))).otherwise(species)
        resolution = F.when(F.col("_any_resolution"), column(df, "taxon_resolution").cast("string")).otherwise(resolution)
    else:
        flag = species
    df = df.withColumn("is_species_level", flag).withColumn("taxon_resolution", resolution).drop("_any_flag", "_any_resolution")
    # A plant of no stated class has no seeds either.
    seeds = F.coalesce(up("class").isin(*SEED_CLASSES), F.lit(False))
    derived = F.when(kingdom == "FUNGI", GROUPS[2]).when((kingdom == "PLANTAE") & seeds, GROUPS[0]).when(kingdom == "PLANTAE", GROUPS[1])
    return df.withColumn("group", T.first_filled(column(df, "group"), derived))


def coerced(df: DataFrame, source_label: str | None, project_label: str, latest_year: int) -> DataFrame:
    """Exactly the catalog's columns and types; other columns go, so that unions can't clash."""
    clean = lambda c: T.squish(column(df, c))
    numeric_year = "year" in df.columns and dict(df.dtypes)["year"] not in ("string",)
    latitude, longitude = T.as_number(column(df, "latitude")), T.as_number(column(df, "longitude"))
    source = F.when(T.is_filled(column(df, "source")), clean("source")).otherwise(F.lit(source_label))
    group, resolution, species = clean("group"), clean("taxon_resolution"), T.is_true(column(df, "is_species_level"))
    values = {c: clean(c) for c in ("scientificName", "taxonRank", "genus", "family", "kingdom", "phylum", "class", "order", "record_id")}
    values |= {
        "source": source,
        "year": T.to_year(column(df, "year"), latest_year, numeric_year),
        "latitude": latitude,
        "longitude": longitude,
        "is_species_level": species,
        "has_coordinates": (latitude.isNotNull() & longitude.isNotNull()) | T.is_true(column(df, "has_coordinates")),
        "is_project_source": T.is_true(column(df, "is_project_source")) | F.coalesce(source == project_label, F.lit(False)),
        "taxon_resolution": F.when(resolution.isin(*RESOLUTIONS), resolution).otherwise(RESOLUTIONS[-1]),
        "group": F.when(group.isin(*GROUPS), group).otherwise(OTHER_GROUP),
        "species_key": F.when(species & T.is_filled(column(df, "species_key")), clean("species_key")),
    }
    return df.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in CATALOG])
