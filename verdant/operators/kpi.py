"""Indicators of a catalog: counts, new species, balances, yearly series, richness, species lists.

A catalog here has the columns source, group, taxonRank, is_species_level,
species_key, genus, family, year, has_coordinates. The panels come from one
grouped aggregation of the catalog instead of a pass per panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.functions import text as T


def _usable(groups: list[str] | None) -> Column:
    known = F.lit(True) if groups is None else F.col("group").isin(*groups)
    return F.col("is_species_level") & T.is_filled("species_key") & known


def _species(groups: list[str] | None) -> Column:
    return F.when(_usable(groups), F.col("species_key"))


def _counts(df: DataFrame, groups: list[str] | None) -> DataFrame:
    """Records by all that the panels count distinct values of: one scan of the catalog with map-side sums, for all panels."""
    keys = ["group", "source", _species(groups).alias("species"), T.blank_to_null("genus").alias("genus"), T.blank_to_null("family").alias("family")]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("has_coordinates").alias("n_placed"))


def _panel(df: DataFrame, project: str, by: list[str], groups: list[str] | None) -> DataFrame:
    """A row of measures for each of ``by``, from one scan.

    Each count comes once for its species, its genus and its family; sums by
    these keys then tell how many there are and which species are the
    project's alone, without a distinct count or a second pass.
    """
    named = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("key"))
    facts = _counts(df, groups).select(*by, "source", "n", "n_placed", F.explode(F.array(*map(named, ("species", "genus", "family")))).alias("_k"))
    own, other = F.col("source") == project, F.col("source") != project
    sums = [F.sum("n").alias("n"), F.sum(F.when(own, F.col("n"))).alias("n_own"), F.sum(F.when(other, F.col("n"))).alias("n_other"), F.sum("n_placed").alias("n_placed")]
    keys = facts.groupBy(*by, F.col("_k")["kind"].alias("kind"), F.col("_k")["key"].alias("key")).agg(*sums, F.bool_or(own).alias("ours"), F.bool_or(other).alias("theirs"))
    known = lambda kind: (F.col("kind") == kind) & F.col("key").isNotNull()
    total = lambda n: F.coalesce(F.sum(F.when(F.col("kind") == "species", F.col(n))), F.lit(0))
    return keys.groupBy(*by).agg(
        total("n").alias("n_records"),
        total("n_own").alias("n_project"),
        total("n_other").alias("n_historical"),
        F.count_if(known("species")).alias("n_species"),
        F.count_if(known("genus")).alias("n_genera"),
        F.count_if(known("family")).alias("n_families"),
        total("n_placed").alias("n_georeferenced"),
        F.count_if(known("species") & F.col("ours") & ~F.coalesce("theirs", F.lit(False))).alias("n_new_species"),
    )


def new_species(df: DataFrame, project: str, by_group: bool = False, groups: list[str] | None = None) -> DataFrame:
    """Distinct keys of the project that no historical record has, overall or within each group.

    One aggregation by key tells both sides apart, so no join is needed: a key
    is new if none of its records is of another source.
    """
    keys = ["group", "species_key"] if by_group else ["species_key"]
    rows = df.where(_usable(groups))
    seen = rows.groupBy(*keys).agg(F.bool_or(F.col("source") == project).alias("ours"), F.bool_or(F.col("source") != project).alias("theirs"))
    return seen.where("ours and not coalesce(theirs, false)").select(*keys)


def overall(df: DataFrame, project: str, groups: list[str] | None = None) -> DataFrame:
    """The general panel: one row of counts, new species included."""
    return _panel(df, project, [], groups)


def by_group(df: DataFrame, project: str, groups: list[str] | None = None) -> DataFrame:
    """A panel per group; a species new to its group may be known from another, so these don't add up to the general panel."""
    return _panel(df, project, ["group"], groups)


def resolution(rank: Column | str, labels: tuple[str, str, str, str] = ("species", "genus", "family", "other")) -> Column:
    """The level to which a record is identified, by its rank."""
    r = F.upper(T.squish(rank))
    return F.when(r.isin("SPECIES", "SUBSPECIES", "VARIETY", "FORM"), labels[0]).when(r == "GENUS", labels[1]).when(r == "FAMILY", labels[2]).otherwise(labels[3])


def place_in(x: Column | str, order: list[str]) -> Column:
    """The place of a value in a list, from 1; values that aren't in it come last."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(x) if isinstance(x, str) else x)
    return F.when(at > 0, at).otherwise(len(order) + 1).cast("int")


def balance(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Records per value of ``by``, in the order of a list; values without records are left out."""
    return df.groupBy(by).agg(F.count("*").alias("n_records")).withColumn("place", place_in(by, order)).orderBy("place", by)


def by_year(df: DataFrame, fill: bool = False) -> DataFrame:
    """Records per known year, ascending; ``fill`` adds the years between the first and the last with zero."""
    counts = df.where("year is not null").groupBy("year").agg(F.count("*").alias("n_records"))
    if fill:
        years = counts.agg(F.explode(F.sequence(F.min("year"), F.max("year"))).alias("year"))
        counts = years.join(counts, "year", "left").select("year", F.coalesce("n_records", F.lit(0)).alias("n_records"))
    return counts.orderBy("year")


def richness(df: DataFrame, by: str, n: int | None = None, groups: list[str] | None = None) -> DataFrame:
    """Species per genus or family, the ``n`` richest if given; ties by name."""
    rows = df.where(_usable(groups) & T.is_filled(by))
    counts = rows.groupBy(by).agg(F.countDistinct("species_key").alias("n_species")).orderBy(F.desc("n_species"), F.asc_nulls_last(by))
    return counts if n is None else counts.limit(n)


def species_list(df: DataFrame, project: str | None = None, groups: list[str] | None = None) -> DataFrame:
    """Family, sentence-cased species, records and sources; with a project, whether the species is new.

    Keys that differ in case only are one species here, unlike in the counts.
    """
    rows = df.where(_usable(groups)).select(F.when(T.is_filled("family"), T.squish("family")).otherwise("—").alias("family"), T.sentence_case(T.squish("species_key")).alias("species"), "source")
    out = rows.groupBy("family", "species").agg(F.count("*").alias("n_records"), F.countDistinct("source").alias("n_sources"))
    if project is not None:
        new = new_species(df, project, False, groups).select(F.lower(T.squish("species_key")).alias("_new")).distinct()
        out = out.join(new, F.lower("species") == F.col("_new"), "left").withColumn("is_new", F.col("_new").isNotNull()).drop("_new")
    return out.orderBy("family", "species")
