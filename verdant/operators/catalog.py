"""The catalog: union of inputs, the species-level subset, input status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.functions import text as T
from verdant.plans.schema import CATALOG, GROUPS, coerced, harmonised


def empty_catalog(spark) -> DataFrame:
    return spark.createDataFrame([], CATALOG)


def catalog_input(df: DataFrame | None, spark, source_label: str, project: bool, project_label: str, latest_year: int) -> DataFrame:
    """One input as catalog rows; its source and project flag are set whatever it says. A missing input is an empty one."""
    if df is None:
        return empty_catalog(spark)
    rows = coerced(harmonised(df), source_label, project_label, latest_year)
    return rows.withColumn("source", F.lit(source_label)).withColumn("is_project_source", F.lit(project))


def union(inputs: list[DataFrame]) -> DataFrame:
    """All rows of all inputs, by name, missing columns null; nothing is deduplicated."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)


def in_groups(df: DataFrame, groups: list[str] | None = None) -> DataFrame:
    return df.where(F.col("group").isin(*(groups or GROUPS)))


def species_level(df: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Rows of a known group, identified to species, with a key."""
    return in_groups(df, groups).where(F.col("is_species_level") & T.is_filled("species_key"))


def of_group(df: DataFrame, group: str | None) -> DataFrame:
    return df if group is None else df.where(F.col("group") == group)


def input_status(df: DataFrame | None, spark, label: str, groups: list[str] | None = None) -> DataFrame:
    """One row on an input: label, found, n_rows, n_usable (rows of a known group), message."""
    if df is None:
        return spark.sql("select :label as label, false as found, 0L as n_rows, 0L as n_usable, 'missing' as message", {"label": label})
    usable = F.count_if(F.col("group").isin(*(groups or GROUPS)))
    return df.agg(F.lit(label).alias("label"), F.lit(True).alias("found"), F.count("*").alias("n_rows"), usable.alias("n_usable")).withColumn("message", F.when(F.col("n_rows") == 0, "empty").when(F.col("n_usable") == 0, "no usable rows").otherwise("ok"))
