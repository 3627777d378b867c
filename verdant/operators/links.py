"""Linked selections: keys that every active filter lets through, ranges, groups, boxes, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linked_keys(handles: DataFrame, handle: str, key: str, n_active: int | None = None) -> DataFrame | None:
    """Keys that all active handles have.

    ``n_active`` counts the active handles, those of an empty list included,
    which let nothing through; left out, it is the number seen in the rows.
    No active handle is no filter at all: None.
    """
    if n_active == 0:
        return None
    counts = handles.groupBy(key).agg(F.countDistinct(handle).alias("_n"))
    if n_active is not None:
        return counts.where(F.col("_n") == n_active).select(key)
    whole = handles.agg(F.countDistinct(handle).alias("_all"))
    return counts.crossJoin(F.broadcast(whole)).where("_n = _all").select(key)  # one row


def matches(key: Column | str, selected: list | None) -> Column:
    """Whether a key is selected; null keys always are, and with no selection all are."""
    k = F.col(key) if isinstance(key, str) else key
    return F.lit(True) if selected is None else k.isNull() | F.coalesce(k.isin(*selected), F.lit(False)) if selected else k.isNull()


def matches_all(keys: Column | str, selected: list) -> Column:
    """Whether all keys of a list are selected; null lists are."""
    k = F.col(keys) if isinstance(keys, str) else keys
    wanted = F.array(*map(F.lit, selected)) if selected else F.array().cast("array<string>")
    return k.isNull() | (F.size(F.array_except(k, wanted)) == 0)


def in_range(value: Column | str, low, high) -> Column:
    return (F.col(value) if isinstance(value, str) else value).between(low, high)


def keys_of_groups(df: DataFrame, group: str, key: str, chosen: list) -> DataFrame:
    """Distinct keys of the chosen groups."""
    return df.where(F.col(group).isin(*chosen)).select(key).distinct()


def in_box(lat: str, lon: str, south: float, west: float, north: float, east: float) -> Column:
    return F.col(lat).between(south, north) & F.col(lon).between(west, east)


def opacity(selected: Column) -> Column:
    return F.when(selected, 1.0).otherwise(0.2)


def difference(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): keys added and removed; one aggregation tells both."""
    both = before.select(key, F.lit(1).alias("_b"), F.lit(0).alias("_a")).unionByName(after.select(key, F.lit(0).alias("_b"), F.lit(1).alias("_a")))
    sides = both.groupBy(key).agg(F.max("_b").alias("_b"), F.max("_a").alias("_a")).where("_a <> _b")
    return sides.select(key, F.when(F.col("_a") == 1, "added").otherwise("removed").alias("change"))


def rows_of(columns: dict[str, Column]) -> Column:
    """Arrays side by side as an array of structs."""
    names = list(columns)
    zipped = F.arrays_zip(*[columns[n].alias(n) for n in names])
    return F.transform(zipped, lambda x: F.struct(*[x[n].alias(n) for n in names]))


def subset(values: Column | str, index: Column | str) -> Column:
    """The elements of an array at some places, from 0."""
    v = F.col(values) if isinstance(values, str) else values
    return F.transform(F.col(index) if isinstance(index, str) else index, lambda i: F.get(v, i))


def recycled(values: Column | str, i: Column) -> Column:
    """Element i of an array that is repeated over and over."""
    v = F.col(values) if isinstance(values, str) else values
    return F.get(v, F.pmod(i, F.size(v)))
