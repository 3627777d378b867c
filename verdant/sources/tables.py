"""CSV, YAML and GeoJSON inputs, CSV reports."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Text that stands for a missing value (fixed values).
MISSING = ("", "NA", "NaN")


def _clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, names and what is outside quotes trimmed, missing markers null. Raises FileNotFoundError."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    df = _clean_names(spark.read.csv(path, header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True))
    return df.select(*[F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_csv_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, broken): the rows of ``read_csv`` that have as many values as the header has names, and (line, reason) of all others.

    The file is parsed once for each of the two; nothing is filled or cut. Raises FileNotFoundError.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    options = {"header": True, "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    names = spark.read.csv(path, **options).columns
    bad = "_line"
    while bad in names:
        bad += "_"
    schema = StructType([StructField(n, StringType()) for n in (*names, bad)])
    rows = spark.read.csv(path, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord=bad, enforceSchema=True, **options)
    good = _clean_names(rows.where(F.col(f"`{bad}`").isNull()).drop(bad))
    good = good.select(*[F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in good.columns])
    # A row that is too short has nulls at its end, one that is too long none there.
    reason = F.when(F.col(f"`{names[-1]}`").isNull(), "fewer values than names").otherwise("more values than names")
    return good, rows.where(F.col(f"`{bad}`").isNotNull()).select(F.col(f"`{bad}`").alias("line"), reason.alias("reason"))


def read_optional_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """``read_csv``, or an empty frame of ``schema`` if the file is missing or can't be read; its columns are always there."""
    want = spark.createDataFrame([], schema)
    try:
        df = read_csv(spark, path)
    except (FileNotFoundError, AnalysisException):  # missing, or nothing that Spark can open
        return want
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in want.schema] + [F.col(f"`{c}`") for c in df.columns if c not in want.columns])


INSTITUTIONS = "id string, group string, order int, acronym string, name string, role string, url string, logo string, status string, note string, pos int"


def read_institutions(spark: SparkSession, path: str) -> DataFrame:
    """A YAML list of institutions with defaults for what a record lacks; no file is an empty frame."""
    import yaml

    if not os.path.exists(path):
        return spark.createDataFrame([], INSTITUTIONS)
    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or []
    text = lambda item, k, default: default if item.get(k) is None else str(item[k])

    def whole(x, default: int) -> int:
        try:
            return int(float(x))
        except (TypeError, ValueError):
            return default

    rows = []
    for i, item in enumerate(raw, 1):
        key = text(item, "id", f"inst_{i}")
        acronym = text(item, "acronym", text(item, "id", f"INST {i}"))
        rows.append((key, text(item, "group", "parceira"), whole(item.get("order"), 999 if item.get("order") is not None else i), acronym, text(item, "name", text(item, "acronym", "Instituição")), text(item, "role", "Instituição"), text(item, "url", ""), text(item, "logo", ""), text(item, "status", ""), text(item, "note", ""), i))
    return spark.createDataFrame(rows, INSTITUTIONS)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(feature, properties as JSON, lon, lat): the positions of all features, of any nesting."""
    raw = spark.read.text(path, wholetext=True)
    features = raw.select(F.explode(F.from_json("value", "struct<features: array<string>>")["features"]).alias("f")).select(F.monotonically_increasing_id().alias("feature"), "f")
    # A position is the innermost pair of numbers.
    pairs = F.regexp_extract_all("f", F.lit(r"\[\s*(-?[0-9.eE+-]+\s*,\s*-?[0-9.eE+-]+)\s*(?:,[^\[\]]*)?\]"), F.lit(1))
    flat = features.select("feature", F.get_json_object("f", "$.properties").alias("properties"), F.explode(pairs).alias("p"))
    return flat.select("feature", "properties", F.split("p", ",")[0].try_cast("double").alias("lon"), F.trim(F.split("p", ",")[1]).try_cast("double").alias("lat"))


def bounding_box(positions: DataFrame) -> DataFrame:
    return positions.agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')
