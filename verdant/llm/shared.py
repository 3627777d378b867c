"""What the operators share: the shared folder, written tables, components, Arrow helpers.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``; every executor and the driver see it, so a lost
executor costs recomputation of running tasks only.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdant.shipping import ship

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; in local mode a temporary one of our own where that is unset (tests).

    Raises RuntimeError where it is unset and executors are other processes, which wouldn't see a folder of the driver's.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.partition("[")[0] != "local":
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="verdant-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return f"file://{_own['dir']}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there when the application ends goes then."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jpath, store = _found(spark, path)
    store.mkdirs(jpath)
    store.deleteOnExit(jpath)
    store.delete(jpath, True)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table in the shared folder: its lineage ends here and survives lost executors.

    Spark deletes the shuffle files of the write as soon as it is done. The
    table itself goes with ``drop``, or else when the application ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = new_path(spark, name)
    with _shuffles_freed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._verdant_path = path
    return out


#: With this setting Spark deletes a query's shuffle files when the query ends, not when the driver's garbage is collected.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_freed(spark: SparkSession):
    was = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE) if was is None else spark.conf.set(_FREE, was)


def drop(*tables: DataFrame) -> None:
    """Delete the tables behind ``written`` frames that nothing reads any more."""
    for df in tables:
        jpath, store = _found(df.sparkSession, df._verdant_path)
        store.delete(jpath, True)


def _found(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column has it."""
    while name in df.columns:
        name += "_"
    return name


def map_arrow(
    df: DataFrame, columns: list[str], schema: str, rows: Callable[[list[list]], Iterable[tuple]], batch_rows: int = 256
) -> DataFrame:
    """``mapInArrow`` over ``columns`` in slices of ``batch_rows``.

    ``rows`` gets the slice's columns as Python lists (strings as UTF-8 bytes)
    and yields output tuples, so memory is bounded by a slice, not a partition.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                got = list(rows([as_lists(c) for c in part.columns]))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), out, strict=True)], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def as_lists(column: pa.Array) -> list:
    """A column as Python values, text as bytes (no decoding)."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return column.to_pylist()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (u, v: long); label is the component's least node.

    Alternating large-star and small-star steps; each is one aggregation with
    map-side combine and one join that AQE can split, so a hub is never
    gathered in a task. Each round's edges are a written table.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _digest(now)
    for _ in range(most_rounds):
        if seen[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(large)
        drop(now)
        now, was = after, seen
        seen = _digest(now)
        if seen == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _digest(edges: DataFrame) -> tuple:
    """Row count and an order-free checksum."""
    return tuple(edges.agg(F.count("*"), F.sum((F.xxhash64("u", "v") / F.lit(2**20)).cast("long"))).first())
