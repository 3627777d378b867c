"""Centroid clustering of integer vectors: float32 screening with rounding-error intervals, exact integers where they overlap.

A matrix product in float32 gives each vector's squared distance to every
centroid up to a proven bound. Only centroids whose interval reaches below the
least upper end can be the nearest; where several can, they are compared in
exact integers, and ties go to the smaller number. Means are exact, too: tasks
add up Python integers and hand on their base-2^32 digits, which Spark sums by
(cluster, component), so neither the count nor the size of the vectors matters.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm.shared import written
from verdant.shipping import ship

SIZE, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Components up to this keep squared distances of 64 of them within 64 bits; vectors beyond it are compared by Python's integers.
LARGE = 1 << 27
MOST_LONG = (1 << 63) - 1
_AT_ONCE = 4096
_UNIT = 2.0**-24
#: Bound on a float32 dot product's error, as a share of the product of the norms: 64 roundings of sums and products, two of the
#: converted components, and a reserve of four units for the second-order terms and for the bound's own arithmetic.
_SHARE = (SIZE + 2 + 4) * _UNIT
_DIGIT = 32

Vectors = tuple[np.ndarray, list[list[int]], np.ndarray, np.ndarray]


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row; both are int64 arrays with components up to ``LARGE``."""
    shift = centroids.sum(axis=0) // len(centroids)  # distances don't change, norms and with them the intervals shrink
    labels, distances = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    c = centroids - shift
    c_square = (c * c).sum(axis=1).astype(np.float64)
    c_norm = np.sqrt(c_square)
    for at in range(0, len(rows), _AT_ONCE):
        part = slice(at, at + _AT_ONCE)
        x = rows[part] - shift
        dot = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
        norms = np.sqrt((x * x).sum(axis=1).astype(np.float64))[:, None] * c_norm
        value = c_square - 2 * dot  # the squared distance less the row's own square
        error = 2 * _SHARE * norms + 2.0**-50 * (c_square + 2 * norms)
        can = value - error <= (value + error).min(axis=1, keepdims=True)
        best = can.argmax(axis=1)
        (open_,) = np.nonzero(can.sum(axis=1) > 1)
        if len(open_):
            r, k = np.nonzero(can[open_])
            exact = np.full((len(open_), len(c)), MOST_LONG)
            exact[r, k] = ((x[open_][r] - c[k]) ** 2).sum(axis=1)
            best[open_] = exact.argmin(axis=1)  # the first of equals
        labels[part] = best
        distances[part] = ((x - c[best]) ** 2).sum(axis=1)
    return labels, distances


def nearest_of_any_size(row: list[int], centroids: list[list[int]]) -> tuple[int, int]:
    """As ``nearest``, of one row, in Python's integers."""
    return min(((sum((a - b) ** 2 for a, b in zip(row, c, strict=True)), k) for k, c in enumerate(centroids)))[::-1]


def vectors(column: pa.Array) -> Vectors:
    """(small, large, their places): the integer vectors of a list column, those with components beyond ``LARGE`` as Python integers."""
    offsets, values = column.offsets.to_numpy(), column.values
    good = np.isfinite(values.to_numpy(zero_copy_only=False)) if len(values) else np.zeros(0, bool)  # a null is NaN here
    flat = np.nan_to_num(values.to_numpy(zero_copy_only=False).astype(np.float64)) if len(values) else np.zeros(0)
    places = np.nonzero((np.diff(offsets) == SIZE) & np.asarray(column.is_valid()))[0]
    at = offsets[places][:, None] + np.arange(SIZE)
    places, at = places[good[at].all(axis=1)], at[good[at].all(axis=1)]
    cells = flat[at]
    small = (np.abs(cells) < LARGE / SCALE).all(axis=1)
    large = [[math.floor(SCALE * int(v)) if abs(v) >= 2.0**52 else math.floor(SCALE * v) for v in row] for row in cells[~small].tolist()]
    return np.floor(SCALE * cells[small]).astype(np.int64), large, places[small], places[~small]


def assign(found: Vectors, centroids: list[list[int]]) -> tuple[list[int], list[int], list[int]]:
    """(places, numbers, distances as Python integers) of the vectors, small ones first."""
    small, large, at_small, at_large = found
    if any(abs(v) > LARGE for c in centroids for v in c):
        near = [nearest_of_any_size(r, centroids) for r in small.tolist()]
    else:
        near = list(zip(*(a.tolist() for a in nearest(small, np.array(centroids, np.int64))), strict=True))
    near += [nearest_of_any_size(r, centroids) for r in large]
    return [*at_small.tolist(), *at_large.tolist()], [k for k, _ in near], [d for _, d in near]


def _digits(value: int) -> Iterator[tuple[int, int]]:
    """(power of 2^32, digit with the value's sign) of what isn't zero."""
    sign, value, power = (-1, -value, 0) if value < 0 else (1, value, 0)
    while value:
        if value & (2**_DIGIT - 1):
            yield power, sign * (value & (2**_DIGIT - 1))
        value, power = value >> _DIGIT, power + 1


_SUMS = "cluster int, component int, power int, digit long"


def _sums(source: DataFrame, centroids: list[list[int]]) -> dict[tuple[int, int], int]:
    """Exact sums by (cluster, component), the count as component ``SIZE``; a row a cluster, component and digit reaches the driver."""
    handed = source.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[int]] = {}
        for batch in batches:
            found = vectors(batch.column(0))
            small, large = found[:2]
            _, numbers, _ = assign(found, handed.value)
            own = np.array(numbers[: len(small)], np.int64)
            groups = [(k, small[own == k].sum(axis=0).tolist(), int((own == k).sum())) for k in np.unique(own).tolist()]
            for k, add, n in groups + [(k, row, 1) for k, row in zip(numbers[len(small) :], large, strict=True)]:
                total = totals.setdefault(k, [0] * (SIZE + 1))
                totals[k] = [a + b for a, b in zip(total, [*add, n], strict=True)]
        rows = [(k, j, p, d) for k, total in totals.items() for j, value in enumerate(total) for p, d in _digits(value)]
        if rows:
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 3 + [pa.int64()], strict=True)], names=["cluster", "component", "power", "digit"])

    out: dict[tuple[int, int], int] = {}
    for r in source.select("embedding").mapInArrow(run, _SUMS).groupBy("cluster", "component", "power").agg(F.sum("digit").alias("digit")).collect():
        key = r["cluster"], r["component"]
        out[key] = out.get(key, 0) + (r["digit"] << (_DIGIT * r["power"]))
    return out


def _first(source: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The kept vectors of least hash of ``seed:id``; vectors without an id come last, ties are ordered by their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, small, large = vectors(batch.column(0))
            yield batch.take(pa.array(np.concatenate([small, large])))

    kept = source.select("embedding", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"))
    kept = kept.mapInArrow(run, kept.schema).orderBy(F.col("h").asc_nulls_last(), "embedding").limit(clusters).collect()
    return [[math.floor(SCALE * int(v)) if abs(v) >= 2.0**52 else math.floor(SCALE * v) for v in r["embedding"]] for r in kept]


def fit(source: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> list[list[int]]:
    """The centroids after ``rounds`` rounds over ``source`` (vec_id, embedding: array<double>); empty ones stay as they are."""
    centroids = _first(source, clusters, seed)
    for _ in range(rounds if centroids else 0):
        sums = _sums(source, centroids)
        centroids = [[sums.get((k, j), 0) // sums[k, SIZE] for j in range(SIZE)] if (k, SIZE) in sums else c for k, c in enumerate(centroids)]
    return centroids


def clustered(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector of 64 finite components.

    Components x become floor(256 x). Null vectors, vectors of another length
    and those with a null, NaN or infinite component have no row. A null id
    stays; such vectors are the last choice as first centroids. Repeated rows
    count and come back each. Fewer vectors than clusters make fewer clusters;
    an empty table gives an empty result. Other columns are ignored, whatever
    their names. Distances and sums beyond a long are null, but decide exactly.
    """
    spark = table.sparkSession
    ship(spark)
    source = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    centroids = fit(source, clusters, rounds, seed)
    handed = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = vectors(batch.column(1))
            places, numbers, distances = assign(found, handed.value) if handed.value else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(places, pa.int64())), pa.array(numbers, pa.int32()), pa.array([d if d <= MOST_LONG else None for d in distances], pa.int64())],
                names=["vec_id", "cluster", "distance"],
            )

    nearest_ = written(source.mapInArrow(run, "vec_id long, cluster int, distance long"), "nearest")
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    of = nearest_.groupBy("cluster").agg(whole.alias("within")).collect()  # a row a cluster
    total = None if any(r["within"] is None for r in of) else sum(int(r["within"]) for r in of)
    long = lambda v: None if v is None or v > MOST_LONG else int(v)
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    stats = [(r["cluster"], long(r["within"]), long(total), digest(centroids[r["cluster"]])) for r in of]
    by = spark.createDataFrame(stats, "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return nearest_.join(F.broadcast(by), F.col("cluster") == F.col("_cluster")).drop("_cluster")


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
