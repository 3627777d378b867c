"""op13 against plain Python integers, also where float32 can't tell centroids apart."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import with_clashing_columns
from verdant.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, clusters=C.CLUSTERS, rounds=C.ROUNDS):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    of = lambda i: (i is None, "" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest())
    cents = [v for _, v in sorted(kept, key=lambda r: (of(r[0]), r[1]))[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(cents))
    for _ in range(rounds):
        of_ = [near(v)[1] for _, v in kept]
        for k in set(of_):
            own = [v for (_, v), c in zip(kept, of_, strict=True) if c == k]
            cents = [c if j != k else [sum(col) // len(own) for col in zip(*own, strict=True)] for j, c in enumerate(cents)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in last)
    within = Counter()
    for _, k, d in last:
        within[k] += d
    long = lambda v: v if v <= C.MOST_LONG else None
    large = any(d > C.MOST_LONG for _, _, d in last)
    big = {k for _, k, d in last if d > C.MOST_LONG}
    return sorted(((i, k, long(d), None if k in big else long(within[k]), None if large else long(total), hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest()) for i, k, d in last), key=repr)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in C.clustered(with_clashing_columns(df), **how).collect()), key=repr)


def test_against_plain_integers(spark):
    rng = random.Random(1)
    centre = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    rows = [(i, [a + rng.gauss(0, 0.4) for a in rng.choice(centre)]) for i in range(300)]
    rows += [(500, None), (501, []), (502, [0.1] * 63), (503, [0.1] * 65), (504, [0.1] * 63 + [None]), (505, [math.nan] + [0.0] * 63), (506, [math.inf] + [0.0] * 63), (None, [0.2] * 64), (None, [0.3] * 64)]
    rows += [(7, rows[7][1])] * 20 + [(600 + i, [0.5] * 64) for i in range(120)]  # repeated rows, a very common vector
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("scale", [1e5, 1e9, 3e38])
def test_large_components(spark, scale):
    rng = random.Random(2)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1) * scale)) for _ in range(64)]) for i in range(60)] + [(100 + i, [rng.random() for _ in range(64)]) for i in range(60)]
    assert run(spark, rows) == brute(rows)


def test_empty_and_few(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert run(spark, few) == brute(few)


def test_screening_never_loses_the_nearest():
    """Centroids one unit apart and far from the origin: float32 sees them as equal."""
    rng = np.random.default_rng(3)
    base = rng.integers(-C.LARGE + 9, C.LARGE - 9, (1, 64))
    cents = base + rng.integers(-2, 3, (40, 64))
    cents[30] = cents[3]
    rows = np.concatenate([base + rng.integers(-3, 4, (500, 64)), rng.integers(-C.LARGE, C.LARGE, (500, 64)), cents])
    exact = np.array([[((r - c) ** 2).sum() for c in cents] for r in rows])
    labels, distances = C.nearest(rows, cents)
    assert labels.tolist() == exact.argmin(axis=1).tolist() and distances.tolist() == exact.min(axis=1).tolist()
