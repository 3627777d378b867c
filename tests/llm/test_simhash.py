import random
import re

import numpy as np
import xxhash

from tests.llm.cases import documents, odd_rows, prose, with_clashing_columns
from verdant.llm import simhash


def brute(rows):
    """(doc_id, fingerprint, component) by comparing all pairs."""

    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        ones = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
        return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))

    fps = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True))), key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_code_is_perfect_and_keys_meet():
    unit, table = simhash._golay()
    assert np.bincount((table >= 0).sum(1)).tolist() == [0, 277, 0, 0, 0, 0, 1771] and len(unit) == 23
    rng = random.Random(1)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 2):
            b ^= 1 << bit
        row, key, near = simhash.segment_keys(np.array([a, b], np.uint64))
        assert set(key[(row == 0) & near]) & set(key[row == 1])


def test_fingerprints_of_long_texts_come_in_pieces(monkeypatch):
    text = prose(random.Random(2), 500).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_AT_ONCE", 7)
    assert simhash.fingerprint(text) == whole


def test_against_all_pairs(spark):
    rng = random.Random(3)
    base = prose(rng, 300)
    rows = odd_rows() + [(100 + i, base.replace(rng.choice(base.split()), "changed", 1)) for i in range(40)] + [(200 + i, prose(rng, rng.randint(1, 30))) for i in range(60)]
    df = with_clashing_columns(documents(spark, rows))
    assert collected(simhash.near_duplicates(df)) == brute(rows)


def test_crowded_keys_link_without_pairs(spark):
    rng = random.Random(4)
    fps = set()
    for _ in range(3):
        f = rng.getrandbits(64)
        for _ in range(120):
            fps.add(f)
            f ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            if rng.random() < 0.7:
                f = rng.choice(sorted(fps))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    components = lambda hot: {r["node"]: r["label"] for r in simhash.connected_components(simhash.links(df, hot)).collect()}
    few, many = components(2), components(10**6)
    assert {n: few[n] for n in many} and all((few[a] == few[b]) == (many[a] == many[b]) for a in many for b in many)


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
