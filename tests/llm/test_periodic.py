"""op12 against a search over all periods and places."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tests.llm.cases import documents, odd_rows, with_clashing_columns
from verdant.llm import periodic as P


def brute(words, least=24, periods=3):
    """For each period, the stretches in which words a period apart agree; the least period of a stretch counts."""
    n, out = len(words), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, periods * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def row(key, text):
    words = (text or "").encode().split()
    if key is not None and zlib.crc32(str(key).encode()) % 10 == 0 and words:
        g = zlib.crc32(str(key).encode()) // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = sorted(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[0] if found else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return key, len(found), *best, None if not found else 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))


def repetitive(rng, n):
    """Words of a small alphabet with planted powers, also of powers."""
    out = []
    while len(out) < n:
        unit = [rng.randint(0, rng.choice([1, 3, 30, 5000])) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 40]))]
        if rng.random() < 0.3:
            unit = unit * rng.randint(2, 4) + [rng.randint(0, 3)]
        out += (unit * rng.choice([1, 1, 3, 4, 9, 20]))[rng.randint(0, 3) :]
    return out[:n]


@pytest.mark.parametrize("seed", range(12))
def test_runs_against_all_periods(seed):
    rng = random.Random(seed)
    for n in (0, 1, 23, 24, 25, 80, 400, 900):
        words = repetitive(rng, n)
        assert P.runs(np.array(words, np.int64)) == brute(words)
    for least, periods in ((2, 2), (6, 2), (5, 4), (1, 3)):
        words = repetitive(rng, 150)
        assert P.runs(np.array(words, np.int64), least, periods) == brute(words, least, periods), (least, periods)


def test_blocks_and_uniform_text(monkeypatch):
    monkeypatch.setattr(P, "_AT_ONCE", 7)
    for words in ([5] * 300, [1, 2] * 90 + [3] + [1, 2] * 90, list(range(40)) * 8):
        assert P.runs(np.array(words)) == brute(words)


def test_query_rows(spark):
    rng = random.Random(7)
    rows = odd_rows() + [(1000 + i, " ".join(f"w{v}" for v in repetitive(rng, rng.randint(1, 400)))) for i in range(120)]
    rows = [r for r in rows if len(r[1] or "") < 20_000]  # all periods of the longest would take minutes here
    df = with_clashing_columns(documents(spark, rows))
    assert sorted((tuple(r) for r in P.digests(df).collect()), key=repr) == sorted((row(*r) for r in rows), key=repr)
    general = {(r["doc_id"], r["collapsed"]): [tuple(x) for x in r["runs"]] for r in P.periodic_runs(df).collect()}
    assert sorted(map(len, general.values()))[-1] > 0


def test_long_text_and_empty_table(spark):
    text = " ".join(["a b c d e f g"] * 20_000 + [f"x{i}" for i in range(50_000)])
    (got,) = P.periodic_runs(documents(spark, [(1, text)])).collect()
    assert [tuple(r) for r in got["runs"]] == [(0, 140_000, 7)] and len(got["collapsed"].split()) == 50_007
    assert P.digests(documents(spark, [])).count() == 0
