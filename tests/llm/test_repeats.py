import hashlib
import random

import numpy as np
import pytest

from tests.llm.cases import documents, odd_rows, prose, with_clashing_columns
from verdant.llm import repeats as R


def brute(rows):
    """All 100-byte strings in a dictionary."""
    first = {}
    key = lambda d: -(2**63) if d is None else d
    for d, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            first[w] = min(first.get(w, (2**63, 0)), (key(d), s))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, np.int8)
        for s in range(len(b) - 99):
            if first[b[s : s + 100]] < (key(d), s):
                gone[s + 1 : s + 101] = 1
        left = bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed, n=70):
    rng = random.Random(seed)
    passages = [prose(rng, rng.randint(15, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages)[rng.randrange(40) :] if rng.random() < 0.5 else prose(rng, rng.randint(1, 30)) for _ in range(rng.randint(0, 6))]
        rows.append((rng.randint(1, 60), rng.choice([" ", "", "é"]).join(parts)))
    return rows + [(70, "a" * 700), (71, "ab" * 300), (72, rows[3][1]), (73, "é" * 120)]


def test_intervals_find_common_prefixes():
    rng = random.Random(1)
    for least in (9, 20, 100):
        for _ in range(20):
            base = bytes(rng.choice(b"ab") for _ in range(rng.randint(30, 250)))
            text = base + bytes(rng.choice(b"abc") for _ in range(40)) + base[: rng.randint(1, len(base))]
            rank, boundary = R.boundaries(np.frombuffer(text, np.uint8), least)
            group = np.cumsum(boundary[:-1])[rank]
            whole = text * (2 + least // len(text))
            names = {}
            assert all(names.setdefault(whole[i : i + least], group[i]) == group[i] for i in range(len(text)))
            assert len(set(names.values())) == len(names)


def test_stretches_cover_every_window_once(monkeypatch):
    texts = [(t or "").encode() for _, t in corpus(2)]
    for chunk in (1 << 19, 300):
        monkeypatch.setattr(R, "CHUNK", chunk)
        seen = [set() for _ in texts]
        for k, _, _, s, n in (x for arrays in R.stretches(texts) for x in zip(*arrays, strict=True)):
            own = set(range(s, s + n))
            assert not own & seen[k]
            seen[k] |= own
        assert [len(x) for x in seen] == [max(0, len(t) - 99) for t in texts]


def test_against_brute_force(spark):
    rows = corpus(3) + odd_rows()[:9]
    assert collected(R.without_repeats(with_clashing_columns(documents(spark, rows)).repartition(5))) == brute(rows)


@pytest.mark.parametrize("block", [1, 300, 2000, 20_000])
def test_groups_that_fit_no_block_are_cut(spark, block):
    rng = random.Random(block)
    passage = prose(rng, 40)
    rows = corpus(4, 30) + [(100 + i, f"{prose(rng, 4)} {passage[:: 1 if i % 9 else -1]} {prose(rng, rng.randint(1, 5))}") for i in range(60)]
    rows += [(100, rows[-1][1]), (None, passage), (None, passage + " x")]
    assert collected(R.without_repeats(documents(spark, rows), block=block)) == brute(rows)


def test_parts_have_every_window_once_and_the_key_of_their_common_bytes():
    rng = random.Random(6)
    texts = [prose(rng, 60).encode() for _ in range(30)]
    texts += [t[20:] + b"tail" for t in texts]
    keys = {}
    for data, bounds, whose, shift in R._runs(texts):
        hashes, starts, counts = R.anchors(data, bounds)
        for h, s, n in zip(hashes.tolist(), starts.tolist(), counts.tolist(), strict=True):
            context = data[s : s + n + 99]
            gram = R.gram_place(context)
            assert R._grams(context)[gram : gram + 1].view("<i8")[0] == h and n - 1 <= gram
            todo = [(h, 0, R.SPAN - 1, gram, h, 5, 0, n, 1, s, context)]
            while any(p[1] < p[2] for p in todo):
                todo = [x for p in todo for x in R.cut_parts(p)]
                assert sorted(w for p in todo for w in range(p[6], p[6] + p[7])) == list(range(n))
                assert all(p[10] == context[p[6] : p[6] + p[7] + 99] and p[9] == s + p[6] and p[3] == gram - p[6] for p in todo)
            for p in todo:  # one place each: the key stands for the whole window
                assert keys.setdefault(p[10], p[0]) == p[0]
    assert len(set(keys.values())) == len(keys)


def test_blocks():
    rng = random.Random(5)
    contexts = [bytes(rng.choice(b"xyz") for _ in range(150))] * 2 + [b"q" * 120]
    assert R.earlier_windows(contexts, [(2, 0), (1, 7), (3, 0)]) == [[(0, 50)], [], [(1, 20)]]


def test_empty_and_short(spark):
    assert R.without_repeats(documents(spark, [])).count() == 0
    assert collected(R.without_repeats(documents(spark, odd_rows()[:8]))) == brute(odd_rows()[:8])
