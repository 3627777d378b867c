"""Near copies against all pairs compared in plain Python."""

import random

import corpus_pipeline
from tests.llm.cases import documents, odd_rows, prose, with_clashing_columns
from verdant.llm import neardup as N


def sets(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """{doc_id: least doc_id of its component} for distinct ids."""
    found = [(d, sets(t)) for d, t in rows]
    root = {d: d for d, _ in found}

    def of(d):
        while root[d] != d:
            d = root[d]
        return d

    for k, (d, a) in enumerate(found):
        for e, b in found[:k]:
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((of(d), of(e)))
                root[y] = x
    return {d: of(d) for d in root}


def changed(rng, text, n):
    w = text.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def test_components_are_those_of_the_exact_similarity(spark):
    rng = random.Random(1)
    plain = [prose(rng, 120) for _ in range(15)]
    rows = [(i, t) for i, t in enumerate(plain)]
    # Up to two changed words of 120 are within the bound, more are mostly beyond it; a chain; a group of many copies.
    rows += [(100 + 10 * i + n, changed(rng, t, n)) for i, t in enumerate(plain) for n in range(6)]
    rows += [(400 + k, " ".join(plain[0].split()[: 120 - 10 * k])) for k in range(8)]
    rows += [(500 + k, changed(rng, plain[1], 1)) for k in range(150)]
    rows += [(700, None), (701, " "), (702, "a b"), (703, "A  b")]
    docs = with_clashing_columns(documents(spark, rows))
    want = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in N.near_copies(docs).collect()} == want
    assert want[101] == 0 and want[105] != 0 and len(set(want.values())) > 40


def test_the_stage_drops_copies_with_a_changed_word(spark):
    rng = random.Random(2)
    text = prose(rng, 100)
    rows = [(2, text), (1, changed(rng, text, 1)), (3, changed(rng, text, 30)), (4, prose(rng, 100))]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect()) == [1, 3, 4]


def test_odd_rows(spark):
    rows = odd_rows()
    assert N.near_copies(documents(spark, rows)).count() == len(rows) and N.near_copies(documents(spark, [])).count() == 0


def test_sketches_never_rule_out_alike_sets():
    """And, wide in proportion to the sets, they rule out nearly all that isn't close to the bound, at any size."""
    rng = random.Random(3)
    for n in (1, 5, 60, 400, 3000, 20_000):
        base = prose(rng, n + 4)
        for far in range(0, n + 1, max(1, n // 12)):
            a, b = N.shingles(base.encode()), N.shingles(changed(rng, base, far).encode())
            x, y = N.sketch(a), N.sketch(b)
            both = len(a) + len(b)
            differing = len(set(a.tolist()) ^ set(b.tolist()))
            width = min(len(x), len(y))
            assert int(N.np.bitwise_count(N.folded(x, width) ^ N.folded(y, width)).sum()) <= differing
            passes = bool(N.close(x, y, both))
            assert passes or not N.alike(a, b)
            assert not passes or n < 400 or 9 * differing <= 1.15 * both


def test_a_group_just_beyond_the_bound_is_ruled_out_without_its_sets(spark, monkeypatch):
    """Long texts, each some words off one original and as far from each other as to be no near copies: compared sets grow with the rows, not the pairs."""
    rng = random.Random(4)
    base = prose(rng, 1500, [f"w{k}" for k in range(4000)])
    compared = {}
    verified = N._verified

    def counted(pairs, sketches, sets, name):
        left = N._pairs_of(pairs, sketches, ["n", "bits"], N._can_be).count()
        compared[n] = compared.get(n, 0) + left
        return verified(pairs, sketches, sets, name)

    monkeypatch.setattr(N, "_verified", counted)
    for n in (20, 80):
        rows = [(k, changed(rng, base, 24)) for k in range(n)]
        got = {r["doc_id"]: r["component_id"] for r in N.near_copies(documents(spark, rows)).collect()}
        assert got == brute(rows)
    assert compared[80] <= 5 * max(20, compared[20]), compared


def test_blocks_of_any_size_give_the_same_links(spark):
    rng = random.Random(5)
    originals = [prose(rng, 100) for _ in range(3)]
    rows = [(k, changed(rng, rng.choice(originals), rng.choice([1, 2, 4, 6]))) for k in range(90)]
    sets = N._sets(documents(spark, rows), "doc_id", "text").persist()
    every = sets.selectExpr("1L as key", "fp", "fp as label").distinct()
    found = [{(r["u"], r["v"]) for r in N._in_blocks(every, sets.select("fp", "n", "bits").distinct(), block).collect()} for block in (1 << 21, 1000, 129)]
    assert found[0] == found[1] == found[2] and all(u > v for u, v in found[0])
    own = {r["fp"]: N.shingles(dict(rows)[r["doc_id"]].encode()) for r in sets.collect()}
    assert {(u, v) for u in own for v in own if u > v and N.alike(own[u], own[v])} <= found[0]


def test_fuzzy_keys_propose_what_is_within_two_bits(spark, monkeypatch):
    """Sets whose SimHashes differ in two bits at most share a Golay key; they are linked if they are alike, bands or not."""
    rng = random.Random(6)
    originals = [prose(rng, 6000) for _ in range(3)]
    rows = [(10 * i + n, changed(rng, t, n)) for i, t in enumerate(originals) for n in range(3)]
    own = {d: N.shingles(t.encode()) for d, t in rows}
    keys = dict(zip(own, map(set, N.fuzzy_keys(list(own.values()))), strict=True))
    near = {(d, e) for d in own for e in own if d < e and (N.fingerprint(own[d]) ^ N.fingerprint(own[e])).bit_count() <= 2}
    assert len(near) >= 3 and all(keys[d] & keys[e] for d, e in near) and N.fuzzy_keys([N.shingles(None)]) == [[]]
    apart = " ".join(f"w{k}" for k in range(50)).encode()
    assert N.fingerprint(N.shingles(apart)).to_bytes(8, "big") == N.simhash.fingerprint(apart, N.WORDS)
    monkeypatch.setattr(N, "band_keys", lambda found: [])
    got = {r["doc_id"]: r["component_id"] for r in N.near_copies(documents(spark, rows)).collect()}
    assert all(got[d] == got[e] == d // 10 * 10 for d, e in near if d % 10 == 0) and {d // 10 for d in got.values()} == {0, 1, 2}
