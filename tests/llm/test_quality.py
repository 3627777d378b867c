import math
import random
import re
from collections import Counter

from tests.llm.cases import documents, odd_rows, prose, with_clashing_columns
from verdant.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    n = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in Q.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


def histograms(text, lang):
    w = WORD.findall(text or "")
    dense = "".join(w)
    kinds = [sum("a" <= c <= "z" for c in dense), sum("A" <= c <= "Z" for c in dense), sum("0" <= c <= "9" for c in dense), sum(c in Q.SYMBOLS for c in dense)]
    other = sum(ord(c) > 127 for c in dense)
    kinds += [len(dense) - sum(kinds) - other, other, max(0, len(w) - 1)]
    own = [sum(x.lower() == c for x in w) for c in Q.COMMON_WORDS[lang]]
    return kinds, [*own, len(w) - sum(own)]


def distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    term = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0
    return math.sqrt(max(0, sum(term(a, b) + term(b, a) for a, b in zip(p, q, strict=True)) / 2))


def sample():
    rng = random.Random(1)
    en = [*Q.COMMON_WORDS["en"], *(a + b for a in "th er on an re in".split() for b in "he an ing ed or at".split())]
    fr = [*Q.COMMON_WORDS["fr"], *(a + b for a in "é è ou ai re".split() for b in "aux ment tion oi".split())]
    good = [(i, prose(rng, 200, en), "en") for i in range(30)] + [(50 + i, prose(rng, 200, fr), "fr") for i in range(30)]
    signs = [(100 + i, " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in prose(rng, 150, en).split()), "en") for i in range(2)]
    lists = [(110 + i, " | ".join("item" + str(rng.randrange(10**6)) for _ in range(150)), "fr") for i in range(2)]
    again = [(120, "buy this now " * 60, "en"), (121, "a b\na b\n\nc\n a b", None)]
    return good, signs + lists, again + [(d, t, "xx") for d, t in odd_rows()]


def test_counts_and_verdicts(spark):
    good, bad, odd = sample()
    rows = good + bad + odd
    df = with_clashing_columns(documents(spark, rows)).withColumn("kept", Q.F.lit("x"))
    got = Q.quality(df).collect()
    assert sorted(((r["doc_id"], *(r[c] for c in Q.RESULT[1:6])) for r in got), key=repr) == sorted(((d, *counts(t)) for d, t, _ in rows), key=repr)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[d] for d, *_ in good) and not any(kept[d] for d, *_ in bad)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in got) and all(not r["kept"] for r in got if r["base_failed"])


def test_distances_are_jensen_shannon(spark):
    good, bad, _ = sample()
    rows = good + bad
    refs, n = {}, Counter()
    for _, t, lang in rows:
        c = counts(t)
        if c[0] >= 100 and c[1] >= 200 and 100 * c[4] <= 50 * c[0]:
            n[lang] += 1
            for k, h in enumerate(histograms(t, lang)):
                have = refs.setdefault(lang, [[0] * Q.CLASSES, [0] * 17])[k]
                have[:] = [a + b / sum(h) for a, b in zip(have, h, strict=True)]
    refs = {lang: [[x / n[lang] for x in h] for h in both] for lang, both in refs.items()}
    by_id = {d: (t, lang) for d, t, lang in rows}
    for r in Q.quality(documents(spark, rows)).collect():
        t, lang = by_id[r["doc_id"]]
        for got, own, ref in zip((r["class_distance"], r["word_distance"]), histograms(t, lang), refs[lang], strict=True):
            assert abs(got - distance(own, ref)) < 1e-9


def test_a_language_is_guessed_where_none_is_stated(spark):
    rows = [(1, "la maison est dans la rue et le chat dort sur les toits de la ville", None), (2, "the cat is on the roof of the house", "xx")]
    got = {r["doc_id"]: r["_lang"] for r in Q.with_histograms(Q.with_counts(documents(spark, rows))).collect()}
    assert got == {1: "fr", 2: None}


def test_other_languages_are_judged_by_the_base_rules_alone(spark):
    good, _, _ = sample()
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("あいうえおかきくけこ") for _ in range(5)) for _ in range(200))
    got = {r["doc_id"]: (r["kept"], r["class_distance"]) for r in Q.quality(documents(spark, [*good, (9001, text, "ja"), (9002, "日本 " * 200, "ja")])).collect()}
    assert got[9001] == (True, None) and got[9002] == (False, None)


def test_empty_table(spark):
    assert Q.quality(documents(spark, [])).count() == 0
