"""op11 against plain patterns and counts over all words."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest

from tests.llm.cases import documents, odd_rows, prose, with_clashing_columns
from verdant.llm import personal as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == "card" and 14 <= len(d) <= 19 and luhn(d))
                or (kind == "phone" and 10 <= len(d) <= 15)
            ):
                out.append((m.start(), n, m.end(), kind, m[0].lower() if kind == "email" else m[0] if kind == "ip" else d))
    return sorted(out)


def shape(t):
    out = []
    for c in t:
        c = "0" if c.isdecimal() else "a" if re.match(r"[^\W\d_]", c) else c
        if not out or out[-1] != c or c not in "0a":
            out.append(c)
    return "".join(out)


def brute(rows, contexts=P.LEAST_CONTEXTS):
    n_t, n_g, n_ct, n_cg, around, docs = Counter(), Counter(), Counter(), Counter(), defaultdict(set), []
    for key, text in rows:
        text = text or ""
        spans = plain_spans(text)
        words = []
        for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
            hit = any(s < m.end() and m.start() < e for s, _, e, _, _ in spans)
            inner = m[0].strip(P._EDGES)
            at = m.start() + (m[0].find(inner) if inner else 0)
            words.append(("" if hit else inner.lower(), at, at + len(inner), m.start(), m.end()))
        named = set()
        once = set()
        for s, _, e, kind, value in spans:
            touch = [i for i, w in enumerate(words) if s < w[4] and w[3] < e]
            near = [i for i, w in enumerate(words) if w[0] and (touch[0] - 8 <= i < touch[0] or touch[-1] < i <= touch[-1] + 8)]
            for i in near:
                if (kind, value, i) not in once:
                    once.add((kind, value, i))
                    t = words[i][0]
                    n_ct[kind, value, t] += 1
                    n_cg[kind, value, shape(t)] += 1
                    around[kind, value, t].add(tuple(words[j][0] for j in near))
                    named.add((kind, value, t))
        n_t.update(w[0] for w in words if w[0])
        n_g.update(shape(w[0]) for w in words if w[0])
        docs.append((key, spans, words, named))
    n_all, n_c = sum(n_t.values()), Counter()
    for (kind, value, _), n in n_ct.items():
        n_c[kind, value] += n
    share = lambda c, a, b: 1 + math.log2(a / b) / math.log2(n_all / n_c[c])
    bad = {}
    for (kind, value, t), n in n_ct.items():
        c = kind, value
        if len(around[kind, value, t]) >= contexts and n_c[c] < n_all and share(c, n, n_t[t]) >= P.MOST_DISCLOSED:
            bad[kind, value, t] = share(c, n_cg[kind, value, shape(t)], n_g[shape(t)]) >= P.MOST_DISCLOSED
    out = []
    for key, spans, words, named in docs:
        removed = defaultdict(bool)
        for k in named & set(bad):
            removed[k[2]] |= bad[k]
        base = [f"{kind}:{s}:{e}" for s, _, e, kind, _ in spans]
        every = [(s, n, b) for (s, n, *_), b in zip(spans, base, strict=True)]
        every += [(s, 5 if removed[t] else 4, f"{'removed' if removed[t] else 'general'}:{s}:{e}") for t, s, e, _, _ in words if t in removed]
        n = Counter(x[3] for x in spans)
        out.append((key, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(x[2] for x in sorted(every))))
    return sorted(out, key=repr)


def corpus(seed=1):
    """Prose with entities, some of which have words of their own near them in several surroundings."""
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        text = prose(rng, rng.randint(5, 120)).split()
        if i % 4 == 0:
            who = rng.randint(0, 9)
            entity = [f"ann.{who}@mail.example.com", f"10.0.{who}.7", "4111 1111 1111 1111", f"+1 (555) 010-42{who:02}"][who % 4]
            near = [f"Quietlake{who},", prose(rng, 2), entity, prose(rng, 2), f"badge{who}x{rng.choice(['', '!'])}"]
            at = rng.randint(0, len(text))
            text[at:at] = near
        rows.append((i, " ".join(text)))
    text = "see badge1x and Quietlake1 or 10.0.1.7 by badge1x, far " + prose(rng, 30) + " Quietlake1"
    return rows + [(1000, "clean words only"), (1001, text), (1001, text), (None, text), (1002, "Quietlake1 without the address")]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_plain_counts(spark):
    rows = corpus() + [r for r in odd_rows() if len(r[1] or "") < 20_000]
    df = with_clashing_columns(documents(spark, rows)).repartition(5)
    assert collected(P.found(df)) == brute(rows)
    got = collected(P.found(df, contexts=3))
    assert got == brute(rows, 3)
    spans = {r[0]: r[-1] for r in got}
    assert "general:" in spans[1001] and spans[1000] == "" and spans[1002] == ""
    assert spans[1001].count("general:") == 4  # all places in the document, not those near the address only


def test_copies_are_no_evidence(spark):
    rng = random.Random(2)
    text = f"{prose(rng, 40)} unseen words about bob@site.example.org unheard {prose(rng, 40)}"
    rows = [(i, text) for i in range(50)] + [(100 + i, prose(rng, 60)) for i in range(50)]
    assert "unseen" in P.sanitised(documents(spark, rows), contexts=2).where("doc_id = 0").first()["text"]
    assert "unseen" not in P.sanitised(documents(spark, rows)).where("doc_id = 0").first()["text"]
    got = collected(P.found(documents(spark, rows), contexts=2))
    assert got == brute(rows, 2) and all("general" not in r[-1] and "removed" not in r[-1] for r in got)


TEXTS = [
    "a@b.c", "a@b", "@b.c", "x@a.b+y@c.d", "a..b@c-d.e.f.", "a@b.c@d.e", "a@@b.c", "ü@b.cd", "%@-.-", "a@b..c", "a@b.c-@d.e",
    "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.4", "1.2.3", "1.2.3.4567 1.1.1.1", "00000000000000000255.1.1.1", "9.1.2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111  1111 1111 1111", "41111111111111111", "00000000000000", "4111 1111 1111 1112", "1 2 3 4111111111111111",
    "+1 (555) 010-9999", "+1", "+12", "+1 2", "+1 555 010 9999 ", "+1 (555) 010-9999 (", "++1 555 010 9999", "+1 555+1 555 010 9999", "+123456789012345678",
]


@pytest.mark.parametrize("text", TEXTS)
def test_patterns(text):
    assert [(s, n, e, v) for s, n, e, _, v in plain_spans(text)] == P.base_spans(text)


def test_patterns_on_random_signs():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice("1234567890123 .-+()@ab%") for _ in range(rng.randint(1, 60)))
        assert [(s, n, e, v) for s, n, e, _, v in plain_spans(text)] == P.base_spans(text), text


def test_long_texts_take_linear_time():
    began = time.time()
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1." * 1_000_000, "1 " * 1_000_000, "+1" + "(" * 2_000_000, "a@" * 1_000_000, "a@b" + "-" * 2_000_000):
        P.base_spans(text)
    assert time.time() - began < 60


def test_sanitised(spark):
    rows = corpus()
    docs = with_clashing_columns(documents(spark, rows))
    out = P.sanitised(docs, contexts=3)
    assert out.columns == docs.columns and out.count() == len(rows)
    text = {r["doc_id"]: r["text"] for r in out.select("doc_id", "text").collect()}
    assert text[1001].startswith("see [a0a] and [a0] or [IP] by [a0a], far ") and text[1002] == "Quietlake1 without the address" and text[1000] == "clean words only"
    assert P.sanitise("x a@b.c y", ["email:2:7"], [(0, 1, True)]) == "[] [EMAIL] y"


def test_empty_table(spark):
    assert P.found(documents(spark, [])).count() == 0 and P.sanitised(documents(spark, [])).count() == 0
    assert collected(P.found(documents(spark, [(1, None), (None, "")])))[0][1:5] == (0, 0, 0, 0)
