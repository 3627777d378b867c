import random

from tests.llm.cases import documents, odd_rows, prose, with_clashing_columns
from verdant.llm import decontaminate as D
from verdant.llm.oracles import ORACLE_SQL

ITEM = "Yesterday Anna bought 12 apples for 3 euros and gave Peter 5 km of her longest rope while Anna kept the rest"


def found(spark, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = with_clashing_columns(documents(spark, rows)).drop("item_id").withColumnRenamed("h", "hash")
    return {(r["doc_id"], r["item_id"]): r.asDict() for r in D.contamination(df, bench).collect()}


def test_new_numbers_and_names_are_found_if_consistent(spark):
    swap = lambda t, **kw: __import__("re").sub("|".join(kw), lambda m: kw[m[0]], t)
    other = swap(ITEM, Anna="Berta", Peter="Klaus").replace("12", "7.5").replace(" 3 ", " 40 ")
    twisted = other.replace("while Berta kept", "while Klaus kept")
    rng = random.Random(1)
    rows = [(1, prose(rng, 40) + ". " + ITEM), (2, "so " + other.upper().lower().replace("berta", "Berta").replace("klaus", "Klaus")), (3, twisted), (4, prose(rng, 200)), (5, "Anna Peter Klaus 1 2 3 4 km " * 20), (6, ITEM[:60])]
    got = found(spark, rows, [(7, ITEM), (8, None), (9, "too short, and not there"), (10, prose(rng, 30))])
    assert set(got) == {(1, 7), (2, 7), (3, 7)} and got[1, 7]["verbatim"] and not got[2, 7]["verbatim"] and got[2, 7]["n_slots"] >= 5


def test_short_items_are_found_whole(spark):
    got = found(spark, [(1, "x y please name all seven hills of rome. z"), (2, "please name all seven hills")], [(1, "Please name all seven hills of rome")])
    assert set(got) == {(1, 1)} and got[1, 1]["run_tokens"] == 7


def test_every_offset_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    clean = [w.replace("w", "v") for w in words]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 40)))) for i in range(12)]
    rows = []
    for d in range(60):
        i = rng.randrange(12)
        w = items[i][1].split()
        a, n = rng.randrange(len(w)), rng.randint(8, 20)
        rows.append((d, " ".join([*(rng.choice(clean) for _ in range(rng.randint(0, 30))), *w[a : a + n], *(rng.choice(clean) for _ in range(5))])))
    rows += [(7, rows[7][1]), (None, items[0][1])]
    want = set()
    for d, t in rows:
        for i, s in items:
            need = min(13, len(s.split()))
            w = s.split()
            if any(" " + " ".join(w[k : k + need]) + " " in f" {t} " for k in range(len(w) - need + 1)):
                want.add((d, i))
    assert set(found(spark, rows, items)) == want and want


def test_odd_rows_and_empty_tables(spark):
    assert found(spark, odd_rows(), [(1, ITEM)]) == {}
    assert found(spark, [], [(1, ITEM)]) == {} and found(spark, [(1, ITEM)], []) == {}
    docs = documents(spark, [(1, ITEM), (None, ITEM), (2, None), (3, "fine")])
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in D.without_contaminated(docs, bench).collect()) == [2, 3]


def test_names_in_mixed_case_are_one_slot(spark):
    item = "once we met McDonald and LeBron who came from JavaScript to see DeShawn over there"
    other = item.replace("LeBron", "LaToya")
    got = found(spark, [(d, lead + t) for d, (lead, t) in enumerate([("", item), ("so it is that ", item), ("and ", other)])], [(1, item)])
    assert set(got) == {(0, 1), (1, 1), (2, 1)} and got[0, 1]["verbatim"] and not got[2, 1]["verbatim"]


def test_a_window_counts_whatever_comes_after_it(spark):
    """Verbatim words and then the item's own words with inconsistent numbers; mostly slots, verbatim; one slot later twisted."""
    words = "the old man by the sea told us how to count the ships that came at dawn"
    item = words + " and 3 men had 3 nets and 3 boats and 3 oars"
    rows = [(1, item.replace("3 men", "4 men").replace("3 nets", "5 nets")), (2, words + " and then no more")]
    numbers = "take a 1 2 5 a 1 2 6 b 1 2 7 c 3 4 8 d 5 6 9 of it all"
    rows += [(3, "so " + numbers), (4, "so " + numbers.replace("2", "11"))]
    got = found(spark, rows, [(1, item), (2, numbers)])
    assert set(got) == {(1, 1), (2, 1), (3, 2)} and got[3, 2]["verbatim"]


def test_names_that_begin_a_sentence(spark):
    short = "Maria buys twelve pens for 3 dollars at the shop"
    long = "Tom has 3 red apples and 5 pears. Tom gives 2 apples to Ann. How many apples does Tom have now?"
    rows = [(1, short.replace("Maria", "Petra").replace("3", "4")), (2, "so " + short), (3, "SO " + short.lower()), (4, long.replace("Tom", "Bob").replace("3", "7")), (5, long.replace("Tom has", "Bob has").replace("Tom gives", "Eve gives"))]
    got = found(spark, rows, [(1, short), (2, long)])
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 2)} and got[4, 2]["run_tokens"] > got[5, 2]["run_tokens"] and not got[1, 1]["verbatim"] and got[3, 1]["verbatim"]


def test_short_and_repeated_items(spark):
    got = found(spark, [(1, "a word is here"), (2, "other things 12 34"), (1, "a word is here")], [(1, "Word"), (1, "Word"), (2, "12 34"), (3, "34 12"), (4, "?")])
    assert set(got) == {(1, 1), (2, 2)}
    few = D.contamination(documents(spark, [(1, "a word is here")]), spark.createDataFrame([(1, "word")], "item_id long, text string"), least_tokens=5)
    assert few.count() == 0


def reading(text, merged):
    """(kind, value, unit) by plain code for the simple texts of the test below."""
    out, first, last = [], True, ""
    for x in text.split():
        core, glued = x.strip("."), last
        last = ""
        if core.isdigit():
            out.append(("#", core, None))
            last = "#"
        elif core[0].isupper() and merged and glued == "N":
            out[-1] = ("N", f"{out[-1][1]} {core.lower()}", None)
            last = "N"
        elif core[0].isupper() and (merged or not first):
            out.append(("N", core.lower(), None))
            last = "N"
        elif merged and glued == "#":
            out[-1] = (*out[-1][:2], core)
        else:
            out.append((core.lower(), "", None))
        first = x.endswith(".")
        last = "" if first else last
    return out


def values(pairs):
    out = [((p[0], p[1]), (q[0], q[1])) for p, q in pairs]
    return out + [(("u", p[2]), ("u", q[2])) for p, q in pairs if p[2] and q[2]]


def test_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda: rng.choice([f"w{chr(97 + k)}" for k in range(26)] + ["Anna", "Berta", "Carl", "Dora", *map(str, range(1, 6))])
    text = lambda n: " ".join(word() + ("." if rng.random() < 0.15 else "") for _ in range(n))
    items = [(i, text(rng.randint(1, 30))) for i in range(25)]
    rows = []
    for d in range(150):
        w = rng.choice(items)[1].split()
        a = rng.randrange(len(w))
        w = w[a : a + rng.randint(5, 30)]
        swap = {x: word() for x in ("Anna", "Berta", "1", "2", "3") if rng.random() < 0.4}
        swap = {k: v for k, v in swap.items() if v[0].isupper() == k[0].isupper() and v.isdigit() == k.isdigit()}
        w = [swap.get(x.strip("."), x.strip(".")) + "." * x.endswith(".") if rng.random() < 0.97 else word() for x in w]
        rows.append((d, " ".join([text(rng.randint(0, 20)), *w, text(rng.randint(0, 20))])))
    want = {}
    for d, t in rows:
        for i, s in items:
            for merged in (False, True):
                x, y = reading(t, merged), reading(s, merged)
                need = min(13, len(y))
                for shift in range(-len(y), len(x)):
                    run = 0
                    for k in range(len(y)):
                        pairs = list(zip(y[k : k + need], x[k + shift : k + shift + need], strict=False)) if k + shift >= 0 else []
                        slots = [(p, q) for p, q in pairs if p[0] in "#N"]
                        v = values(slots)
                        ok = len(pairs) == need and all(p[0] == q[0] for p, q in pairs) and (all(p == q for p, q in v) or (len(set(v)) == len({p for p, _ in v}) and 2 * len(slots) <= need))
                        run = (run + 1 if run else need) if ok else 0
                        if run > want.get((d, i), 0):
                            want[d, i] = run
    got = {k: r["run_tokens"] for k, r in found(spark, rows, items).items()}
    assert got == want and len(want) > 50


def test_names_of_several_words_and_any_unit(spark):
    rows = [(1, ITEM.replace("Peter", "Mary Ann")), (2, ITEM.replace("5 km", "5 furlongs")), (3, ITEM.replace("Anna", "Eva Maria Stein").replace("12 apples", "7 pears").replace("3 euros", "3 rupees"))]
    # Twelve tokens on each side of what isn't consistent: one unit for two, one name for two.
    short = "so 3 km and then 4 km and on with Ann and again with Ann"
    rows += [(4, short.replace("3 km", "5 rods").replace("4 km", "6 rods")), (5, short.replace("3 km", "5 rods")), (6, short.replace("with Ann and", "with Eva Lee and"))]
    got = found(spark, rows, [(7, ITEM), (8, short)])
    assert set(got) == {(1, 7), (2, 7), (3, 7), (4, 8)} and got[1, 7]["run_tokens"] > 13 and not any(r["verbatim"] for r in got.values() if r["doc_id"] != 2)


def test_whole_short_items_between_numbers_names_and_units(spark):
    """An item's last number takes no unit from what follows, its first word none from before."""
    rows = [(1, "take 5 apples are red and there are 12 then"), (2, "says Eva Peter likes the old house by the sea"), (3, "5. apples are red and there are 13 of them")]
    got = found(spark, rows, [(1, "apples are red and there are 12"), (2, "Peter likes the old house by the sea")])
    assert set(got) == {(1, 1), (2, 2), (3, 1)} and got[1, 1]["verbatim"] and not got[3, 1]["verbatim"]


# Questions of the four languages: {a} and {b} names, {n}, {m} and {k} numbers, {u} and {v} units.
QUESTIONS = {
    "en": ["{a} has {n} {u} of rope and cuts off {m} {u}. How much rope is left when {b} takes another {k} {u}?", "A train leaves the station at {n} {u} and {a} drives for {m} {v} until the next stop, where {b} waits for {k} {v}.", "If {a} buys {n} {u} for {m} {v}, how many {v} does {b} pay for {k} {u} at the same shop?"],
    "de": ["{a} hat {n} {u} Seil und schneidet davon {m} {u} ab. Wie viel bleibt, wenn {b} noch einmal {k} {u} nimmt?", "Auf dem Markt kauft {a} genau {n} {u} und zahlt {m} {v}, dann gibt {b} ihr {k} {v} zurück und geht nach Hause.", "Wenn {a} in einer Stunde {n} {u} schafft, wie lange braucht dann {b} für {k} {u} auf dem gleichen Weg?"],
    "fr": ["{a} possède {n} {u} de corde et en coupe {m} {u}. Combien en reste-t-il quand {b} prend encore {k} {u}?", "Au marché {a} achète {n} {u} et paie {m} {v}, puis {b} lui rend {k} {v} avant de rentrer à la maison.", "Si {a} parcourt {n} {u} en une heure, combien de temps faut-il alors pour que {b} fasse {k} {u} sur la même route?"],
    "es": ["{a} tiene {n} {u} de cuerda y corta {m} {u}. Cuánto queda cuando {b} toma otros {k} {u} de la misma cuerda?", "En el mercado {a} compra {n} {u} y paga {m} {v}, luego {b} le devuelve {k} {v} antes de volver a casa.", "Si {a} recorre {n} {u} en una hora, cuánto tiempo necesita entonces {b} para hacer {k} {u} por el mismo camino?"],
}
NAMES = ["Anna", "Mary Ann", "José", "Eva Maria Stein", "Zoë", "Klaus", "Ngozi", "Li Wei"]
UNITS = {"en": ["km", "furlongs", "pears", "rods"], "de": ["Meter", "Äpfel", "Ellen", "Pfund"], "fr": ["mètres", "toises", "poires", "km"], "es": ["metros", "varas", "peras", "km"]}


def test_recall_of_planted_questions(spark):
    """At least 0.9 of 60 re-parameterised copies a language are found, none by another item, and no text without a copy."""
    rng = random.Random(11)

    def fill(lang, q):
        (a, b), (u, v) = rng.sample(NAMES, 2), rng.sample(UNITS[lang], 2)
        n, m, k = rng.sample([2, 3, 7, 12, 40, "1,500", 6.25, 81], 3)
        return q.format(a=a, b=b, n=n, m=m, k=k, u=u, v=v)

    items, rows, want = [], [], {}
    for lang, questions in QUESTIONS.items():
        for q in questions:
            items.append((len(items), fill(lang, q)))
            for _ in range(20):
                want[len(rows)] = (lang, items[-1][0])
                rows.append((len(rows), f"{prose(rng, 30)}. {fill(lang, q)} {prose(rng, 30)}"))
    rows += [(len(rows) + i, prose(rng, 100)) for i in range(100)]
    got = set(found(spark, rows, items))
    for lang in QUESTIONS:
        own = [(d, i) for d, (x, i) in want.items() if x == lang]
        print(lang, sum(p in got for p in own), "of", len(own))
        assert len(own) == 60 and sum(p in got for p in own) >= 54, lang
    assert got == {p for p in got if p[1] == want[p[0]][1]}


def test_units_that_are_asked_for(spark):
    """A unit after "how many" may change with its numbers' units; all results against the SQL."""
    item = "Tom has 3 pears and 5 nuts, so how many pears does Ann have if she takes 4 nuts from the box at home"
    other = item.replace("pears", "rods").replace("nuts", "figs")
    twisted = item.replace("3 pears", "3 rods")
    german = "Wenn der Korb leer ist, wie viele davon hat dann die Frau in der Stadt noch zu kaufen"
    rows = [(1, other), (2, "well, " + other.replace("how many", "HOW  MANY")), (3, twisted), (4, german), (5, item.replace("pears does", "of us does")), (6, "how many how many pears how many km5 how many 5 km how many")]
    items = [(1, item), (2, german), (3, "how many pears how many km5 how many 5 km how many of")]
    got = found(spark, rows, items)
    assert {(1, 1), (2, 1), (4, 2)} <= set(got) and not got[1, 1]["verbatim"] and got[4, 2]["verbatim"] and got[1, 1]["run_tokens"] > got.get((3, 1), {"run_tokens": 0})["run_tokens"]
    con = __import__("duckdb").connect()
    for table, key, values in (("documents", "doc_id", rows), ("benchmark", "item_id", items)):
        con.execute(f"create table {table} ({key} bigint, text varchar)")
        con.executemany(f"insert into {table} values (?, ?)", values)
    names = ("doc_id", "item_id", "run_tokens", "n_slots", "verbatim")
    assert sorted(tuple(r[n] for n in names) for r in got.values()) == sorted(con.execute(ORACLE_SQL["op3_decontaminate"]).fetchall())


def test_runs_of_any_length(spark):
    """Thousands of names or digits in a row end no executor, and what comes after them is found."""
    runs = ["Anna Maria " * 10_000, "7" * 20_000, "1,234." * 5_000 + "5", "12 km " * 5_000]
    rows = [(d, f"so {run}. And then: {ITEM}") for d, run in enumerate(runs)] + [(9, runs[0])]
    assert set(found(spark, rows, [(7, ITEM)])) == {(d, 7) for d in range(len(runs))}
