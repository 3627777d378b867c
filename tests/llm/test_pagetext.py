import random

from verdant.llm import pagetext as P

SCHEMA = "page_id long, url string, html string"
PAGE = "<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Home<li>About</ul></nav><div class='cookie-notice'>ok?</div><article><h1>Title &amp; more</h1><p>One\n two&nbsp;three<br>four<p><b>Five</b> six<script>var x='</p>'</script><div class=\"ad box\">Buy</div><aside>See</aside><p>Seven</p></article><section id=comments><p>First!</p></section><form><p>Mail</p></form><!-- c --><footer>&copy; x</footer></body></html>"


def test_article_only():
    keep = [t for t, main, bad in P.lines(PAGE) if main and not bad]
    assert keep == ["Title & more", "One two three four", "Five six", "Seven"]


def test_broken_markup_ends_somewhere():
    rng = random.Random(1)
    for _ in range(400):
        cut = PAGE[rng.randrange(len(PAGE)) :][: rng.randrange(len(PAGE))] + "".join(rng.choice("<>\"'/=&! pa") for _ in range(10))
        for text, _, _ in P.lines(cut):
            assert text == " ".join(text.split()) and text
    assert P.lines("") == [] and [t for t, *_ in P.lines("a < b &lt; c")] == ["a < b < c"] and P.lines("<script>x") == []


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(25))] for _ in range(2))
        for most in (1 << 28, 8):
            at = P.common_lines(a, b, most)
            values = iter(b)
            assert at == sorted(set(at)) and all(any(x == y for y in values) for x in (a[i] for i in at)) and len(at) == lcs(a, b)


def bare(lines):
    return "<body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body>"


def test_pages_without_an_article_lose_what_their_neighbour_has(spark):
    rows = [(i, f"http://h{i % 3}.org/a/{i:03d}?p=1#f", bare(["Menu", f"text {i}", "more" if i % 2 else f"other {i}", "Foot"])) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {r["page_id"]: r for r in P.main_text(df).collect()}
    assert all(got[i]["text"].split("\n\n")[0] == f"text {i}" and "Menu" not in got[i]["text"] and "Foot" not in got[i]["text"] for i in range(60))


def test_neighbours_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = [(i, f"http://h.org/{rng.choice('abc')}/{rng.randrange(40)}", bare([rng.choice("ABCDEFG") for _ in range(6)])) for i in range(120)]
    texts = []
    for parts in (1, 4, 9):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        texts.append(sorted(tuple(r) for r in P.main_text(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert texts[0] == texts[1] == texts[2]


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://h/a", ""), (3, "http://h/a", PAGE), (3, "http://h/a", PAGE), (None, "x", bare(["only"])), (4, "http://h/b", bare(["z"] * 3000))]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("text", "host", "path", "same", "shared", "texts"):
        df = df.withColumn(c, df.page_id)
    got = sorted(((r["page_id"], r["n_chars"]) for r in P.main_text(df).collect()), key=repr)
    assert got == sorted([(1, 0), (2, 0), (3, 49), (3, 49), (None, 4), (4, 3 * 3000 - 2)], key=repr)
    assert P.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def article(lines, tag="article"):
    return f"<body><{tag}>" + "".join(f"<p>{x}</p>" for x in lines) + f"</{tag}></body>"


def test_articles_lose_unmarked_boilerplate_that_their_neighbour_has(spark):
    rows = [(i, f"http://h/a/{i:03d}", article(["Share on Foo", f"Title {i}", f"Text number {i} is here.", "Sponsored", f"It goes on with {i}.", "All agree on that one.", "Yes.", f"End {i}.", "Read on.", "Print"], ("article", "main")[i % 2])) for i in range(20)]
    got = {r["page_id"]: r["text"].split("\n\n") for r in P.main_text(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    # A short sentence that all pages have at the same place isn't evident prose.
    assert all(got[i] == [f"Title {i}", f"Text number {i} is here.", f"It goes on with {i}.", "All agree on that one.", f"End {i}."] for i in range(20))


def test_a_line_needs_many_pages_at_the_same_place(spark):
    """Shared with the neighbour alone, or by a few of the host's pages, or at another place each time: it stays."""
    rows = [(i, f"http://h/b/{i}", article([f"Title {i}", "Yes.", f"Own line {i}."])) for i in range(2)]
    rows += [(10 + i, f"http://k/c/{i}", article(["The title", "A long sentence that both of the copies have in them.", f"Own {i}."])) for i in range(2)]
    rows += [(20 + i, f"http://l/c/{i:02d}", article([*(f"Line {i} {k}" for k in range(i)), "Les.", *(f"End {i} {k}" for k in range(20 - 2 * i))])) for i in range(10)]
    rows += [(40 + i, f"http://m/c/{i:02d}", article([f"Title {i}", *(["Print"] if i < 4 else []), f"Own line {i}."])) for i in range(20)]
    got = {r["page_id"]: r["text"].split("\n\n") for r in P.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all("Yes." in got[i] for i in range(2)) and all(got[10 + i][0] == "The title" and len(got[10 + i]) == 3 for i in range(2))
    assert all("Les." in got[20 + i] for i in range(10)) and all("Print" in got[40 + i] for i in range(4))


def test_no_article_line_is_lost_on_the_tables(spark, monkeypatch):
    path = "/root/testdata/sf0.01/pages.parquet"
    if not __import__("os").path.exists(path):
        __import__("pytest").skip("no tables")
    pages = spark.read.parquet(path)
    texts = lambda: {r["page_id"]: r["text"] for r in P.main_text(pages).collect()}
    on = texts()
    monkeypatch.setattr(P, "frame_lines", lambda places, shared: shared.selectExpr("host", "path", "same", "cast(array() as array<int>) as frame").where("false"))
    assert on == texts() and len(on) > 200


def test_a_teaser_card_is_not_the_page(spark):
    body = "This is the long body of the page, which is in no article at all."
    page = f"<body><p>{body}</p><article><p>See this too</p></article></body>"
    assert [r["text"] for r in P.main_text(spark.createDataFrame([(1, "http://h/a", page)], SCHEMA)).collect()] == [f"{body}\n\nSee this too"]


class Blocks(__import__("html.parser").parser.HTMLParser):
    """Blocks of the simple pages of the test below: (text, in an article, in a menu); independent of the operator's parser."""

    def __init__(self, page):
        super().__init__()
        self.found, self.text, self.inside = [], "", []
        self.feed(page)
        self.close()
        self.cut()

    def cut(self):
        if self.text.split():
            self.found.append((" ".join(self.text.split()), "article" in self.inside, "nav" in self.inside))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        self.cut()
        self.inside += [tag] if tag != "p" else []

    def handle_endtag(self, tag):
        self.cut()
        if tag in self.inside:
            self.inside.remove(tag)

    def handle_data(self, data):
        self.text += data


def common(a, b):
    """Positions in ``a`` of a longest common subsequence, by a table."""
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            n[i + 1][j + 1] = n[i][j] + 1 if a[i] == b[j] else max(n[i][j + 1], n[i + 1][j])
    return n[-1][-1]


def brute(rows):
    """The whole query in plain Python: parser, places, sentences and counts of its own; of equally long subsequences the operator's."""
    import re
    from collections import Counter
    from urllib.parse import urlsplit

    parsed = []
    for key, url, page in rows:
        found = Blocks(page or "").found
        u = urlsplit(url or "")
        parsed.append((key, (u.netloc, u.path + (f"?{u.query}" if u.query else "")) if u.netloc else ("", url or ""), [t for t, _, _ in found], found))
    order = lambda texts: P._signed(P.xxhash.xxh64_intdigest(",".join(str(P._signed(P.xxhash.xxh64_intdigest(t))) for t in texts)))
    places = sorted({(*place, tuple(texts)) for _, place, texts, _ in parsed}, key=lambda x: (x[0].encode(), x[1].encode(), order(x[2])))
    at = {x: i for i, x in enumerate(places)}
    sentence = lambda t, n: bool(re.search(r"[.!?][\"')]*$", t)) and len(t.split()) >= n
    pages = {}
    for _, place, texts, found in parsed:
        i = at[(*place, tuple(texts))]
        near = [places[j] for j in (i - 1, i + 1) if 0 <= j < len(places) and places[j][0] == place[0] and list(places[j][2]) != texts]
        shared = set()
        if near:
            other = list(max(near, key=lambda n: len(__import__("os").path.commonprefix([n[1], place[1]])))[2])
            shared = set(P.common_lines(texts, other))
            assert len(shared) == common(texts, other)
        left = [k for k, (_, _, menu) in enumerate(found) if not menu]
        main = [k for k in left if found[k][1]]
        body = sum(len(texts[k]) for k in left if not found[k][1] and sentence(texts[k], 8))
        keep = main if main and body <= sum(len(texts[k]) for k in main) else left
        pages[i] = (place[0], texts, found, shared, keep, [k for k in keep if found[k][1]])
    count, n_pages = Counter(), Counter()
    for host, texts, _, shared, _, article_ in pages.values():
        n_pages[host] += 1
        for n, k in enumerate(article_):
            if k in shared and not sentence(texts[k], 4):
                count.update([(host, texts[k], "first", n), (host, texts[k], "last", len(article_) - n)])
    out = []
    for key, place, texts, _ in parsed:
        host, _, found, shared, keep, article_ = pages[at[(*place, tuple(texts))]]
        kept = []
        for k in keep:
            n = article_.index(k) if k in article_ else None
            often = 0 if n is None else max(count[host, texts[k], "first", n], count[host, texts[k], "last", len(article_) - n])
            framed = often >= 3 and 2 * often >= n_pages[host] and not sentence(texts[k], 4)
            # A line counts at the places at which it often is.
            if k not in shared or (found[k][1] and not framed):
                kept.append(texts[k])
        out.append((key, "\n\n".join(kept), len(shared)))
    return sorted(out, key=repr)


def test_the_whole_query_against_brute_force_and_without_alignment(spark, monkeypatch):
    rng = random.Random(11)
    bits = ["Menu", "Home page", "Read on.", "Yes.", "No.", "A sentence of five words.", "Another sentence of many more words than that one has.", "Print", "One", "Two"]
    rows = []
    for i in range(150):
        lines = [rng.choice(bits) if rng.random() < 0.6 else f"Own line {rng.randrange(9)}" + rng.choice(["", "."]) for _ in range(rng.randint(0, 9))]
        cut = rng.randint(0, len(lines))
        page = "<body><nav><p>Nav</p></nav>" + "".join(f"<p>{x}</p>" for x in lines[:cut]) + rng.choice(["<article>", "<div>"]) + "".join(f"<p>{x}</p>" for x in lines[cut:])
        rows.append((i, f"http://h{rng.randrange(4)}.org/{rng.choice('ab')}/{rng.randrange(60)}", page))
    rows += [(300 + i, f"http://framed.org/{i:02d}", article([*(["Print"] if i % 3 else []), f"Own line {rng.randrange(99)}", *rng.sample(bits, 2), "Read on.", "Share"])) for i in range(40)]
    rows += [(200, "http://h1.org/a/5", rows[0][2]), (7, *rows[7][1:]), (None, None, rows[3][2]), (201, "http://long.org/a", bare([f"line {i}" for i in range(900)])), (202, "http://long.org/b", bare([f"line {i * 2}" for i in range(900)]))]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    for parts in (1, 4, 40):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = sorted(((r["page_id"], r["text"]) for r in P.main_text(df.repartition(3)).collect()), key=repr)
        assert got == sorted([(k, t) for k, t, _ in want], key=repr)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    monkeypatch.setattr(P, "shared_lines", lambda places: places.selectExpr("host", "path", "same", "cast(array() as array<int>) as shared"))
    off = dict(((r["page_id"], r["text"]) for r in P.main_text(df).collect()))
    assert sum(off[k] != t for k, t, _ in want) > 50  # the alignment decides
