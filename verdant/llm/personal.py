"""Personal data: base patterns, and terms that reveal them by the corpus's co-occurrences.

Each distinct address, number or card that a base pattern finds is a protected
entity c of information IC(c) = -log2 p(c). A term t within ``WINDOW`` words of
it discloses PMI(c; t) = log2 p(c, t) / (p(c) p(t)) bits of that, as counted over
the words of all documents. A term that discloses at least ``MOST_DISCLOSED`` of
IC(c) is sanitised in the documents that name c near it: generalised to its
shape, or removed where the shape itself discloses too much. A name stands beside
its address once in most corpora, so one surrounding is evidence by default; with
more required, copies of a passage alone are none, as they are one surrounding.

One scan writes spans, windows, term places and word counts; all else is joins and
sums of those small rows. Texts are never shuffled and nothing is broadcast by us.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.llm.shared import free_name, written
from verdant.shipping import ship

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the method's own spans.
GENERAL, REMOVED = "general", "removed"
WINDOW = 8
MOST_DISCLOSED = 0.9
LEAST_CONTEXTS = 1

# The patterns start only where a match can begin and never give back, so long texts without a match take linear time.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = string.punctuation + "«»“”„’‘…–—¿¡"
_SLICE, _MOST_WORDS = 256, 1 << 18

#: (start, kind's number, end, the entity's value)
Span = tuple[int, int, int, str]


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches, each found from its @."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, 0, m.end(), text[start : m.end()].lower()
            low = m.end()
        at = text.find("@", max(at + 1, low))


def luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base patterns' matches by start, then kind."""
    found = list(_emails(text))
    found += [(m.start(), 1, m.end(), m[0]) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0]) if len(m[0]) > 13 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = _DIGITS.sub("", m[0])
            if 10 <= len(digits) <= 15:
                found.append((m.start(), 3, m.end(), digits))
    return sorted(found)


def term(word: str) -> tuple[str, int, int]:
    """A word without the signs round it, in lower case, and where in the word it begins and ends; a word of signs only is an empty term."""
    left = len(word) - len(word.lstrip(_EDGES))
    right = len(word.rstrip(_EDGES))
    return word[left:right].lower(), left, max(left, right)


def shape(name: str) -> str:
    """What a term is generalised to: runs of letters as a, of digits as 0, other characters as they are."""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "0", name))


def places(text: str, spans: list[Span]) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """(term, start, end) of each word, an empty term for those that touch a span; per span the first and the last word it touches."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts, ends = [s for s, _ in words], [e for _, e in words]
    touched = [(bisect_right(ends, s), bisect_left(starts, e) - 1) for s, _, e, _ in spans]
    hidden = {i for a, b in touched for i in range(a, b + 1)}
    out = []
    for i, (s, e) in enumerate(words):
        name, left, right = ("", 0, 0) if i in hidden else term(text[s:e])
        out.append((name, s + left, s + right))
    return out, touched


def windows(spans: list[Span], words: list[tuple[str, int, int]], touched: list[tuple[int, int]], size: int = WINDOW) -> Iterator[tuple[str, str, int]]:
    """(entity, term, hash of the surroundings) for each word near an entity; a word counts once for an entity."""
    seen = set()
    for (_, kind, _, value), (a, b) in zip(spans, touched, strict=True):
        near = [i for i in (*range(max(0, a - size), a), *range(b + 1, min(len(words), b + 1 + size))) if words[i][0]]
        around = xxhash.xxh64_intdigest(" ".join(words[i][0] for i in near)) - (1 << 63)
        entity = f"{KINDS[kind]}:{value}"
        for i in near:
            if (entity, i) not in seen:
                seen.add((entity, i))
                yield entity, words[i][0], around


_SCAN = "kind int, doc_id long, h long, entity string, term string, shape string, around long, n long, spans array<string>, places array<int>"
_BASE, _NEAR, _AT, _COUNT = range(4)


def _counts(raw: Counter) -> Iterator[tuple]:
    """Rows of the words counted, as terms and as shapes."""
    terms: Counter = Counter()
    shapes: Counter = Counter()
    for word, n in raw.items():
        name = term(word.decode("utf-8", "replace"))[0]
        if name:
            terms[name] += n
            shapes[shape(name)] += n
    for name, n in terms.items():
        yield _COUNT, None, None, None, name, None, None, n, None, None
    for name, n in shapes.items():
        yield _COUNT, None, None, None, None, name, None, n, None, None


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One table of four kinds of rows: spans of each row, terms near entities, places of these terms, counts of all words."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(docs.sparkSession)
    out = to_arrow_schema(_parse_datatype_string(_SCAN))

    def rows(key: int | None, h: int, text: str, raw: bytes, counted: Counter) -> Iterator[tuple]:
        spans = base_spans(text)
        yield _BASE, key, h, None, None, None, None, None, [f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans], None
        if not spans:
            counted.update(raw.split())
            return
        words, touched = places(text, spans)
        counted.update(name.encode() for name, _, _ in words if name)
        near = set()
        for entity, name, around in windows(spans, words, touched):
            near.add(name)
            yield _NEAR, key, h, entity, name, shape(name), around, 1, None, None
        at: dict[str, list[int]] = {}
        for name, s, e in words:
            if name in near:
                at.setdefault(name, []).extend((s, e))
        for name, where in at.items():
            yield _AT, key, h, None, name, None, None, None, None, where

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter = Counter()
        held: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), out, strict=True)], schema=out)
            held.clear()
            return batch

        for batch in batches:
            ids, hashes, texts = batch.columns
            texts = texts.cast(pa.large_binary())
            for at in range(batch.num_rows):
                raw = texts[at].as_py() or b""
                held += rows(ids[at].as_py(), hashes[at].as_py(), raw.decode("utf-8", "replace"), raw, counted)
                if len(counted) > _MOST_WORDS:
                    held += _counts(counted)
                    counted.clear()
                if len(held) > _SLICE * 16:
                    yield flushed()
        held += _counts(counted)
        if held:
            yield flushed()

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return written(cols.mapInArrow(run, _SCAN), "personal")


def _share(n_ct: str, n_t: str) -> Column:
    """PMI(c; t) / IC(c), which is 1 + log2 p(c | t) / IC(c)."""
    return 1 + F.log2(F.col(n_ct) / F.col(n_t)) / F.log2(F.col("n_all") / F.col("n_c"))


def disclosing(scan: DataFrame, most: float = MOST_DISCLOSED, contexts: int = LEAST_CONTEXTS) -> DataFrame:
    """(entity, term, share, removed) of the terms that disclose an entity, from the rows of ``_scanned``."""
    near = scan.where(F.col("kind") == _NEAR).groupBy("entity", "term", "shape", "around").agg(F.sum("n").alias("n"))
    pairs = written(near.groupBy("entity", "term", "shape").agg(F.sum("n").alias("n_ct"), F.count("*").alias("contexts")), "pairs")
    counts = lambda key, n: scan.where((F.col("kind") == _COUNT) & F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{key}")).agg(F.sum("n").alias(n))
    of_entity = pairs.groupBy(F.col("entity").alias("_entity")).agg(F.sum("n_ct").alias("n_c"))
    n_all = scan.where((F.col("kind") == _COUNT) & F.col("term").isNotNull()).agg(F.sum("n").alias("n_all"))
    can = pairs.where(F.col("contexts") >= contexts).join(of_entity, F.col("entity") == F.col("_entity")).drop("_entity")
    can = can.join(counts("term", "n_t"), F.col("term") == F.col("_term")).drop("_term").crossJoin(F.broadcast(n_all))  # one row
    can = written(can.where(F.col("n_c") < F.col("n_all")).withColumn("share", _share("n_ct", "n_t")).where(F.col("share") >= most), "disclosing")
    # What the shape alone would tell of the entity.
    some = can.select(F.col("entity").alias("_entity"), F.col("shape").alias("_shape")).distinct()
    shapes = pairs.join(some, (F.col("entity") == F.col("_entity")) & (F.col("shape") == F.col("_shape")), "left_semi").groupBy(F.col("entity").alias("_entity"), F.col("shape").alias("_of")).agg(F.sum("n_ct").alias("n_cg"))
    shapes = shapes.join(counts("shape", "n_g"), F.col("_of") == F.col("_shape")).drop("_shape")
    both = can.join(shapes, (F.col("entity") == F.col("_entity")) & (F.col("shape") == F.col("_of")))
    return both.select("entity", "term", "share", (_share("n_cg", "n_g") >= most).alias("removed"))


def _spans(docs: DataFrame, id_col: str, text_col: str, most: float, contexts: int) -> DataFrame:
    """(doc_id, h, base, more): spans of each row, ``more`` as (start, end, removed) of its sanitised terms."""
    scan = _scanned(docs, id_col, text_col)
    found = written(disclosing(scan, most, contexts), "terms").select(F.col("entity").alias("_entity"), F.col("term").alias("_term"), "removed")
    near = scan.where(F.col("kind") == _NEAR).select("doc_id", "h", "entity", "term").distinct()
    named = near.join(found, (F.col("entity") == F.col("_entity")) & (F.col("term") == F.col("_term")))
    named = named.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "_term").agg(F.max("removed").alias("removed"))
    at = scan.where(F.col("kind") == _AT).select("doc_id", "h", "term", "places").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    each = at.join(named, same & (F.col("term") == F.col("_term")))
    pair = lambda i: F.struct(F.col("places")[2 * i].alias("start"), F.col("places")[2 * i + 1].alias("end"), F.col("removed").alias("removed"))
    each = each.select("_id", "_h", F.explode(F.transform(F.sequence(F.lit(0), (F.size("places") / 2).cast("int") - 1), pair)).alias("x"))
    more = each.groupBy("_id", "_h").agg(F.sort_array(F.collect_list("x")).alias("more"))
    base = scan.where(F.col("kind") == _BASE).select("doc_id", "h", F.col("spans").alias("base"))
    # Only rows with entities can have more.
    with_more = base.where(F.size("base") > 0).join(more, same, "left").select("doc_id", "h", "base", "more")
    return base.where(F.size("base") == 0).withColumn("more", F.lit(None).cast(more.schema["more"].dataType)).unionByName(with_more)


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: float = MOST_DISCLOSED, contexts: int = LEAST_CONTEXTS) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row.

    Spans are kind:start:end in code points, end exclusive, by start and then
    kind (base kinds as listed, then general and removed terms), comma-joined.
    A term's span is at every place it has in a document that names the entity
    within ``WINDOW`` words of one of them; words that touch base spans are no terms.

    Nulls: a null text is an empty one; null ids stay. Repeated rows come back
    each and count as often (but are one surrounding). Empty texts have no
    spans; an empty table gives an empty result. Other columns are ignored,
    whatever their names. Ties at the threshold disclose.
    """
    rows = _spans(docs, id_col, text_col, most, contexts)
    of = lambda k: F.size(F.filter("base", lambda x: x.startswith(f"{k}:"))).cast("long").alias(f"n_{k}")
    kind = {k: n for n, k in enumerate((*KINDS, GENERAL, REMOVED))}
    numbered = F.transform("base", lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("s"), F.element_at(F.create_map(*(F.lit(v) for p in kind.items() for v in p)), F.split(x, ":")[0]).alias("k"), x.alias("x")))
    name = lambda x: F.when(x["removed"], F.lit(REMOVED)).otherwise(F.lit(GENERAL))
    added = F.transform(F.coalesce("more", F.array()), lambda x: F.struct(x["start"].alias("s"), F.when(x["removed"], kind[REMOVED]).otherwise(kind[GENERAL]).alias("k"), F.concat_ws(":", name(x), x["start"], x["end"]).alias("x")))
    every = F.when(F.col("more").isNull(), F.array_join("base", ",")).otherwise(F.array_join(F.transform(F.sort_array(F.concat(numbered, added)), lambda x: x["x"]), ","))
    return rows.select("doc_id", *map(of, KINDS), F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"), every.alias("spans"))


def sanitise(text: str, base: list[str], more: list[tuple[int, int, bool]]) -> str:
    """``text`` with base spans as [KIND], general terms as their [shape], removed ones as []; of spans that overlap the first one stands."""
    parts = [(int(s), int(e), f"[{k.upper()}]") for k, s, e in (x.split(":") for x in base)]
    parts += [(s, e, "[]" if removed else f"[{shape(text[s:e].lower())}]") for s, e, removed in more]
    out, at = [], 0
    for s, e, instead in sorted(parts):
        if s >= at:
            out += [text[at:s], instead]
        at = max(at, e)
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: float = MOST_DISCLOSED, contexts: int = LEAST_CONTEXTS) -> DataFrame:
    """``docs``, same columns and rows, with sanitised texts; null texts stay null."""
    spans = _spans(docs, id_col, text_col, most, contexts).where(F.size("base") > 0).distinct()
    names = {c: free_name(docs, f"_pii_{c}") for c in ("doc_id", "h", "base", "more")}
    spans = spans.select(*(F.col(c).alias(n) for c, n in names.items()))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(names["doc_id"])) & (F.xxhash64(text_col) == F.col(names["h"]))
    joined = docs.join(spans, same, "left").drop(names["doc_id"], names["h"])
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, base, more = batch.columns
            texts = [
                t if b is None else sanitise(t, b, [(x["start"], x["end"], x["removed"]) for x in m or []])
                for t, b, m in zip(columns[at].to_pylist(), base.to_pylist(), more.to_pylist(), strict=True)
            ]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    ship(docs.sparkSession)
    return joined.mapInArrow(run, schema)


def op11_personal(spark, sf_dir: str) -> DataFrame:
    return found(spark.read.parquet(f"{sf_dir}/documents.parquet"))
