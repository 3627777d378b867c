"""Removal of repeated byte strings, by interval expansion on Burrows-Wheeler transforms.

A byte goes if a ``LEAST``-byte string that covers it also starts earlier, in a
document of smaller id or the same document.

Every window of ``LEAST`` bytes has an anchor: its ``GRAM``-byte string of the
least hash, the leftmost of equals. Equal windows have equal anchors at equal
offsets. The windows of one anchor are a contiguous stretch, its context.
Anchors that occur once are dropped after a count with map-side combine; of
equal contexts all but the earliest are repeats as they stand. What is left,
distinct contexts that share an anchor, is dealt by anchor into blocks of
bounded size. For each block the Burrows-Wheeler transform is expanded breadth
first: from the intervals of strings of one length, backward extension makes
those of the next, and each interval whose right end is new sets a boundary
between suffixes of that common prefix length. At ``LEAST`` it stops; suffixes
with no boundary between them share ``LEAST`` bytes.

Contexts of an anchor that don't fit into one block are cut by the places of
their windows around the anchor. All windows of a range of places have the
bytes around the anchor in common that the outermost two share, so these bytes
are the key of a smaller group. Parts that no other part equals in its key are
done, equal parts are repeats of the earliest, and groups that still don't fit
are cut again; at a range of one place the key is the whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm.shared import drop, written
from verdant.shipping import ship

LEAST, GRAM = 100, 32
SPAN = LEAST - GRAM + 1
#: Bytes hashed at once, windows of a long text cut there; below 2**20.
CHUNK = 1 << 19
#: Bytes of a block; contexts of an anchor that have more are cut into so many ranges of places at once.
BLOCK, CUTS = 1 << 20, 4
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(0xFFFFF)


def _grams(data: bytes) -> np.ndarray:
    """A hash of each ``GRAM``-byte string."""
    n = len(data) - GRAM + 1
    word = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        h ^= word[k : k + n] * _MIX[k // 8 % 2]
        h *= _MIX[0]
        h ^= h >> np.uint64(29)
    h *= _MIX[1]
    h ^= h >> np.uint64(32)
    return h


def anchors(data: bytes, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, windows) of the stretches of windows within ``bounds``, runs of windows in ``data``.

    ``data`` is below 2**20 bytes; a bound (a, b) has the windows that start from a to b - 1.
    """
    h = _grams(data)
    n = len(h)
    low = (h & ~_LOW) | np.arange(n, dtype=np.uint64)
    least, width = low, 1
    while 2 * width <= SPAN:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[: n - SPAN + 1], least[SPAN - width :])
    whole = np.zeros(len(least) + 1, bool)
    begins = np.zeros(len(least) + 1, bool)
    for a, b in bounds:
        whole[a:b], begins[a] = True, True
    start = np.flatnonzero(whole[:-1] & (begins[:-1] | np.concatenate(([True], least[1:] != least[:-1]))))
    ends = np.concatenate((start[1:], [len(least)]))
    for a, b in bounds:  # a stretch ends with its run
        k = np.searchsorted(start, b) - 1
        ends[k] = min(ends[k], b)
    return h[(least[start] & _LOW).astype(np.int64)].view(np.int64), start, ends - start


def gram_place(context: bytes) -> int:
    """Where a context's anchor is in it."""
    h = _grams(context[: LEAST])
    return int(np.argmin((h & ~_LOW) | np.arange(len(h), dtype=np.uint64)))


def _runs(texts: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int]], np.ndarray, np.ndarray]]:
    """(bytes, bounds, text of each bound, its first byte's place in that text, less its place here), about ``CHUNK`` bytes at once."""
    run: list[tuple[int, int, bytes]] = []
    held = 0

    def flush():
        bounds, at = [], 0
        for _, _, d in run:
            bounds.append((at, at + len(d) - LEAST + 1))
            at += len(d)
        shift = [first - a for (_, first, _), (a, _) in zip(run, bounds, strict=True)]
        return b"".join(d for _, _, d in run), bounds, np.array([k for k, _, _ in run]), np.array(shift)

    for k, text in enumerate(texts):
        for first in range(0, len(text) - LEAST + 1, CHUNK):
            part = text[first : first + CHUNK + LEAST - 1]
            if held + len(part) > CHUNK + LEAST and run:
                yield flush()
                run, held = [], 0
            run.append((k, first, part))
            held += len(part)
    if run:
        yield flush()


def stretches(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (text, anchor hash, context hash, first window, windows) of the stretches of whole texts."""
    for data, bounds, whose, shift in _runs(texts):
        hashes, starts, counts = anchors(data, bounds)
        of = np.searchsorted([a for a, _ in bounds], starts, side="right") - 1
        digests = [xxhash.xxh64_digest(data[a:b]) for a, b in zip(starts.tolist(), (starts + counts + LEAST - 1).tolist(), strict=True)]
        yield whose[of], hashes, np.frombuffer(b"".join(digests), ">i8").astype(np.int64), starts + shift[of], counts


def rotations(text: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the text's rotations by ``least`` bytes at least, equal ones by place; each one's rank; its first 8 bytes."""
    n = len(text)
    twice = np.concatenate((text, np.resize(text, 8)))
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | twice[k : k + n]
    order = np.argsort(words, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], words[order][1:] != words[order][:-1])))
    length = 8
    while length < least:
        key = (rank << 32) | rank[(np.arange(n) + length) % n]
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank[order] = np.cumsum(np.concatenate(([0], sorted_[1:] != sorted_[:-1])))
        length *= 2
    return order, _inverse(order), words


def _inverse(order: np.ndarray) -> np.ndarray:
    out = np.empty_like(order)
    out[order] = np.arange(len(order))
    return out


def boundaries(text: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(ranks, boundary): rotations of neighbouring ranks share ``least`` bytes if no boundary is between them.

    ``boundary[k]`` is before rank k. Common prefixes of up to seven bytes are
    read off machine words; from there on intervals are expanded level by level.
    """
    n = len(text)
    order, rank, words = rotations(text, least)
    boundary = np.zeros(n + 1, bool)
    boundary[0] = boundary[n] = True
    if n == 1:
        return rank, boundary
    last = rank[(order - 1) % n]  # backward step of each rank
    first_byte = text[order]
    differ = words[order][1:] ^ words[order][:-1]
    ends = np.flatnonzero(differ) + 1
    boundary[ends] = True
    # Intervals of 8-byte strings whose right end has a common prefix of just seven bytes.
    seven = ends[differ[ends - 1] < 256]
    all_ends = np.flatnonzero(boundary)
    left = all_ends[np.searchsorted(all_ends, seven) - 1]
    right = seven
    parent = np.empty(n, np.int64)
    for _ in range(8, least):
        if not len(left):
            break
        sizes = right - left
        whose = np.repeat(np.arange(len(left)), sizes)
        inside = np.arange(len(whose)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(left, sizes)
        stepped = last[inside]
        parent[stepped] = whose
        stepped = np.sort(stepped)
        own, char = parent[stepped], first_byte[stepped]
        cut = np.flatnonzero((stepped[1:] != stepped[:-1] + 1) | (own[1:] != own[:-1]) | (char[1:] != char[:-1]))
        left = stepped[np.concatenate(([0], cut + 1))]
        right = stepped[np.concatenate((cut, [len(stepped) - 1]))] + 1
        new = ~boundary[right]
        left, right = left[new], right[new]
        boundary[right] = True
    return rank, boundary


def earlier_windows(contexts: list[bytes], places: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Per context, the runs (first, last) of its windows that an earlier one equals.

    ``places`` has each context's (document, start); a window is earlier if its
    (document, start) is less. All contexts go into one transform.
    """
    text = np.frombuffer(b"".join(contexts), np.uint8)
    rank, boundary = boundaries(text)
    group = np.cumsum(boundary[:-1])
    sizes = np.array([len(c) - LEAST + 1 for c in contexts])
    begins = np.cumsum([0] + [len(c) for c in contexts[:-1]])
    of = np.repeat(np.arange(len(contexts)), sizes)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    window_group = group[rank[begins[of] + offset]]
    docs = np.unique([d for d, _ in places], return_inverse=True)[1].astype(np.int64)
    starts = np.array([s for _, s in places], np.int64)[of] + offset
    by = np.lexsort((starts, docs[of], window_group))
    first = np.concatenate(([True], window_group[by][1:] != window_group[by][:-1]))
    least = by[np.flatnonzero(first)][np.cumsum(first) - 1]
    late = np.zeros(len(of), bool)
    late[by] = (docs[of[by]] != docs[of[least]]) | (starts[by] != starts[least])
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    hit = np.flatnonzero(late)
    if len(hit):
        cut = np.flatnonzero((hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]]))
        for a, b in zip(hit[np.concatenate(([0], cut + 1))], hit[np.concatenate((cut, [len(hit) - 1]))], strict=True):
            out[of[a]].append((int(offset[a]), int(offset[b])))
    return out


def _lists(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[list[list]]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            yield [(c.cast(pa.binary()) if pa.types.is_string(c.type) else c).to_pylist() for c in part.columns]


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _anchor_counts(docs: DataFrame) -> DataFrame:
    """(anchor, n): the anchors of all texts, summed up for each slice of rows."""

    def run(batches):
        for (texts,) in _lists(batches, 256):
            found = [anchors(data, bounds)[0] for data, bounds, _, _ in _runs([t or b"" for t in texts])]
            if found:
                anchor, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], names=["anchor", "n"])

    return docs.select("text").mapInArrow(run, "anchor long, n long")


def _occurrences(docs: DataFrame) -> DataFrame:
    """(anchor, context, doc_id, row, start, windows) of (doc_id, row, text)."""
    names = ["anchor", "context", "doc_id", "row", "start", "windows"]

    def run(batches):
        for ids, keys, texts in _lists(batches, 256):
            ids, keys = np.array(ids, np.int64), np.array(keys, np.int64)
            for of, hashes, contexts, starts, counts in stretches([t or b"" for t in texts]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (hashes, contexts, ids[of], keys[of], starts, counts.astype(np.int32))], names=names)

    return docs.mapInArrow(run, "anchor long, context long, doc_id long, row long, start long, windows int")


#: Parts of contexts: windows from ``first`` on whose places around the anchor are ``low`` to ``high``; ``key`` tells groups apart.
PARTS = "key long, low int, high int, gram int, anchor long, context long, first int, windows int, doc_id long, start long, bytes binary"
LATE = "anchor long, context long, first int, last int"


def cut_parts(part: tuple, cuts: int = CUTS) -> Iterator[tuple]:
    """A part of a context cut by ranges of places, with the range's common bytes as key. A window's place is how far it begins before the anchor."""
    _, low, high, gram, anchor, context, first, windows, doc_id, start, data = part
    step = -(-(high - low + 1) // cuts)
    for a in range(low, high + 1, step):
        b = min(a + step - 1, high)
        i, j = max(0, gram - b), min(windows - 1, gram - a)  # window i has place gram - i
        if i <= j:
            shared = data[gram - a : gram - b + LEAST]
            key = xxhash.xxh64_intdigest(shared, anchor & 0xFFFFFFFFFFFF ^ a << 48)
            yield key - (key >> 63 << 64), a, b, gram - i, anchor, context, first + i, j - i + 1, doc_id, start + i, data[i : j + LEAST]


def _cut(parts: DataFrame) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(parts.schema)

    def run(batches):
        for cols in _lists(batches, 1024):
            out = [x for row in zip(*cols, strict=True) for x in cut_parts(row if row[3] >= 0 else (*row[:3], gram_place(row[-1]), *row[4:]))]
            yield _batch(out, schema.types, schema.names)

    return parts.mapInArrow(run, PARTS)


def _compare(parts: DataFrame) -> DataFrame:
    """Runs of windows of parts that an earlier part of the same key has; ``first`` and ``last`` count in the whole context."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    names = ["anchor", "context", "first", "last"]

    def solve(block):
        runs = earlier_windows([x[6] for x in block], [(x[4], x[5]) for x in block])
        return [(x[1], x[2], x[3] + a, x[3] + b) for x, own in zip(block, runs, strict=True) for a, b in own]

    def run(batches):
        block: list[tuple] = []
        held = 0
        for cols in _lists(batches, 1024):
            for row in zip(*cols, strict=True):
                if block and row[:4] == block[-1][:4]:  # of equal rows of the input
                    continue
                if held >= BLOCK and row[0] != block[-1][0]:
                    if out := solve(block):
                        yield _batch(out, types, names)
                    block, held = [], 0
                block.append(row)
                held += len(row[6])
        if block and (out := solve(block)):
            yield _batch(out, types, names)

    order = ["key", "anchor", "context", "first"]
    return parts.select(*order, "doc_id", "start", "bytes").repartition("key").sortWithinPartitions(*order).mapInArrow(run, LATE)


def _late(parts: DataFrame, block: int) -> DataFrame:
    """(anchor, context, first, last): runs of windows of distinct contexts that an earlier one has. Drops ``parts``, a written table."""
    found = None
    while True:
        size = F.sum((F.col("windows") + LEAST - 1).cast("long"))
        large = written(parts.groupBy("key", "low", "high").agg(size.alias("size")).where((F.col("size") > block) & (F.col("low") < F.col("high"))).select("key"), "large")
        some = large.head(1)
        late = written(_compare(parts.join(large, "key", "left_anti") if some else parts), "late")
        found = late if found is None else found.unionByName(late)
        if not some:
            drop(parts, large)
            return found
        cut = written(_cut(parts.join(large, "key", "left_semi")).withColumn("digest", F.xxhash64("bytes")), "cut")
        drop(parts, large)
        least = cut.groupBy("key", "digest").agg(F.min(F.struct("doc_id", "start")).alias("least"))
        several = least.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        told = written(cut.join(least, ["key", "digest"]).withColumn("again", F.struct("doc_id", "start") > F.col("least")).drop("least", "digest"), "told")
        late = written(told.where("again").select("anchor", "context", "first", (F.col("first") + F.col("windows") - 1).alias("last")), "late")
        found = found.unionByName(late)
        parts = written(told.where("not again").drop("again").join(several, "key", "left_semi").select(*parts.columns), "parts")
        drop(cut, told)


def repeated_spans(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, row, spans) of (doc_id, row, text): arrays of (a, b), bytes that are repeated, unsorted and overlapping.

    Steps are written tables, each deleted when the last that reads it is written.
    """
    often = written(_anchor_counts(docs).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "often")
    some = written(_occurrences(docs).join(often, "anchor", "left_semi"), "occurrences")
    drop(often)
    firsts = some.groupBy("anchor", "context").agg(F.min(F.struct("doc_id", "start", "row", "windows")).alias("f"))
    firsts = written(firsts.select("anchor", "context", "f.*"), "firsts")
    shared = firsts.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1").select("anchor")
    todo = firsts.join(shared, "anchor", "left_semi")
    per_doc = todo.groupBy("doc_id", "row").agg(F.collect_list(F.struct("anchor", "context", "start", "windows")).alias("parts"))
    texts = docs.select("doc_id", "row", F.col("text").cast("binary").alias("text"))
    cut = texts.join(per_doc, ["doc_id", "row"]).select("doc_id", "text", F.explode("parts").alias("p"))
    own_bytes = F.expr(f"substring(text, cast(p.start + 1 as int), p.windows + {LEAST - 1})").alias("bytes")
    cut = cut.select(F.col("p.anchor").alias("key"), F.lit(0).alias("low"), F.lit(SPAN - 1).alias("high"), F.lit(-1).alias("gram"), "p.anchor", "p.context", F.lit(0).alias("first"), "p.windows", "doc_id", "p.start", own_bytes)
    runs = _late(written(cut, "contexts"), block)
    late = written(runs.groupBy("anchor", "context").agg(F.collect_list(F.struct("first", "last")).alias("late")), "late")
    own = firsts.select("anchor", "context", F.col("doc_id").alias("d"), F.col("start").alias("s"))
    told = some.join(own, ["anchor", "context"])
    again = told.where("doc_id > d or (doc_id = d and start > s)").select("doc_id", "row", F.col("start").alias("a"), (F.col("start") + F.col("windows") + LEAST - 1).alias("b"))
    once = told.where("doc_id = d and start = s").select("anchor", "context", "doc_id", "row", "start").join(late, ["anchor", "context"])
    once = once.select("doc_id", "row", "start", F.explode("late").alias("x")).select("doc_id", "row", (F.col("start") + F.col("x.first")).alias("a"), (F.col("start") + F.col("x.last") + LEAST).alias("b"))
    spans = written(again.unionByName(once).groupBy("doc_id", "row").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")
    drop(some, firsts, late)
    return spans


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kept(text: bytes, spans: list[tuple[int, int]]) -> Iterator[bytes]:
    """What is left of ``text`` between merged spans."""
    at = 0
    for a, b in spans:
        yield text[at:a]
        at = b
    yield text[at:]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row, over its text's UTF-8 bytes.

    Strings are judged on the input. Rows of the same id are not earlier than
    one another; equal rows lose the same bytes. A null text is empty; a null
    id is less than all others, and comes back null. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("own_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("own_id", F.coalesce("own_id", F.lit(-(2**63))).alias("doc_id"), "text").withColumn("row", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(rows.select("doc_id", "row", "text"), block)
    both = rows.select("own_id", "doc_id", "row", F.col("text").cast("binary").alias("text")).join(spans, ["doc_id", "row"], "left").select("own_id", "text", "spans")

    def run(batches):
        for ids, texts, found in _lists(batches, 256):
            out = []
            for key, text, own in zip(ids, texts, found, strict=True):
                whole = merged([(x["a"], x["b"]) for x in own or []])
                digest = hashlib.sha256()
                for part in kept(text, whole):
                    digest.update(part)
                out.append((key, len(text), sum(b - a for a, b in whole), len(whole), digest.hexdigest()))
            yield _batch(out, [pa.int64()] * 4 + [pa.string()], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return both.mapInArrow(run, RESULT)


def op8_repeats(spark, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
