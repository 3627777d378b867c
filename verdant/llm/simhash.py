"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded
to a 23-bit word of the perfect binary Golay code. A word decodes to the
codewords within distance four of it: one if it lies within two of a codeword,
else six. Two words that differ in at most one bit share the nearest codeword
of either. With two wrong bits in three segments, one segment is free of error
and the next one or the one before it has at most one wrong bit; over the
three cyclic pairs (exact segment, fuzzy segment) each linked pair meets in a key.

Keys that more than ``hot_key`` fingerprints share are not paired up at all:
there, fingerprints link through the 65 words within one bit of them. Two
fingerprints are within two bits exactly if those balls meet, and at most 65
fingerprints meet in one word, so no group of copies is ever enumerated.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations, repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm.shared import connected_components, drop, map_arrow, written

SEED = 42
#: First bit and width of each segment, from the highest bit.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the (23, 12) Golay code: x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
#: Linked fingerprints differ in so many bits at most; the keys are made for this number.
BITS = 2
HOT_KEY = 64
_AT_ONCE = 1 << 16


def fingerprint(text: bytes | None, words_in_shingle: int = 3) -> bytes:
    """The 8 bytes of a text's SimHash; a null or wordless text has eight zero bytes.

    A-Z are lowered, words are runs of anything but ASCII white space, and a
    text of fewer words than a shingle is one shingle. Repeated shingles count
    again. Memory: 64 KiB shingles at once, however long the text.
    """
    words = (text or b"").lower().split()
    if not words:
        return bytes(8)
    n = max(1, len(words) - words_in_shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(words_in_shingle, len(words)) - 1 :][:n] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _AT_ONCE):
        cut = [joined[a:b] for a, b in zip(starts[at : at + _AT_ONCE], stops[at : at + _AT_ONCE], strict=True)]
        digests = b"".join(map(xxhash.xxh64_digest, cut, repeat(SEED)))
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long."""

    def rows(columns):
        ids, texts = columns
        fps = np.frombuffer(b"".join(fingerprint(t, words_in_shingle) for t in texts), ">i8").tolist()
        return zip(ids, fps, strict=True)

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ["doc_id", "text"], "doc_id long, fp long", rows)


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the 23 unit words, and per syndrome the error patterns of weight up to four (-1: none).

    The first pattern of a row is the one of least weight; it is unique, as the code is perfect.
    """
    unit = [_remainder(1 << bit) for bit in range(23)]
    errors: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome = pattern = 0
            for b in bits:
                syndrome, pattern = syndrome ^ unit[b], pattern | 1 << b
            if weight < 4 or not errors[syndrome] or errors[syndrome][0].bit_count() == 3:
                errors[syndrome].append(pattern)
    table = np.full((1 << 11, 6), -1, np.int64)
    for syndrome, found in enumerate(errors):
        table[syndrome, : len(found)] = found
    return np.array(unit, np.int64), table


def codewords(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within four of each 23-bit word, nearest first; -1 fills the rows."""
    unit, table = _golay()
    syndromes = np.zeros(len(words), np.int64)
    for bit in range(23):
        syndromes ^= np.where(words >> bit & 1, unit[bit], 0)
    errors = table[syndromes]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def segment_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, nearest) for unsigned fingerprints: a key for each cyclic pair and codeword."""
    parts = [((fps >> np.uint64(64 - first - width)) & np.uint64((1 << width) - 1)).astype(np.int64) for first, width in SEGMENTS]
    rows, keys, nearest = [], [], []
    for pair in range(3):
        near = codewords(parts[(pair + 1) % 3])
        row, col = np.nonzero(near >= 0)
        rows.append(row)
        keys.append((pair << 40) | (parts[pair][row] << 12) | near[row, col])
        nearest.append(col == 0)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(nearest)


def _keys(distinct: DataFrame) -> DataFrame:
    """(fp, key, nearest) of distinct fingerprints."""

    def rows(columns):
        signed = np.array(columns[0], np.int64)
        row, key, near = segment_keys(signed.view(np.uint64))
        return zip(signed[row].tolist(), key.tolist(), near.tolist(), strict=True)

    return map_arrow(distinct, ["fp"], "fp long, key long, nearest boolean", rows, 4096)


def links(distinct: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """Edges (u, v) whose components are those of "differs in at most two bits" over distinct ``fp``.

    In keys of up to ``hot_key`` fingerprints every pair is verified; in larger
    ones a spanning set of edges is returned.
    """
    keys = written(_keys(distinct), "keys")
    hot = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_key).select("key")
    hot = written(hot, "hot")
    cold = keys.join(hot, "key", "left_anti") if hot.head(1) else keys
    a = cold.where("nearest").select("key", F.col("fp").alias("a"))
    b = cold.select("key", F.col("fp").alias("b"))
    near = a.join(b, "key").where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS))
    edges = near.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    if not hot.head(1):
        return edges
    flips = F.array(*[F.lit((1 << k) - (1 << 64 if k == 63 else 0)) for k in range(64)], F.lit(0).cast("long"))
    crowded = keys.join(hot, "key", "left_semi").select("fp").distinct()
    balls = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    met = balls.groupBy("word").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    hub = met.select(F.array_min("all").alias("v"), F.explode("all").alias("u")).where("u <> v")
    return edges.unionByName(hub.select("u", "v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3, hot_key: int = HOT_KEY) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each input row.

    Rows whose fingerprints differ in at most two bits are linked;
    component_id is the least doc_id reachable, the row's own included.

    Nulls: a null text has fingerprint zero and links like any other; null ids
    never become a component_id unless no row of the component has an id.
    Repeated rows come back as often as they came. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    fps = written(fingerprints(docs, id_col, text_col, words_in_shingle), "fingerprints")
    least = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    edges = links(least.select("fp"), hot_key)
    labels = written(connected_components(edges).distinct(), "labels")
    linked = least.join(labels, least.fp == labels.node).select("fp", "label", "least_id")
    best = linked.groupBy("label").agg(F.min("least_id").alias("component_id"))
    linked = linked.join(best, "label").select("fp", "component_id")
    of = least.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"))
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
