"""Near copies by Golay-code fuzzy hashing and the exact Jaccard similarity of word shingles.

Two texts are linked if the sets of their five-word shingles have a Jaccard
similarity of ``LEAST`` or more. Keys propose pairs, the sets decide. The keys
are those of ``simhash``: the SimHash of a set, cut into segments, an exact one
with the Golay codewords near the next. They hold all pairs within two bits;
most pairs at the bound are further apart, so MinHash bands are further keys
beside them: of pairs at the bound itself 1 - (1 - 0.8^5)^20 = 0.9996 share a
band, of more similar pairs more.

Texts of the same set are one from the start. Each set has a sketch of parities,
wide in proportion to it: the bits in which two sketches differ are a lower bound
of the sets' difference, so pairs whose sketches differ too much are out without
a look at the sets, at any size, unless they are close to the bound. In each
key's bucket all sets are first compared with the most central one, the one that
shares keys with most others, then those still in other components with the
next few. What this leaves in different components is compared by sketches, in
blocks of bounded size: a bucket's blocks meet two by two in tasks of their own,
and only pairs that the sketches can't rule out become rows. So a group of
copies of one text is never enumerated, and no bucket is cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm import simhash
from verdant.llm.shared import connected_components, drop, map_arrow, written
from verdant.shipping import ship

SEED = 42
WORDS = 5
#: Linked texts have at least this similarity, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 20, 5
#: Sets of a bucket that all others are compared with, first one and then these less one, before what is left is compared in blocks.
HUBS = 4
#: Bits of a sketch for each shingle, to the next power of two, and at least.
SKETCH, LEAST_SKETCH = 4, 1024
#: Bytes of the sketches in a block.
BLOCK = 1 << 21
_AT_ONCE = 1 << 14
_RANDOM = np.random.default_rng(SEED)
_FLIP = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_ODD = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, sorted; words are those of ``simhash.fingerprint``.

    A text of fewer words than a shingle is one shingle, one without words has none.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - WORDS + 1)
    cut = map(b" ".join, zip(*(words[k : k + n] for k in range(min(WORDS, len(words)))), strict=True))
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, cut, repeat(SEED))), np.uint64))


def band_keys(found: np.ndarray) -> list[int]:
    """A signed key for each band; none for an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), _AT_ONCE):
        np.minimum(least, ((found[at : at + _AT_ONCE, None] ^ _FLIP) * _ODD).min(axis=0), out=least)
    digests = b"".join(xxhash.xxh64_digest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS))
    return np.frombuffer(digests, np.int64).tolist()


def fingerprint(found: np.ndarray) -> int:
    """The 64-bit SimHash of a set, that of ``simhash.fingerprint`` where no shingle is repeated."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), _AT_ONCE):
        ones += np.unpackbits(found[at : at + _AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(found)).tobytes(), "big")


def fuzzy_keys(sets: list[np.ndarray]) -> list[list[int]]:
    """The Golay-code keys of each set's SimHash; none for an empty set."""
    out: list[list[int]] = [[] for _ in sets]
    row, key, _ = simhash.segment_keys(np.array([fingerprint(found) for found in sets], np.uint64))
    for k, x in zip(row.tolist(), key.tolist(), strict=True):
        if len(sets[k]):
            out[k].append(x)
    return out


def sketch(found: np.ndarray) -> np.ndarray:
    """Parity bits of the number of shingles that fall on each place, as words; every bit that differs between two sets needs a shingle that only one has."""
    bits = max(LEAST_SKETCH, 1 << (SKETCH * len(found) - 1).bit_length()) if len(found) else LEAST_SKETCH
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Sketches (in the last axis) at a smaller width: places that fall together add their parities."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def close(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether sketches (in the last axis) of sets of ``n`` shingles together can be those of alike sets."""
    words = min(a.shape[-1], b.shape[-1])
    differing = np.bitwise_count(folded(a, words) ^ folded(b, words)).sum(axis=-1, dtype=np.int64)
    return (LEAST[0] + LEAST[1]) * differing <= (LEAST[1] - LEAST[0]) * n


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have the least similarity."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * LEAST[1] >= LEAST[0] * (len(a) + len(b) - common)


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, fp, n, bits, keys) for every row; fp stands for the text's set of n shingles."""

    def rows(columns):
        ids, hashes, texts = columns
        sets = [shingles(text) for text in texts]
        for key, hashed, found, fuzzy in zip(ids, hashes, sets, fuzzy_keys(sets), strict=True):
            yield key, hashed, int.from_bytes(xxhash.xxh64_digest(found.tobytes()), "big", signed=True), len(found), sketch(found).tobytes(), fuzzy + band_keys(found)

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return map_arrow(cols, ["doc_id", "text_hash", "text"], "doc_id long, text_hash long, fp long, n long, bits binary, keys array<long>", rows)


def _hashed(texts: DataFrame) -> DataFrame:
    """(fp, s) of (fp, text): the sets themselves, as bytes of their sorted hashes."""
    return map_arrow(texts, ["fp", "text"], "fp long, s binary", lambda columns: ((fp, shingles(text).tobytes()) for fp, text in zip(*columns, strict=True)))


def _pairs_of(pairs: DataFrame, sides: DataFrame, columns: list[str], good) -> DataFrame:
    """The (u, v) of ``pairs`` for which ``good`` holds of the two rows of ``sides`` (by fp)."""
    side = lambda k: sides.select(F.col("fp").alias(k), *[F.col(c).alias(f"_{k}_{c}") for c in columns])
    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", *[f"_{k}_{c}" for k in "uv" for c in columns])
    rows = lambda cols: ((u, v) for u, v, *x in zip(*cols, strict=True) if good(*x))
    return map_arrow(both, both.columns, "u long, v long", rows)


def _can_be(n_u: int, bits_u: bytes, n_v: int, bits_v: bytes) -> bool:
    sized = LEAST[1] * min(n_u, n_v) >= LEAST[0] * max(n_u, n_v)
    return sized and bool(close(np.frombuffer(bits_u, np.uint64), np.frombuffer(bits_v, np.uint64), n_u + n_v))


def _verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The (u, v) of ``pairs`` that are alike, written: what the sketches leave is decided by the sets."""
    left = written(_pairs_of(pairs, sketches, ["n", "bits"], _can_be), f"{name}-left")
    out = written(_pairs_of(left, sets, ["s"], lambda a, b: alike(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64))), name)
    drop(left)
    return out


_BLOCK = "key long, i int, j int, first boolean, fp long, label long, n long, bits binary"


def _in_blocks(open_: DataFrame, sketches: DataFrame, block: int) -> DataFrame:
    """Pairs (u, v) of each bucket, of different labels, that the sketches can't rule out.

    A bucket of more than ``block`` bytes is dealt into blocks by the sets'
    hashes; each two of them, and each with itself, are compared in one place.
    """
    sized = open_.select("key", "fp", "label").join(sketches.withColumnRenamed("fp", "_fp"), F.col("fp") == F.col("_fp")).drop("_fp")
    blocks = sized.groupBy(F.col("key").alias("_key")).agg(F.ceil(F.sum(F.octet_length("bits").cast("long")) / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    dealt = sized.join(blocks, F.col("key") == F.col("_key")).withColumn("own", own).withColumn("_m", F.explode(meet))
    dealt = dealt.select("key", F.col("_m")["i"].alias("i"), F.col("_m")["j"].alias("j"), (F.col("own") == F.col("_m")["i"]).alias("first"), "fp", "label", "n", "bits")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), group in groupby(rows(batches), key=lambda r: r[:3]):
            held = [r[3:] for r in group]
            left = _by_width([r[1:] for r in held if r[0]])
            right = left if i == j else _by_width([r[1:] for r in held if not r[0]])
            for a in left:
                for b in right:
                    if max(a[3].shape[1], b[3].shape[1]) <= 2 * min(a[3].shape[1], b[3].shape[1]):  # else the sizes are too far apart
                        for u, v in _open_pairs(a, b):
                            keep = u > v if i == j else u != v
                            high, low = np.maximum(u, v)[keep], np.minimum(u, v)[keep]
                            if len(high):
                                yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(low)], names=["u", "v"])

    ship(open_.sparkSession)
    placed = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "first")
    return placed.mapInArrow(run, "u long, v long").distinct()


def _by_width(rows: list[tuple]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(fp, label, n, bits) as arrays, one for each width of sketches."""
    out = []
    for _, same in groupby(sorted(rows, key=lambda r: len(r[3])), key=lambda r: len(r[3])):
        fp, label, n, bits = zip(*same, strict=True)
        out.append((np.array(fp, np.int64), np.array(label, np.int64), np.array(n, np.int64), np.frombuffer(b"".join(bits), np.uint64).reshape(len(fp), -1)))
    return out


def _open_pairs(a: tuple, b: tuple, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of two lists of sets that may be alike and have different labels; ``most`` words are compared at once."""
    words = min(a[3].shape[1], b[3].shape[1])
    bits_a, bits_b = folded(a[3], words), folded(b[3], words)
    step = max(1, most // (words * len(b[0])))
    for at in range(0, len(a[0]), step):
        fp, label, n = (x[at : at + step, None] for x in a[:3])
        open_ = (label != b[1]) & (LEAST[1] * np.minimum(n, b[2]) >= LEAST[0] * np.maximum(n, b[2]))
        i, j = np.nonzero(open_ & close(bits_a[at : at + step, None, :], bits_b[None, :, :], n + b[2]))
        if len(i):
            yield fp[i, 0], b[0][j]


def links(distinct: DataFrame, docs: DataFrame, text_col: str, hubs: int = HUBS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) whose components are those of "alike" over the pairs that share a key; ``distinct`` is (fp, text_hash, n, bits, keys)."""
    keys = distinct.select("fp", "text_hash", F.explode("keys").alias("key"))
    size = keys.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("size")).where("size > 1")
    keys = written(keys.join(size, F.col("key") == F.col("_key")).drop("_key"), "keys")
    # A set that shares many keys is close to many: an original closer to its copies than they are to each other.
    central = keys.groupBy(F.col("fp").alias("_fp")).agg(F.struct(F.sum("size").alias("shares"), F.col("_fp").alias("fp")).alias("central"))
    some = keys.select("fp", "text_hash").distinct()
    full = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).join(some.select("text_hash"), "text_hash", "left_semi").dropDuplicates(["text_hash"])
    sets = written(_hashed(full.join(some, "text_hash").select("fp", "text")), "shingles")
    sketches = distinct.select("fp", "n", "bits")
    open_ = written(keys.join(central, F.col("fp") == F.col("_fp")).select("key", "fp", "central", F.col("fp").alias("label")), "open")
    drop(keys)
    edges = None
    for n in (1, hubs - 1):
        found, rest = [], open_
        for _ in range(n):  # a hub has been compared with all of its bucket
            hub = rest.groupBy(F.col("key").alias("_key")).agg(F.max("central").alias("hub"), F.max_by("label", "central").alias("of"))
            met = written(rest.join(hub, F.col("key") == F.col("_key")), "met")
            found.append(met.where("label <> of").select(F.col("fp").alias("u"), F.col("hub")["fp"].alias("v")))
            rest = met.where(F.col("fp") != F.col("hub")["fp"]).select(*open_.columns)
        pairs = written(reduce(DataFrame.unionByName, found).distinct(), "pairs")
        if not pairs.head(1):
            break
        stars = _verified(pairs, sketches, sets, "stars")
        edges = stars if edges is None else edges.unionByName(stars)
        labels = written(connected_components(edges).select("node", F.col("label").alias("now")).distinct(), "labels")
        rest = written(rest.join(labels, F.col("fp") == F.col("node"), "left").select("key", "fp", "central", F.coalesce("now", "fp").alias("label")), "rest")
        # Buckets of one component are done.
        several = rest.groupBy(F.col("key").alias("_key")).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("_key")
        left = written(rest.join(several, F.col("key") == F.col("_key"), "left_semi"), "open")
        drop(open_, pairs, rest, labels)
        open_ = left
    # Both ends' buckets are open as long as their labels differ, but for a bucket whose hub one of them was; they have been compared there.
    pairs = written(_in_blocks(open_, sketches, block), "pairs")
    last = _verified(pairs, sketches, sets, "last")
    drop(open_, pairs, sets)
    return last if edges is None else edges.unionByName(last)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id), one row for each input row.

    Rows of alike texts are linked; component_id is the least doc_id
    reachable, the row's own included.

    Nulls: a null text is one without words, and those are alike; null ids
    never become a component_id unless no row of the component has an id.
    Repeated rows come back as often as they came. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    sets = written(_sets(docs, id_col, text_col), "sets")
    distinct = written(sets.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.min_by(F.struct("text_hash", "n", "bits", "keys"), "text_hash").alias("_s")).select("fp", "least_id", "_s.*"), "distinct")
    labels = written(connected_components(links(distinct, docs, text_col)).distinct(), "labels")
    linked = distinct.join(labels, distinct.fp == labels.node).select("fp", "label", "least_id")
    best = linked.groupBy("label").agg(F.min("least_id").alias("component_id"))
    linked = linked.join(best, "label").select("fp", "component_id")
    of = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"))
    return sets.select("doc_id", "fp").join(of, "fp").select("doc_id", "component_id")
