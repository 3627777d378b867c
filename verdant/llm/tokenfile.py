"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents in blocks of ``BLOCK`` ids. From
a block its minimum is subtracted; what is left is packed at the width that
``PERCENTILE`` of its values need, and the values that need more are kept in
an exception list (position, value). The footer indexes the block starts, so
any id is found without reading what is before it, and lists the documents.

    file      magic, blocks, block starts (u64), documents (flag u8, id i64, ids u64), trailer
    block     minimum u32, ids u32, exceptions u32, width u8, packed bits, positions u32, values u32
    trailer   block starts' place u64, blocks u64, documents u64, ids u64, magic
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verdant.llm import files
from verdant.llm.shared import new_path, written
from verdant.shipping import ship

MAGIC = b"VDPFOR01"
BLOCK, PERCENTILE = 4096, 95
HEAD, TRAILER = struct.Struct("<IIIB"), struct.Struct("<QQQQ8s")
DOCUMENT = np.dtype([("flag", "u1"), ("id", "<i8"), ("n", "<u8")])
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1


def pack(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """One block of up to ``BLOCK`` unsigned 32-bit ids."""
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    width = int(np.partition(rest, (len(rest) - 1) * percentile // 100)[(len(rest) - 1) * percentile // 100]).bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    values = rest[over]
    rest[over] = 0
    bits = (rest[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    packed = np.packbits(bits.astype(np.uint8), axis=None).tobytes() if width else b""
    return HEAD.pack(low, len(ids), len(over), width) + packed + over.astype("<u4").tobytes() + values.astype("<u4").tobytes()


def unpack(block: bytes) -> np.ndarray:
    """The ids of a block; raises ValueError if its length doesn't fit its header."""
    low, n, over, width = HEAD.unpack_from(block)
    size = (n * width + 7) // 8
    if width > 32 or len(block) != HEAD.size + size + 8 * over:
        raise ValueError("a block's length doesn't fit its header")
    rest = np.zeros(n, np.uint32)
    if width:
        bits = np.unpackbits(np.frombuffer(block, np.uint8, size, HEAD.size), count=n * width).reshape(n, width)
        whole = np.zeros((n, 32), np.uint8)
        whole[:, :width] = bits
        rest = np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel().copy()
    at = np.frombuffer(block, "<u4", over, HEAD.size + size)
    rest[at] = np.frombuffer(block, "<u4", over, HEAD.size + size + 4 * over)
    return rest + np.uint32(low)


class Writer:
    """Writes one file to a stream; holds a block of ids and the document list."""

    def __init__(self, out, block: int = BLOCK):
        self.out, self.block, self.place, self.starts, self.total = out, block, len(MAGIC), [], 0
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.documents: list[tuple[int, int, int]] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents.append((doc_id is not None, doc_id or 0, len(ids)))
        self.total += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            every = np.concatenate(self.waiting)
            full = len(every) - len(every) % self.block
            for at in range(0, full, self.block):
                self._put(every[at : at + self.block])
            self.waiting, self.held = [every[full:]], len(every) - full

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids)
        self.starts.append(self.place)
        self.out.write(data)
        self.place += len(data)

    def close(self) -> None:
        if self.held:
            self._put(np.concatenate(self.waiting))
        self.out.write(np.array(self.starts, "<u8").tobytes())
        self.out.write(np.array(self.documents, DOCUMENT).tobytes())
        self.out.write(TRAILER.pack(self.place, len(self.starts), len(self.documents), self.total, MAGIC))


class Reader:
    """Reads a file by its index."""

    def __init__(self, f, block: int = BLOCK):
        self.f, self.block = f, block
        f.seek(0, 2)
        size = f.tell()
        if size < len(MAGIC) + TRAILER.size:
            raise ValueError("too short for a token file")
        f.seek(size - TRAILER.size)
        self.end, n, docs, self.total, magic = TRAILER.unpack(f.read(TRAILER.size))
        f.seek(0)
        if magic != MAGIC or f.read(len(MAGIC)) != MAGIC or self.end + 8 * n + DOCUMENT.itemsize * docs + TRAILER.size != size:
            raise ValueError("not a whole token file")
        f.seek(self.end)
        self.starts = np.append(np.frombuffer(f.read(8 * n), "<u8"), np.uint64(self.end)).astype(np.int64)
        self.documents = np.frombuffer(f.read(DOCUMENT.itemsize * docs), DOCUMENT)

    def ids(self, start: int, count: int) -> np.ndarray:
        """Ids [start, start + count) of the file; reads the blocks that hold them only."""
        if not 0 <= start <= start + count <= self.total:
            raise ValueError("outside the file")
        if not count:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (start + count - 1) // self.block
        self.f.seek(int(self.starts[first]))
        data = self.f.read(int(self.starts[last + 1] - self.starts[first]))
        base = self.starts[first]
        out = [unpack(data[self.starts[b] - base : self.starts[b + 1] - base]) for b in range(first, last + 1)]
        return np.concatenate(out)[start - first * self.block :][:count]

    def each(self, at_once: int = 256) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids) of all documents, read in runs of blocks."""
        start, held, held_from = 0, np.zeros(0, np.uint32), 0
        for flag, key, n in self.documents.tolist():
            if start + n > held_from + len(held):
                need = start + n - held_from - len(held)
                more = min(self.total - held_from - len(held), -(-need // (at_once * self.block)) * at_once * self.block)
                held = np.concatenate((held[start - held_from :], self.ids(held_from + len(held), more)))
                held_from = start
            yield (key if flag else None), start, held[start - held_from :][:n]
            start += n


class Encoder:
    """Ids of whole texts by a tokenizer file, word by word.

    In texts of characters up to U+00FF (and some signs), whose case, forms and
    classes are beyond doubt, pre-tokens are cut here and each distinct one is
    merged by the library's model once; all other texts go to the library whole, as do
    those with a special token's opening. Results are the library's own either way.
    """

    SPACE = r"\t-\r \x85\xa0"
    LETTER = "a-zªµºß-öø-ÿ"
    NUMBER = "0-9²³¹¼-¾"
    PLAIN = re.compile(r"[\x00-\xff‐-‧€]*")
    WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
    #: Pre-tokens whose ids are held at once.
    MOST_HELD = 200_000

    def __init__(self, path: str = WORD_BPE):
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.held = _Held(self.library.model)
        special = self.library.get_added_tokens_decoder().values()
        self.special = [str(t.content) for t in special]
        self.splits_words = _is_word_bpe(self.library)

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.splits_words or not self.PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self.held.most = self.MOST_HELD
        return b"".join(map(self.held.__getitem__, self.WORD.findall(text.lower())))


class _Held(dict):
    """Ids of words, merged when a word is first asked for; emptied when it holds ``most``."""

    def __init__(self, model):
        super().__init__()
        self.merge, self.most = model.tokenize, 0

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        got = [t.id for t in self.merge(word if word.isalpha() and word.isascii() else _as_letters(word))]
        self[word] = ids = struct.pack(f"<{len(got)}I", *got)
        return ids


@lru_cache(maxsize=1)
def _letters() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def _as_letters(word: str) -> str:
    table = _letters()
    return "".join([table[b] for b in word.encode()])


def _is_word_bpe(library: Tokenizer) -> bool:
    """Whether the file's normaliser and splitter are those that ``Encoder.WORD`` stands for."""
    import json

    spec = json.loads(library.to_str())
    steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
    pattern = split.get("pattern", {}).get("Regex")
    return steps == ["NFC", "Replace", "Lowercase"] and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and split.get("invert") is True


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


MANIFEST = "part int, path string, n_docs long, n_tokens long"


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str = WORD_BPE, end_id: int | None = END_ID) -> DataFrame:
    """Writes the ids of all texts in ascending order of ``id_col``; returns the manifest, one row per file.

    Files in order of ``part`` hold consecutive ranges of ids; null ids come
    first, equal ids in order of their texts' hashes. Rows are range-partitioned
    as AQE sizes them; a task holds one slice of texts, one block and its list of documents.
    """
    ship(docs.sparkSession)
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, writer = encoder(path), TaskContext.get().partitionId(), None
        rows = (row for b in batches for at in range(0, b.num_rows, 256) for row in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True))
        first = next(rows, None)
        if first is None:
            return
        with files.create(folder, part, ".vpf") as (name, out):
            writer = Writer(out)
            writer.add(first[0], np.frombuffer(encode(first[1] or "") + end, "<u4"))
            for key, text in rows:
                writer.add(key, np.frombuffer(encode(text or "") + end, "<u4"))
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (name, pa.string()), (len(writer.documents), pa.int64()), (writer.total, pa.int64()))], names=["part", "path", "n_docs", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    in_order = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return written(in_order.mapInArrow(run, MANIFEST), "manifest")


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    The manifest, one row per file, is summed up on the driver for the files' first ids.
    """
    ship(spark)
    parts, base = [], 0
    for r in manifest.orderBy("part").toLocalIterator():
        parts.append((r["path"], base))
        base += r["n_tokens"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with files.opened(path) as f:
                    rows = []
                    for key, start, ids in Reader(f).each():
                        rows.append((key, first + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    todo = spark.createDataFrame(parts, "path string, first long").repartition(max(1, len(parts)))
    return todo.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    """One row per document; null texts have the end id alone, repeated rows a place each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(spark, write_tokens(docs, new_path(spark, "tokens")))
