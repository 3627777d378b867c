"""Byte-level BPE by overlapping chunks.

A text longer than a chunk is cut into chunks that overlap. Each is split into
pre-tokens on its own, from wherever it happens to begin; past the first
boundary that a chunk shares with the one before, both go on alike, as the
pattern never looks back. Chunks are stitched there, the pieces between are
encoded by the merges alone, and their ids are joined. Where an overlap has no
common boundary (one pre-token longer than the overlap), the earlier chunk is
carried on to the next boundary that fits, so the result is always that of the
whole text. Decoding joins raw bytes, never decoded pieces.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm.shared import map_arrow

CHUNK, OVERLAP = 1 << 12, 1 << 8
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(f"ranks-{len(ranks)}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _boundaries(split: regex.Pattern, text: str, start: int, stop: int) -> list[int]:
    """Ends of the pre-tokens of text[start:stop]; near ``stop`` they may not be those of the whole text."""
    return [m.end() for m in split.finditer(text, start, stop)]


def _safe(text: str, at: int) -> bool:
    """A boundary at which the left piece ends alike however the text goes on: not after white space."""
    return not text[at - 1].isspace()


def pieces(text: str, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """``text`` cut at pre-token boundaries into pieces of about a chunk; each splits by itself as it does in the text."""
    if len(text) <= chunk:
        return [text]
    split = regex.compile(pattern)
    cuts, at = [0], 0
    own = _boundaries(split, text, 0, min(chunk + overlap, len(text)))
    while at + chunk < len(text):
        begin = at + chunk
        following = _boundaries(split, text, begin, min(begin + chunk + overlap, len(text)))
        shared = set(following)
        # The last pre-token before the end of what a chunk has seen may be cut short.
        seen = own[: bisect_left(own, min(begin + overlap, len(text)))]
        cut = next((b for b in seen[bisect_left(seen, begin) :] if b in shared and b > cuts[-1] and _safe(text, b)), None)
        if cut is None:
            cut = _carry_on(split, text, cuts[-1], begin)
            if cut is None:
                break
            following = _boundaries(split, text, cut, min(max(begin, cut) + chunk + overlap, len(text)))
        cuts.append(cut)
        own = [b for b in following if b > cut]
        at = max(begin, cut) if cut > begin + overlap else begin
    cuts.append(len(text))
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _carry_on(split: regex.Pattern, text: str, start: int, least: int) -> int | None:
    """The first safe boundary from ``least`` on, split from ``start``, a true boundary."""
    return next((m.end() for m in split.finditer(text, start) if m.end() >= least and m.end() < len(text) and _safe(text, m.end())), None)


def encode(text: str, enc: tiktoken.Encoding, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    out: list[int] = []
    for piece in pieces(text, pattern, chunk, overlap):
        out += enc.encode_ordinary(piece)
    return out


def decode(ids: list[int], enc: tiktoken.Encoding, at_once: int = CHUNK) -> Iterator[bytes]:
    """Raw bytes of runs of ids; characters may be split between them."""
    for at in range(0, len(ids), at_once):
        yield enc.decode_bytes(ids[at : at + at_once])


def _per_text(docs: DataFrame, schema: str, row: Callable, id_col: str, text_col: str, path: str, pattern: str) -> DataFrame:
    def rows(columns):
        enc = encoding(path, pattern)
        for key, raw in zip(*columns, strict=True):
            yield row(key, encode((raw or b"").decode("utf-8", "replace"), enc, pattern), enc)

    return map_arrow(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), ["_id", "_text"], schema, rows)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids) for each row; a null text is an empty one.

    Repeated rows are encoded each; an empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    return _per_text(docs, "doc_id long, ids array<int>", lambda key, ids, enc: (key, ids), id_col, text_col, path, pattern)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row, the last over the bytes that the ids decode to."""

    def row(key, ids, enc):
        bytes_ = hashlib.sha256()
        for part in decode(ids, enc):
            bytes_.update(part)
        return key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), bytes_.hexdigest()

    return _per_text(docs, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row, id_col, text_col, path, pattern)


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
