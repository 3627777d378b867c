"""Maximal periodic runs of words, by branching tandem repeats of a suffix tree.

Words become numbers. A run repeats a 16-word window within itself, so only
stretches covered by such windows, cut down until nothing changes, go on; most
texts have none. Each stretch gets its suffix tree, held as the intervals of a
sorted suffix list. For every inner node the leaves of all children but the
largest are visited (so each leaf a logarithmic number of times): a leaf i of a
node of depth d is a tandem repeat with leaf i + d (and i - d) if both lie
under the node, a branching one if they part there. A branching repeat is the
last rotation of its kind, so the earlier rotations are found by walking left
while words d apart agree; all repeats that end in the same stretch are one run.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm.shared import map_arrow

#: A run has so many words, and so many periods, at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
_ODD = np.uint64(0x9E3779B97F4A7C15)
_AT_ONCE = 1 << 20

Run = tuple[int, int, int]


def _window(least: int, periods: int) -> int:
    """Words of a window that every run repeats within itself, one period on: a run of n words has n - n // periods words that recur."""
    return max(1, least - least // periods)


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    numbers = dict(zip(dict.fromkeys(words), count()))  # noqa: B905
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


def _stretches(ids: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """(start, end) of stretches covered by windows of ``width`` words that occur twice; hashes may add some, never lose one."""
    n = len(ids) - width + 1
    if n < 2:
        return
    hashes, have = (ids.astype(np.uint64) + np.uint64(1)) * _ODD, 1
    hashes ^= hashes >> np.uint64(29)
    while have < width:  # of the last words and the first ones of the window, which may overlap
        step = min(have, width - have)
        hashes = (hashes[: len(hashes) - step] * _ODD) ^ (hashes[step:] + (hashes[step:] >> np.uint64(31)))
        have += step
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    at = np.nonzero(again)[0]
    if len(at):
        breaks = np.nonzero(np.diff(at) > width)[0]
        yield from zip(at[np.concatenate([[0], breaks + 1])].tolist(), (at[np.concatenate([breaks, [len(at) - 1]])] + width).tolist(), strict=True)


def _suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, their ranks, words shared with the one before), by doubling."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int32)
    levels, width = [rank], 1
    order = np.argsort(rank, kind="stable")
    while rank[order[-1]] < n - 1 and width < n:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank.astype(np.int64) * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int32)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank, width = new, 2 * width
        levels.append(rank)
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level, width = levels[k], 1 << k
        inside = np.nonzero(np.maximum(a, b) + width <= n)[0]
        agree = inside[level[a[inside]] == level[b[inside]]]
        shared[1:][agree] += width
        a[agree] += width
        b[agree] += width
    return order, rank, shared


def _tree(shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix tree's inner nodes as (depth, first, last, parent) and each leaf's parent; node 0 is the root."""
    depth, first, last, parent, leaf = [0], [0], [len(shared) - 1], [-1], []
    stack = [0]
    for i, h in enumerate([*shared[1:].tolist(), 0]):  # i: the suffix before this edge
        top = stack[-1]
        if h > depth[top]:
            stack.append(len(depth))
            leaf.append(len(depth))
            depth.append(h)
            first.append(i)
            last.append(-1)
            parent.append(top)
            continue
        leaf.append(top)
        while depth[top] > h:
            stack.pop()
            last[top] = i
            under = stack[-1]
            if depth[under] < h:  # a node between the two
                parent.append(under)
                depth.append(h)
                first.append(first[top])
                last.append(-1)
                under = len(depth) - 1
                stack.append(under)
            parent[top] = under
            top = under
    return tuple(np.array(x, np.int64) for x in (depth, first, last, parent, leaf))


def _branching(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, periods) of the branching tandem repeats, in bounded blocks."""
    n = len(ids)
    order, rank, shared = _suffixes(ids)
    depth, first, last, parent, leaf = _tree(shared)
    # Children: inner nodes but the root, then leaves; of each parent's the largest is left out.
    over = np.concatenate([parent[1:], leaf])
    low = np.concatenate([first[1:], np.arange(n)])
    size = np.concatenate([last[1:] - first[1:] + 1, np.ones(n, np.int64)])
    by = np.lexsort((size, over))
    largest = by[np.concatenate([np.nonzero(np.diff(over[by]))[0], [len(by) - 1]])]
    small = np.ones(len(over), bool)
    small[largest] = False
    small &= depth[over] > 0
    over, low, size = over[small], low[small], size[small]
    ends = np.cumsum(size)
    word = np.append(ids, -1)  # no word follows the last
    at = 0
    while at < len(over):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _AT_ONCE, "right")))
        part = slice(at, upto)
        node = np.repeat(over[part], size[part])
        offset = np.arange(len(node)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        i, d = order[np.repeat(low[part], size[part]) + offset], depth[node]
        for start, other in ((i, i + d), (i - d, i - d)):
            good = (other >= 0) & (other < n) & (start + 2 * d <= n)
            s, p, v, o = start[good], d[good], node[good], other[good]
            under = (rank[o] >= first[v]) & (rank[o] <= last[v])
            s, p = s[under], p[under]
            parts = word[s] != word[s + 2 * p]
            yield s[parts], p[parts]
        at = upto


def _walk(ids: np.ndarray, start: int, period: int) -> int:
    """The least place from which words ``period`` apart agree up to ``start``; read in growing pieces."""
    step = 32
    while start > 0:
        low = max(0, start - step)
        differ = np.nonzero(ids[low:start] != ids[low + period : start + period])[0]
        if len(differ):
            return low + int(differ[-1]) + 1
        start, step = low, 2 * step
    return 0


def _runs_of(ids: np.ndarray, least: int, periods: int) -> Iterator[Run]:
    """(start, length, period) of a stretch's runs."""
    found: dict[tuple[int, int], int] = {}
    for starts, ds in _branching(ids):
        need = np.maximum(least, periods * ds) - 2 * ds  # earlier rotations that a run has
        long = starts >= need
        for k in range(1, 5):
            at = np.where(long & (need >= k), starts - k, 0)
            long &= (need < k) | (ids[at] == ids[np.minimum(at + ds, len(ids) - 1)])
        for s, d in set(zip(starts[long].tolist(), ds[long].tolist(), strict=True)):
            begin, end = _walk(ids, s, d), s + 2 * d
            if end - begin >= max(least, periods * d):
                found[begin, end] = min(d, found.get((begin, end), d))
    for (begin, end), d in found.items():
        yield begin, end - begin, d


def runs(ids: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[Run]:
    """(start, length, period) of all maximal runs of ``least`` words and ``periods`` periods or more, by start, then period."""
    out: list[Run] = []
    width = _window(least, periods)
    todo = [(0, len(ids))]
    while todo:
        low, high = todo.pop()
        parts = [(low + a, low + b) for a, b in _stretches(ids[low:high], width)]
        if parts == [(low, high)]:
            out += [(low + s, n, d) for s, n, d in _runs_of(ids[low:high], least, periods)]
        else:
            todo += parts
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """``words`` without those that any run holds after its first period."""
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.nonzero(np.cumsum(edges[:-1]) == 0)[0].tolist()] if found else words


def planted(words: list[bytes], key: int) -> list[bytes]:
    """The query's rule: of one id in ten, the words from a place on repeat with a period, both by the id's hash."""
    h, n = zlib.crc32(str(key).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    head = words[a : a + p]
    return words[:a] + (head * ((n - a) // len(head) + 1))[: n - a]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """(doc_id, runs: array of (start, length, period), collapsed) for each row, ``collapsed`` being the text's kept words joined by blanks.

    Words are what lies between ASCII white space. Nulls: a null text is an
    empty one; null ids stay. Texts without words have no runs and an empty
    ``collapsed``. Repeated rows are read each. An empty table gives an empty
    result. Other columns are ignored, whatever their names. A text is read
    within one task; nothing is shuffled.
    """

    def rows(columns):
        for key, text in zip(*columns, strict=True):
            words = (text or b"").split()
            found = runs(numbered(words), least, periods)
            yield key, [{"start": s, "length": n, "period": d} for s, n, d in found], b" ".join(collapsed(words, found)).decode()

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(cols, ["doc_id", "text"], "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string", rows)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The query's digest columns for each row, over texts made periodic by ``planted``; a null id makes none so, else as ``periodic_runs``."""

    def rows(columns):
        for key, text in zip(*columns, strict=True):
            words = (text or b"").split()
            words = words if key is None else planted(words, key)
            found = runs(numbered(words))
            best = min(found, key=_by_exponent, default=None)
            milli = None if best is None else 1000 * best[1] // best[2]
            listed = "".join(f"{s},{n},{d}\n" for s, n, d in found)
            yield key, len(found), *(best or (None,) * 3), milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(cols, ["doc_id", "text"], "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string", rows)


def _by_exponent(run: Run) -> tuple:
    from fractions import Fraction

    return -Fraction(run[1], run[2]), run[0], run[2]


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
