"""Secret scans: base patterns, and credential formats inferred as probabilistic automata.

A bounded sample of the base patterns' own matches are the labelled
credentials. Per kind they make a prefix tree of characters, whose
statistically compatible states (Hoeffding's bound on what follows them, ends
included) are merged into a probabilistic automaton: first states of the same
depth, so that literal prefixes and lengths are learnt, then later states into
earlier ones where the data show that they go on alike. Every token that could
be a credential is scored by its likelihood. It becomes a span if a format
explains it better than the automaton of the corpus's other tokens does, and
if it is no more surprising than held-out examples of that format are.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm.shared import drop, map_arrow, written
from verdant.shipping import ship

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# Runs of one class: a minimum in the pattern keeps the same matches as dropping the short ones.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
LEAST_ASSIGN = 6
#: Tokens that are scored: what an assigned value may be, less points at its ends; all of ``LEAST_ASSIGN`` characters or more.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.+[A-Za-z0-9+/_=-]+)*")
#: Of longer values than this the beginning is learnt.
MOST_DEPTH = 64
#: Most labelled credentials of a kind, and most plain tokens (candidates outside base matches) of a stratum; those of least hash in all texts.
MOST_EXAMPLES, MOST_PLAIN = 2000, 4000
#: Plain tokens are learnt and judged in two strata, as there are many more words than long tokens: from so many characters on a token is long.
LONG = 16
_MOST_KNOWN = 1 << 18
ALPHA = 0.05
#: Natural-log likelihood by which a format must beat the plain tokens.
MARGIN = 0.0
#: Surprise, in nats, that a token of ``LONG`` characters may have beyond its format's held-out examples: about that of one character
#: out of place. Shorter ones, which tell less, may have as much less.
SLACK = 12.0
#: Weights of the whole format's characters in each state, of a class of characters in those, and of an end where no example ends.
_POOLED, _CLASS, _END = 8.0, 1.0, 1e-12
FOLDS = 5


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, sorted; kinds count as in ``KINDS``."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _class(c: str) -> tuple[str, int]:
    """A character's class and that class's size; signs stand for themselves."""
    if "0" <= c <= "9":
        return "9", 10
    if "a" <= c <= "z":
        return "a", 26
    return ("A", 26) if "A" <= c <= "Z" else (c, 1)


END = ""


def _by_class(count: Counter) -> Counter:
    out = Counter()
    for c, n in count.items():
        out[c and _class(c)] += n
    return out


class Automaton:
    """A probabilistic automaton inferred from example strings by state merging."""

    def __init__(self, examples: list[str], alpha: float = ALPHA, most_depth: int = MOST_DEPTH):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        for word in examples:
            state = 0
            for c in word[:most_depth]:
                self.count[state][c] += 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                state = self.next[state][c]
            if len(word) <= most_depth:
                self.count[state][END] += 1
        self.into = list(range(len(self.next)))
        self.by_class: dict[int, Counter] = {}
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_levels()
        self._merge_loops()
        self._freeze()

    def _find(self, state: int) -> int:
        while self.into[state] != state:
            self.into[state] = state = self.into[self.into[state]]
        return state

    def _classes(self, state: int) -> Counter:
        if state not in self.by_class:
            self.by_class[state] = _by_class(self.count[state])
        return self.by_class[state]

    def _most(self, a: int, b: int) -> float:
        """The difference of two states' frequencies that chance may make; 1 or more says nothing."""
        return self.bound * (1 / math.sqrt(max(1, self.count[a].total())) + 1 / math.sqrt(max(1, self.count[b].total())))

    def _alike(self, a: int, b: int) -> bool:
        """Whether no state below two states, met by the same characters, differs by more than chance."""
        todo, seen = [(a, b)], set()
        while todo:
            a, b = map(self._find, todo.pop())
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            ca, cb, most = self.count[a], self.count[b], self._most(a, b)
            if most >= 1:  # fewer examples below, which say nothing either
                continue
            na, nb = ca.total(), cb.total()
            if any(abs(ca[c] / na - cb[c] / nb) > most for c in ca.keys() | cb.keys()):
                return False
            ka, kb = self._classes(a), self._classes(b)  # many characters of a class are rare each
            if any(abs(ka[c] / na - kb[c] / nb) > most for c in ka.keys() | kb.keys()):
                return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def _overlap(self, a: int, b: int) -> float:
        """What two states' frequencies of classes have in common, for a choice among states that are all alike for want of examples."""
        ka, kb = self._classes(a), self._classes(b)
        na, nb = ka.total(), kb.total()
        return sum(min(ka[c] / na, kb[c] / nb) for c in ka.keys() & kb.keys())

    def _fold(self, a: int, b: int) -> None:
        """Merges ``b`` into ``a``, and what the same characters lead to."""
        todo = [(a, b)]
        while todo:
            a, b = map(self._find, todo.pop())
            if a == b:
                continue
            self.into[b] = a
            self.count[a].update(self.count[b])
            self.by_class.pop(a, None)
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def _children(self, state: int) -> list[int]:
        return [self._find(self.next[state][c]) for c in sorted(self.next[state])]

    def _merge_levels(self) -> None:
        level = [0]
        while level:
            below = dict.fromkeys(x for s in level for x in self._children(s))
            kept: list[int] = []
            for state in sorted(below, key=lambda x: -self.count[x].total()):
                # States without a class in common aren't merged for want of examples.
                alike = [k for k in kept if self._overlap(k, state) and self._alike(k, state)]
                if alike:
                    self._fold(max(alike, key=lambda k: self._overlap(k, state)), state)
                else:
                    kept.append(state)
            level = list(dict.fromkeys(map(self._find, kept)))

    def _merge_loops(self) -> None:
        kept, todo = [0], self._children(0)
        for state in todo:  # grows
            state = self._find(state)
            if state in kept:
                continue
            other = next((k for k in kept if self._most(k, state) < 1 and self._alike(k, state)), None)
            if other is None:
                kept.append(state)
                todo += self._children(state)
            else:
                self._fold(other, state)

    def _freeze(self) -> None:
        """Log-likelihoods: a state's own frequencies, smoothed by those of all states and of classes of characters."""
        states, todo = {0: 0}, [0]
        for s in todo:  # grows
            for x in self._children(s):
                if x not in states:
                    states[x] = len(states)
                    todo.append(x)
        self.size = len(states)
        self.pooled: Counter = Counter()
        for s in todo:
            self.pooled.update(self.count[s])
        self.pooled.pop(END, None)
        self.classes, self.total = _by_class(self.pooled), max(1, self.pooled.total())
        #: Of each state: log-likelihoods by character, classes' shares, weight of the smoothing, an end's log-likelihood, the usual surprise, where characters lead.
        self.rows: list[tuple[dict[str, float], dict, float, float, float, dict[str, int], dict]] = []
        for s in todo:
            count, n = self.count[s], self.count[s].total()
            shares = {k: x / n for k, x in _by_class(count).items()}
            weight = _POOLED / (n + _POOLED)
            logs = {c: math.log(k / (n + _POOLED) + weight * self._share(c, shares)) for c, k in count.items() if c != END}
            end = math.log((count[END] + _END) / (n + _POOLED))
            usual = -sum(k * logs.get(c, end) for c, k in count.items()) / max(1, n)
            after = {c: states[self._find(x)] for c, x in self.next[s].items()}
            # A character not met here goes where most of its class go, or else most of all.
            likely = {None: states[s]}
            for c in sorted(after, key=lambda c: (count[c], c)):
                likely[_class(c)] = likely[None] = after[c]
            self.rows.append((logs, shares, weight, end, usual, after, likely))
        del self.next, self.count, self.into, self.by_class

    def _share(self, c: str, shares: dict) -> float:
        """A character's share by its class's in the state and its own in the class, mixed with its share of all states'."""
        k = own, size = _class(c)
        within = (self.pooled[c] + _CLASS / size) / (self.classes[k] + _CLASS)
        return 0.9 * shares.get(k, 0.0) * within + 0.1 * (self.pooled[c] + _CLASS * self.classes[k] / self.total / size + 1e-9) / (self.total + _CLASS)

    def score(self, word: str) -> tuple[float, float]:
        """(log-likelihood, surprise): the latter is how much less likely the word is than its states' usual characters."""
        state, total, surprise = 0, 0.0, 0.0
        for c in word:
            logs, shares, weight, _, usual, after, likely = self.rows[state]
            x = logs.get(c)
            if x is None:
                x = logs[c] = math.log(weight * self._share(c, shares))
            total += x
            surprise -= x + usual
            if c in after:
                state = after[c]
            else:
                own = _class(c)
                state = likely[own if own in likely else None]
        _, _, _, end, usual, _, _ = self.rows[state]
        return total + end, surprise - end - usual


def labelled(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[str, str]]:
    """(kind, value) of the base matches, values without points at their ends."""
    for start, kind, end in base:
        value = (ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]).strip(".")
        if len(value) >= LEAST_ASSIGN:
            yield KINDS[kind], value


def stratum(token: str) -> str:
    return "long" if len(token) >= LONG else "short"


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """Tokens that overlap no base span and are long enough for a credential."""
    return (m for m in outside(CANDIDATE, text, base) if m.end() - m.start() >= LEAST_ASSIGN)


class _Least:
    """The ``most`` tokens of least hash, of any number that come."""

    def __init__(self, most: int):
        self.most, self.held, self.bound = most, {}, 1 << 64

    def add(self, tokens: set[str]) -> None:
        for token in tokens:
            h = xxhash.xxh64_intdigest(token)
            if h < self.bound:
                self.held[token] = h
        if len(self.held) > 2 * self.most:
            self.held = dict(heapq.nsmallest(self.most, self.held.items(), key=lambda x: (x[1], x[0])))
            self.bound = max(self.held.values())

    def rows(self) -> list[tuple[str, int]]:
        return [(t, h - (1 << 63)) for t, h in heapq.nsmallest(self.most, self.held.items(), key=lambda x: (x[1], x[0]))]


def outside(pattern: re.Pattern, text: str, taken: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """Matches that overlap no base span."""
    at, reach = 0, 0
    for m in pattern.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach, at = max(reach, taken[at][2]), at + 1
        if reach <= m.start():
            yield m


def _half(token: str) -> int:
    return xxhash.xxh64_intdigest(token) & 1


class Scanner:
    """Base spans and, per inferred format, the tokens that are likelier of it than not."""

    def __init__(self, found: dict[str, list[str]], plain: list[str]):
        found = {k: sorted(set(v)) for k, v in sorted(found.items()) if v}
        self.formats = {k: Automaton(v) for k, v in found.items()}
        self.most = {k: self._held_out(v) for k, v in found.items()}
        # Each half of a stratum's plain tokens judges the other, or a secret among them would have taught what it is compared with.
        halves = {(of, k): [x for x in sorted(set(plain)) if stratum(x) == of and _half(x) == k] for of in ("long", "short") for k in range(2)}
        self.plain = {(of, 1 - k): Automaton(x) if x else None for (of, k), x in halves.items()}
        self.known: dict[str, str | None] = {}

    @staticmethod
    def _held_out(values: list[str]) -> float:
        """The surprise that all but a fiftieth of the examples stay below when they are left out."""
        folds = min(FOLDS, len(values))
        if folds < 2:
            return 0.0
        seen = []
        for k in range(folds):
            rest = Automaton([x for i, x in enumerate(values) if i % folds != k])
            seen += [rest.score(x)[1] for x in values[k::folds]]
        return sorted(seen)[len(seen) - 1 - len(seen) // 50]

    def format_of(self, token: str) -> str | None:
        """The likeliest format that the token is of, if any."""
        if token not in self.known:
            if len(self.known) >= _MOST_KNOWN:
                self.known.clear()
            self.known[token] = self._format_of(token)
        return self.known[token]

    def _format_of(self, token: str) -> str | None:
        scores = [(*a.score(token), k) for k, a in self.formats.items()]
        slack = SLACK * min(1.0, len(token) / LONG)
        good = [(likely, k) for likely, surprise, k in scores if surprise <= self.most[k] + slack]
        if not good:
            return None
        other = self.plain[stratum(token), _half(token)]
        return max(good)[1] if other is None or max(good)[0] >= other.score(token)[0] + MARGIN else None

    def inferred(self, text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, str, int]]:
        if not self.formats:
            return []
        found = ((m, self.format_of(m[0])) for m in candidates(text, taken))
        return [(m.start(), f"like_{k}", m.end()) for m, k in found if k]

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, str, int]]]:
        base = base_spans(text)
        return base, self.inferred(text, base)


def train(docs: DataFrame, text_col: str = "text") -> Scanner:
    """A scanner from the labelled values of least hash in all texts.

    Bounds: ``MOST_EXAMPLES`` values of a kind and ``MOST_PLAIN`` other tokens
    of a stratum, each the ones of least hash in the whole table however its
    rows are dealt, cut to ``MOST_DEPTH`` characters and one more; the driver
    gets no more. Every text is read whole. One example is enough for a format.

    Nulls: null texts have no values. Repeated rows teach as one. An empty
    table makes a scanner of the base patterns alone. Other columns are
    ignored, whatever their names.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["kind", "value", "h"])
        plain = {of: _Least(MOST_PLAIN) for of in ("long", "short")}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own, tokens = set(), set()
                for text in batch.column(0).slice(at, 256).to_pylist():
                    base = base_spans(text or "")
                    own.update(labelled(text or "", base))
                    tokens.update(m[0] for m in candidates(text or "", base))
                for of, least in plain.items():
                    least.add({t for t in tokens if stratum(t) == of})
                if own:
                    yield made([(k, v[: MOST_DEPTH + 1], xxhash.xxh64_intdigest(v) - (1 << 63)) for k, v in own])
        rows = [(of, t[: MOST_DEPTH + 1], h) for of, least in plain.items() for t, h in least.rows()]
        if rows:
            yield made(rows)

    found = written(docs.select(F.col(text_col).alias("text")).mapInArrow(run, "kind string, value string, h long"), "credentials")
    of = lambda kind, most: [r["value"] for r in found.where(F.col("kind") == kind).groupBy("h").agg(F.min("value").alias("value")).orderBy("h").limit(most).collect()]
    scanner = Scanner({k: of(k, MOST_EXAMPLES) for k in KINDS}, of("long", MOST_PLAIN) + of("short", MOST_PLAIN))
    drop(found)
    return scanner


def scan(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row.

    Spans are kind:start:end in code points, end exclusive, by start and then
    kind (base kinds as listed, inferred ones after them), comma-joined.

    Nulls: a null text is an empty one; null ids stay. Repeated rows are
    scanned each. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    handed = docs.sparkSession.sparkContext.broadcast(scanner)  # its bounded examples

    def rows(columns):
        for key, raw in zip(*columns, strict=True):
            base, more = handed.value.spans((raw or b"").decode("utf-8", "replace"))
            kinds = Counter(k for _, k, _ in base)
            own = [f"{KINDS[k]}:{s}:{e}" for s, k, e in base]
            every = sorted([(s, k, f"{KINDS[k]}:{s}:{e}") for s, k, e in base] + [(s, len(KINDS), f"{k}:{s}:{e}") for s, k, e in more])
            yield key, kinds[0], kinds[1], kinds[2], hashlib.sha256(",".join(own).encode()).hexdigest(), ",".join(x[2] for x in every)

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(cols, ["doc_id", "text"], "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", rows)


def redact(text: str, scanner: Scanner) -> str:
    """``text`` with each secret's span (overlapping ones as one) replaced by [SECRET]; an assignment keeps its name."""
    base, more = scanner.spans(text)
    spans = [((ASSIGN.match(text, s).start(2) if k == 0 else s), e) for s, k, e in base] + [(s, e) for s, _, e in more]
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, scanner: Scanner, text_col: str = "text") -> DataFrame:
    """``docs``, same columns and rows, with redacted texts; null texts stay null."""
    ship(docs.sparkSession)
    handed = docs.sparkSession.sparkContext.broadcast(scanner)
    schema = docs.schema
    at = schema.fieldNames().index(text_col)

    def run(batches):
        for batch in batches:
            for cut in range(0, batch.num_rows, 256):
                part = batch.slice(cut, 256)
                texts = [t if t is None else redact(t, handed.value) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(run, schema)


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, train(docs))
