"""Secret scans: fixed patterns, and formats inferred from the credentials they find.

The patterns (`assign`, `access`, `hex`) give the base spans. A bounded sample of the credentials they find, labelled
with their kind, trains a probabilistic automaton for each kind: the prefix tree of the credentials' character classes,
in which states whose futures do not differ statistically (Hoeffding bounds) are merged. Ordinary long tokens train a
background automaton the same way. Every other long token of a text is then scored by its likelihood as each format
against the background; likely ones are added as `like_assign`, `like_access` or `like_hex`. Base spans always stay.

Defined results: a null text counts as empty, with no spans; spans count code points, end exclusive, and bytes that are
not UTF-8 count as U+FFFD; rows are scanned each, whatever their doc_id; a corpus without credentials of a kind adds no
spans of it; what teaches is chosen by a hash of its content, so the result does not depend on how rows are dealt;
texts of any length are scanned whole, in time proportional to it; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, store, text_bytes, thrifty

#: Bounds of the training sample: credentials of each kind, and ordinary tokens; those with the smallest hashes.
SAMPLE, BACKGROUND = 500, 2000
KINDS = ("assign", "access", "hex")
LEARNED = tuple(f"like_{k}" for k in KINDS)
#: A token of fewer characters is not scored; one is added from this gain in log likelihood per character on.
SHORTEST, GAIN = 16, 0.7

_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_ASSIGN = re.compile(f"({_WORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile("AKIA[A-Z0-9]{12,}")  # a maximal run is too short as a whole or matches as a whole
_HEX = re.compile("[0-9a-f]{32,}")
_TOKEN = re.compile(f"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")

Span = tuple[int, int, str, str]  # start, end, kind, credential


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by kind and place; `assign` spans are whole matches, their credential group 2."""
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign", m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex", m[0]) for m in _HEX.finditer(text)]


#: Character classes and how many characters each holds.
_CLASSES = {"0": "0123456789", "a": "abcdef", "g": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "G": "GHIJKLMNOPQRSTUVWXYZ"}
_CLASS_OF = str.maketrans({c: k for k, members in _CLASSES.items() for c in members})


class _Node:
    __slots__ = ("count", "ends", "next")

    def __init__(self) -> None:
        self.count, self.ends = 0, 0
        self.next: dict[str, _Node] = {}


def _differ(a: int, n: int, b: int, m: int, alpha: float) -> bool:
    """Whether two frequencies are further apart than Hoeffding's bounds allow at level alpha."""
    return abs(a / n - b / m) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))


def _compatible(a: _Node, b: _Node, alpha: float, least: int) -> bool:
    """Whether two states' futures do not differ; fewer than `least` visits tell nothing."""
    waiting = [(a, b)]
    while waiting:
        a, b = waiting.pop()
        if a.count < least or b.count < least:
            continue
        if _differ(a.ends, a.count, b.ends, b.count, alpha):
            return False
        for symbol in a.next.keys() | b.next.keys():
            x, y = a.next.get(symbol), b.next.get(symbol)
            if _differ(x.count if x else 0, a.count, y.count if y else 0, b.count, alpha):
                return False
            if x and y:
                waiting.append((x, y))
    return True


def _fold(into: _Node, other: _Node) -> None:
    """Add a subtree's counts to a state, keeping it deterministic."""
    waiting = [(into, other)]
    while waiting:
        into, other = waiting.pop()
        into.count += other.count
        into.ends += other.ends
        for symbol, child in other.next.items():
            if symbol in into.next:
                waiting.append((into.next[symbol], child))
            else:
                into.next[symbol] = child


@dataclass(frozen=True)
class Automaton:
    """A probabilistic automaton over classes. moves: by state, class to (state, log probability); stops: log probabilities."""

    moves: tuple[dict[str, tuple[int, float]], ...]
    stops: tuple[float, ...]
    unseen: float

    def likelihood(self, classes: str) -> float:
        state, total = 0, 0.0
        for symbol in classes:
            found = self.moves[state].get(symbol)
            if found is None:  # off the format: stay, at the price of something never seen
                total += self.unseen
                continue
            state, total = found[0], total + found[1]
        return total + self.stops[state]


def infer(words: list[str], alpha: float = 0.05, least: int = 12) -> Automaton:
    """Merge the compatible states of the prefix tree of class strings. States are visited breadth first, the frequent
    ones of a level first: each is merged into the first kept state that it agrees with, or kept."""
    root = _Node()
    for word in sorted(words):
        node = root
        node.count += 1
        for symbol in word:
            node = node.next.setdefault(symbol, _Node())
            node.count += 1
        node.ends += 1
    kept = [root]
    waiting = deque((root, s) for s in sorted(root.next, key=lambda s: (-root.next[s].count, s)))
    while waiting:
        parent, symbol = waiting.popleft()
        node = parent.next[symbol]
        if any(node is k for k in kept):
            continue
        same = next((k for k in kept if _compatible(k, node, alpha, least)), None)
        if same is None:
            kept.append(node)
            fresh = node
        else:
            parent.next[symbol] = same
            _fold(same, node)
            fresh = same
        for s in sorted(fresh.next, key=lambda s: (-fresh.next[s].count, s)):
            if not any(fresh.next[s] is k for k in kept):
                waiting.append((fresh, s))
    number = {id(k): i for i, k in enumerate(kept)}
    moves, stops = [], []
    for k in kept:
        total = k.ends + sum(min(c.count, k.count) for c in k.next.values()) + 1
        moves.append({s: (number[id(c)], math.log((min(c.count, k.count) + 0.5) / total)) for s, c in k.next.items() if id(c) in number})
        stops.append(math.log((k.ends + 0.5) / total))
    return Automaton(tuple(moves), tuple(stops), math.log(0.5 / (len(words) + 1)))


@dataclass(frozen=True)
class Formats:
    """Automata by kind, with half the length of the shortest credential each has seen, and the background."""

    kinds: dict[str, tuple[Automaton, int]]
    background: Automaton

    def kind(self, token: str) -> str | None:
        """The most likely format of a token, if it is likely enough."""
        classes = token.translate(_CLASS_OF)
        plain = self.background.likelihood(classes)
        best = max(((a.likelihood(classes) - plain, k) for k, (a, least) in self.kinds.items() if len(token) >= least), default=None)
        return f"like_{best[1]}" if best and best[0] >= GAIN * len(token) else None


def _candidates(text: str, base: list[Span]) -> Iterator[tuple[int, int, str]]:
    """The long tokens of a text that no base span touches: both are walked once, in order."""
    taken = sorted((a, b) for a, b, _, _ in base)
    i, end = 0, -1  # the furthest end of the spans that start before the token's own
    for m in _TOKEN.finditer(text):
        while i < len(taken) and taken[i][0] < m.end():
            end = max(end, taken[i][1])
            i += 1
        if end <= m.start():
            yield m.start(), m.end(), m[0]


def _order(value: str) -> tuple[int, str]:
    """What decides which values teach, `xxhash64` as Spark computes it: the same for any partitioning."""
    unsigned = xxhash.xxh64_intdigest(value.encode("utf-8", "replace"), 42)
    return unsigned - (1 << 64 if unsigned >> 63 else 0), value


def _bound(kind: str) -> int:
    return BACKGROUND if kind == "background" else SAMPLE


def _sample(docs: DataFrame) -> DataFrame:
    """kind, value of the credentials and ordinary tokens of every document, thinned in each batch by hash: what is among
    the smallest of all is among the smallest of its batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            found: dict[str, set[str]] = {k: set() for k in (*KINDS, "background")}
            for raw in batch.column(0).to_pylist():
                text = (raw or b"").decode("utf-8", "replace")
                base = base_spans(text)
                for _, _, kind, value in base:
                    found[kind].add(value)
                if not base:
                    found["background"].update(t for _, _, t in _candidates(text, base))
            rows = [(k, v) for k, values in found.items() for v in heapq.nsmallest(_bound(k), values, key=_order)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["kind", "value"])

    bounded_batches(docs.sparkSession)
    return docs.select(text_bytes()).mapInArrow(run, "kind string, value string").distinct()


def learn(docs: DataFrame) -> Formats | None:
    """The formats of a corpus's credentials; None if it has none, or nothing to tell them from."""
    sample = store(_sample(docs), "credentials")
    some = {}
    for kind in (*KINDS, "background"):
        own = sample.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value")
        some[kind] = [r[0] for r in own.select("value").limit(_bound(kind)).collect()]
    discard(sample)
    return train(some)


def train(labelled: dict[str, list[str]]) -> Formats | None:
    """Formats from credentials by kind, and `background` tokens."""
    made = {k: (infer([v.translate(_CLASS_OF) for v in labelled[k]]), max(SHORTEST, min(map(len, labelled[k])) // 2)) for k in KINDS if len(labelled.get(k, ())) >= 8}
    if not made:
        return None
    plain = labelled.get("background") or []
    return Formats(made, infer([v.translate(_CLASS_OF) for v in plain] or ["g" * SHORTEST]))


def scan(text: str, formats: Formats | None) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans of a text."""
    base = base_spans(text)
    added = [(a, b, kind, t) for a, b, t in _candidates(text, base) if (kind := formats.kind(t))] if formats else []
    return base, added


def listed(spans: list[Span]) -> str:
    """kind:start:end, by start and then kind."""
    rank = {k: i for i, k in enumerate((*KINDS, *LEARNED))}
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted((a, rank[k], b, k) for a, b, k, _ in spans))


def secret_spans(docs: DataFrame, formats: Formats | None) -> DataFrame:
    """One row per span: doc_id, kind, start, end and the credential."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, added = scan((raw or b"").decode("utf-8", "replace"), formats)
                rows += [(doc, k, a, b, v) for a, b, k, v in base + added]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "kind", "start", "end", "credential"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, "doc_id long, kind string, start long, end long, credential string")


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document."""
    formats = learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            rows = []
            for raw in batch.column(1).to_pylist():
                base, added = scan((raw or b"").decode("utf-8", "replace"), formats)
                counts = [sum(k == kind for _, _, k, _ in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + added)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
