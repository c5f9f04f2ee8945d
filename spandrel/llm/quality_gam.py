"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into quantile bins. Cyclic boosting visits the features in turn; each visit fits a shallow tree to
the current gradient over that feature's bins and adds it to the feature's lookup table. Then the pairs of features
whose bins explain most of what is left get two-dimensional tables the same way. A score is the sigmoid of one table
entry per feature and pair, added up over whole batches at once.

Labels come from `labels.quality` of at most about `SAMPLE_ROWS` labelled documents, chosen by a hash of doc_id, and
never from held-out ones; a doc_id on several rows teaches once, with its smallest text; lang, source and doc_id are not inputs. Counts and features cover whole texts.

Defined results: a null or empty text has all features 0 and is scored like any other; a null doc_id is not held out;
null labels, and labels whose document is missing, teach nothing; repeated rows are scored each; without labels of both
kinds the score is the smoothed share of label 1 everywhere; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SCAN_BYTES, Words, bounded_batches, boxed, give_back, slices, text_bytes, thrifty, unboxed

#: Bound of the labelled sample a model is fitted on.
SAMPLE_ROWS = 20_000
HELD_OUT = (4, 2)
THRESHOLD = 0.7
FEATURES = ("words", "word_bytes", "upper", "digit", "symbol", "stop_mark", "comma", "high_byte", "line_break", "control", "distinct_words", "distinct_pairs", "top_word", "short_words", "marked_words", "repeated_lines", "pipe_or_brace", "bang")


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(members)] = 1
    return out


_CLASSES = np.stack([
    _class(bytes(range(65, 91))), _class(b"0123456789"), _class(b"#$%&*@^~_+=<>/\\`"), _class(b"."), _class(b","), _class(bytes(range(128, 256))),
    _class(b"\n"), _class(bytes(x for x in range(32) if x not in (9, 10, 13))), _class(b"|{}[]();:"), _class(b"!?"),
], 1)


def _distinct(owner: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each owner, and how often its most frequent key occurs."""
    if not len(key):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((key, owner))
    o, k = owner[order], key[order]
    heads = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (o[1:] != o[:-1]))))
    often = np.diff(np.append(heads, len(k)))
    most = np.zeros(n)
    np.maximum.at(most, o[heads], often)
    return np.bincount(o[heads], minlength=n).astype(float), most


def features(texts: list[bytes | None]) -> np.ndarray:
    """A row of FEATURES for each text, computed in slices, as a scan's arrays are many times its text."""
    return np.concatenate([_features(texts[a:b]) for a, b in slices(texts, SCAN_BYTES)])


def _features(texts: list[bytes | None]) -> np.ndarray:
    n = len(texts)
    scan = Words(texts)
    size = np.maximum(1, np.diff(scan.begins) - 1).astype(float)
    counts = np.stack([np.bincount(scan.data[a:b], minlength=256) for a, b in zip(scan.begins[:-1].tolist(), (scan.begins[1:] - 1).tolist(), strict=True)]) if n else np.zeros((0, 256))
    upper, digit, symbol, stop, comma, high, line, control, pipe, bang = (counts @ _CLASSES / size[:, None]).T
    words = scan.counts.astype(float)
    some = np.maximum(1, words)
    h = scan.hashes()
    length = scan.ends - scan.starts
    distinct, top = _distinct(scan.doc, h, n)
    pairs = scan.doc[:-1] == scan.doc[1:]
    both, _ = _distinct(scan.doc[:-1][pairs], (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[pairs], n)
    last = scan.data[scan.ends - 1]
    marked = _CLASSES[last][:, [2, 8, 9]].sum(1) > 0
    by_word = lambda x: np.bincount(scan.doc, x, n) / some
    lines = [[x for x in (t or b"").split(b"\n") if x.strip()] for t in texts]
    repeated = np.array([1 - len(set(x)) / len(x) if x else 0 for x in lines])
    return np.stack([
        np.log1p(words), by_word(length), upper, digit, symbol, stop, comma, high, line, control, distinct / some,
        np.where(words > 1, both / np.maximum(1, words - 1), 0), top / some, by_word(length <= 3), by_word(marked), repeated, pipe, bang,
    ], 1)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float) -> np.ndarray:
    """A shallow tree over ordered bins with gradient sums g and curvature sums h: the value of each bin."""
    best, at = 1e-6, 0
    if depth and len(g) > 1:
        cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        rg, rh = g.sum() - cg, h.sum() - ch
        gain = cg**2 / (ch + 1) + rg**2 / (rh + 1) - g.sum() ** 2 / (h.sum() + 1)
        gain[(ch < least) | (rh < least)] = 0
        at = int(gain.argmax())
        best = gain[at]
    if not depth or len(g) < 2 or best <= 1e-6:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate((_tree(g[: at + 1], h[: at + 1], depth - 1, least), _tree(g[at + 1 :], h[at + 1 :], depth - 1, least)))


def _tree2(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """The best tree that cuts one axis of a grid once and each side once along the other."""
    best, out = -1.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for cut in range(1, len(gg)):
            made = np.empty_like(gg)
            gain = 0.0
            for rows in (slice(0, cut), slice(cut, None)):
                value = _tree(gg[rows].sum(0), hh[rows].sum(0), 1, least)
                made[rows] = value
                gain += float((gg[rows].sum(0) * value).sum())
            if gain > best:
                best, out = gain, (made.T if flip else made).copy()
    return out


@dataclass
class Model:
    """Bin edges by feature, one table a feature, and tables over pairs of coarser bins."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        if self.tables:
            for j, (edge, table) in enumerate(zip(self.edges, self.tables, strict=True)):
                z += table[np.searchsorted(edge, x[:, j], "right")]
            cells = {j: np.searchsorted(self.coarse[j], x[:, j], "right") for pair in self.pairs for j in pair}
            for (a, b), table in self.pairs.items():
                z += table[cells[a], cells[b]]
        return 1 / (1 + np.exp(-z))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 32, n_pairs: int = 6, pair_rounds: int = 30) -> Model:
    """Cyclic boosting by feature, then by the strongest pairs, on log loss."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(intercept=float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return model
    k, least = x.shape[1], 2.0
    model.edges = [_edges(x[:, j], bins) for j in range(k)]
    model.coarse = [_edges(x[:, j], 8) for j in range(k)]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j in range(k):
            p = 1 / (1 + np.exp(-z))
            step = rate * _tree(np.bincount(at[j], y - p, len(model.tables[j])), np.bincount(at[j], p * (1 - p), len(model.tables[j])), 2, least)
            model.tables[j] += step
            z += step[at[j]]
    cell = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]

    def sums(a: int, b: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        flat = cell[a] * shape[1] + cell[b]
        return tuple(np.bincount(flat, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p)))

    p = 1 / (1 + np.exp(-z))
    gain = {(a, b): float((lambda g, h: (g**2 / (h + 1)).sum())(*sums(a, b, p))) for a in range(k) for b in range(a)}
    chosen = sorted(gain, key=lambda q: (-gain[q], q))[:n_pairs]
    model.pairs = {(a, b): np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in chosen}
    for _ in range(pair_rounds):
        for a, b in chosen:
            step = rate * _tree2(*sums(a, b, 1 / (1 + np.exp(-z))), least)
            model.pairs[a, b] += step
            z += step[cell[a], cell[b]]
    return model


def held_out(doc_id="doc_id"):
    """Whether a document's labels are kept from learning: crc32 of doc_id as text, mod 4, is 2."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % HELD_OUT[0] == HELD_OUT[1]


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, y, text) of about `rows` labelled documents that are not held out, at most. The labels are thinned by a
    hash of doc_id before the join, so the side that is broadcast has that bound."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(~held_out()).distinct()
    total = known.count()
    if total > rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * rows / total))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).join(F.broadcast(known), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # a doc_id that many rows share teaches once


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            x = features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    bounded_batches(docs.sparkSession)
    got = labelled_sample(docs, labels, rows).mapInArrow(run, "doc_id long, y int, x array<double>").toArrow()
    if not got.num_rows:
        return Model()
    x, y, ids = np.array(got.column("x").to_pylist()), got.column("y").to_numpy().astype(float), got.column("doc_id").to_numpy()
    order = np.lexsort((y, ids))
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`row`, the document, and its `score`. Only the text goes to Python and only the score comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables only: a few thousand numbers

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        made = pa.array(shared.value.score(features(texts.to_pylist())))
        give_back()
        return made

    bounded_batches(docs.sparkSession)
    return boxed(docs, score=run(text_bytes()))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(rows, train(rows, labels)).select("row.doc_id", "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject; columns as they came."""
    return unboxed(score(docs, train(docs, labels)).filter(F.col("score") >= threshold), docs)
