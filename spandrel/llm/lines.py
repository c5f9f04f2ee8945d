"""Line deduplication by a sharded minimal perfect hash.

A line's key is the line stripped of word space at both ends, with A-Z lower-cased. Keys of enough code points that
enough documents hold are indexed: a minimal perfect hash over their 128-bit hashes numbers the slots of three compact
arrays (fingerprint, document count, last holder), one set of arrays per shard. Documents then probe the arrays; no
line text is ever shuffled or joined. A line that is not indexed lands on some slot too, where its fingerprint differs.

Defined results: a null or empty text is one empty line; a document is a `doc_id`, so rows that share one count once, and
of rows that tie for the largest `doc_id` holding a line, all keep it; a null `doc_id` is no document: its lines count
for none and it loses none; a text of any length is one list of its own lines in one worker, never more than a batch
beside it; other columns pass through untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, bounded_batches, boxed, discard, give_back, mix, partitions, store, text_bytes, thrifty, unboxed

#: An index of more bytes is not broadcast: the probes travel to the shards instead.
BROADCAST_BYTES = 48 << 20
#: Keys of one shard, which one task builds.
SHARD_KEYS = 500_000


class PerfectHash:
    """A minimal perfect hash in levels: at each level keys that land alone on a bit own it, the others go on.

    A key's slot is the number of owned bits before its own: one running count for each 512 bits, the rest by population
    counts. Levels are built and probed as whole arrays.
    """

    GAMMA = 2

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        """sizes: bits of each level, multiples of 512; words: the bits of all levels, 64 to a word."""
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        blocks = np.bitwise_count(words).reshape(-1, 8).sum(1, dtype=np.int64)
        self.ranks = np.cumsum(blocks) - blocks

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, packed, left = [], [], np.unique(keys)
        while len(left):
            size = -(-cls.GAMMA * len(left) // 512) * 512
            at = cls._at(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            packed.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate([np.zeros(0, np.uint64), *packed]).astype(np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 or any slot for a key that was not built in."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            at = self._at(keys[open_], level, size) + self.starts[level]
            hit = (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            out[open_[hit]] = self._rank(at[hit])
            open_ = open_[~hit]
        return out

    def dump(self) -> tuple[bytes, bytes]:
        return self.sizes.tobytes(), self.words.tobytes()

    @classmethod
    def load(cls, sizes: bytes, words: bytes) -> PerfectHash:
        return cls(np.frombuffer(sizes, np.int64), np.frombuffer(words, np.uint64))

    def _rank(self, at: np.ndarray) -> np.ndarray:
        """Owned bits before each of these."""
        word = at >> 6
        low = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        out = self.ranks[at >> 9] + np.bitwise_count(low)
        for j in range(7):
            out += np.where(j < (word & 7), np.bitwise_count(self.words[(word & ~7) + j]), 0)
        return out


SHARD = "shard int, sizes binary, words binary, prints binary, counts binary, lasts binary"
_ARRAYS = ("sizes", "words", "prints", "counts", "lasts")


class Shard:
    """One shard: the perfect hash over `key` and, by slot, fingerprint, document count and last holder."""

    def __init__(self, hash_: PerfectHash, prints: np.ndarray, counts: np.ndarray, lasts: np.ndarray):
        self.hash, self.prints, self.counts, self.lasts = hash_, prints, counts, lasts

    @classmethod
    def build(cls, key: np.ndarray, print_: np.ndarray, count: np.ndarray, last: np.ndarray) -> Shard:
        both = mix(key ^ print_)
        hash_ = PerfectHash.build(both)
        order = np.argsort(hash_.slots(both))
        return cls(hash_, print_[order], count[order].astype(np.int64), last[order].astype(np.int64))

    def dump(self) -> tuple[bytes, ...]:
        return *self.hash.dump(), self.prints.tobytes(), self.counts.tobytes(), self.lasts.tobytes()

    @classmethod
    def load(cls, sizes: bytes, words: bytes, prints: bytes, counts: bytes, lasts: bytes) -> Shard:
        return cls(PerfectHash.load(sizes, words), np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.int64), np.frombuffer(lasts, np.int64))

    def drops(self, key: np.ndarray, print_: np.ndarray, doc: np.ndarray, documents: int) -> np.ndarray:
        """Whether each probed line is in at least so many documents, of which its own is not the last."""
        if not len(self.prints):
            return np.zeros(len(key), bool)
        slot = self.hash.slots(mix(key ^ print_))
        return (slot >= 0) & (self.prints[slot] == print_) & (self.counts[slot] >= documents) & (self.lasts[slot] != doc)


def line_keys(text: bytes | None, least: int) -> tuple[list[bytes], list[int], list[bytes]]:
    """The lines of a text, and position and key of those whose key has at least `least` code points."""
    lines = (text or b"").split(b"\n")
    at, keys = [], []
    for i, line in enumerate(lines):
        key = line.strip(WORD_SPACE)
        if len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least):
            at.append(i)
            keys.append(key.lower())  # of bytes: A-Z only
    return lines, at, keys


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)


def line_counts(docs: DataFrame, least: int = 20) -> DataFrame:
    """Hash (two longs), number of documents and last holder of every line key.

    Pairs of a line and a doc_id are made distinct first, dealt by both, so that a line in every document is spread over
    all tasks; only then they are counted, as partial sums, one row a task for such a line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            found: set[tuple[bytes, int]] = set()
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found.update((xxhash.xxh3_128_digest(key), doc) for key in set(line_keys(text.as_py(), least)[2]))
            hash_ = np.frombuffer(b"".join(h for h, _ in found), ">u8").astype(np.int64, casting="unsafe").reshape(-1, 2)
            columns = (*(np.ascontiguousarray(c) for c in hash_.T), np.array([d for _, d in found], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "print", "doc"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), text_bytes()).filter("doc is not null").mapInArrow(run, "key long, print long, doc long")
    return rows.distinct().groupBy("key", "print").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("last"))


def build_index(docs: DataFrame, least: int = 20, documents: int = 3) -> tuple[DataFrame, int]:
    """The stored shards over every line key that at least `documents` documents hold, and the number of shards: as many
    as the session's shuffle partitions, or more where they would hold more than `SHARD_KEYS` keys each."""

    def build(table: pa.Table) -> pa.Table:
        u64 = [table.column(c).to_numpy().view(np.uint64) for c in ("key", "print")]
        made = Shard.build(*u64, table.column("n").to_numpy(), table.column("last").to_numpy()).dump()
        return pa.table([pa.array([table.column("shard")[0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in made)], ["shard", *_ARRAYS])

    held = store(line_counts(docs, least).filter(F.col("n") >= documents), "repeated-lines")
    shards = max(partitions(docs.sparkSession), -(-held.count() // SHARD_KEYS))
    index = store(held.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(build, SHARD), "line-index")
    discard(held)
    return index, shards


def _probe_batch(shards: dict[int, Shard], n_shards: int, docs: list[int | None], found: list, documents: int) -> list[np.ndarray]:
    """For each document of a batch the positions of its lines to drop."""
    owner = np.repeat(np.arange(len(docs)), [len(at) for _, at, _ in found])
    at = np.array([i for _, each, _ in found for i in each], np.int64)
    hash_ = _hashes([k for _, _, keys in found for k in keys])
    known = np.array([d is not None for d in docs], bool)[owner] if len(owner) else np.zeros(0, bool)
    doc = np.array([d or 0 for d in docs], np.int64)[owner] if len(owner) else np.zeros(0, np.int64)
    shard = hash_[:, 0].view(np.int64) % n_shards
    drop = np.zeros(len(owner), bool)
    order = np.argsort(shard, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        if len(part) and (own := shards.get(int(shard[part[0]]))):
            drop[part] = own.drops(hash_[part, 0], hash_[part, 1], doc[part], documents)
    drop &= known
    ends = np.cumsum([len(at) for _, at, _ in found])
    return [x[d] for x, d in zip(np.split(at, ends[:-1]), np.split(drop, ends[:-1]), strict=True)] if len(found) else []


def _digest(ids: pa.Array, results: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    n, dropped, kept = (list(x) for x in zip(*results, strict=True)) if results else ([], [], [])
    made = [ids, pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
    return pa.RecordBatch.from_arrays(made, ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def _texts(results: list[tuple[int, int, bytes]]) -> pa.Array:
    texts = [x.decode("utf-8", "replace") for _, _, x in results]
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["kept", "chars"])


DIGEST = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def _kept(lines: list[bytes], gone) -> tuple[int, int, bytes]:
    out = set(int(x) for x in gone)
    return len(lines), len(out), b"\n".join(lines if not out else [x for i, x in enumerate(lines) if i not in out])


KEPT = "struct<kept: string, chars: long>"


def _replaced(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents out of `row`, with the text and its length from `made`."""
    return unboxed(rows, docs, text=F.col("made.kept"), n_chars=F.col("made.chars"))


def _broadcast_pass(docs: DataFrame, index: DataFrame, least: int, documents: int, digest: bool, n_shards: int) -> DataFrame:
    """Every worker holds the whole index. Only doc_id and text go to Python; other columns stay where they are."""
    held = docs.sparkSession.sparkContext.broadcast([tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in index.collect()])
    loaded: dict[int, Shard] = {}

    def results(ids: pa.Array, texts: pa.Array) -> list[tuple[int, int, bytes]]:
        if not loaded:
            loaded.update({r[0]: Shard.load(*r[1:]) for r in held.value})
        found = [line_keys(t.as_py(), least) for t in texts]
        drops = _probe_batch(loaded, n_shards, ids.to_pylist(), found, documents)
        return [_kept(lines, gone) for (lines, _, _), gone in zip(found, drops, strict=True)]

    if digest:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in thrifty(batches):
                yield _digest(batch.column(0), results(batch.column(0), batch.column(1)))

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).mapInArrow(run, DIGEST)

    @F.arrow_udf(KEPT)
    def texts(ids: pa.Array, raw: pa.Array) -> pa.Array:
        made = _texts(results(ids, raw))
        give_back()
        return made

    return _replaced(docs, boxed(docs, made=texts(F.col("doc_id").cast("long"), text_bytes())))


def _routed_pass(docs: DataFrame, index: DataFrame, least: int, documents: int, digest: bool, n_shards: int, salts: int = 8) -> DataFrame:
    """Beyond the broadcast bound: hashes travel to their shard (each shard stands `salts` times, so that a hot line's
    probes are dealt over that many tasks) and the positions to drop come back to the document, which its doc_id and the
    MD5 of its text name."""

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            rows = []
            for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark")), batch.column("_bytes"), strict=True):
                _, at, keys = line_keys(text.as_py(), least)
                hash_ = _hashes(keys).view(np.int64)
                rows += [(int(h[0] % n_shards), int(doc % salts), int(h[0]), int(h[1]), doc, mark, i) for h, i in zip(hash_, at, strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["shard", "salt", "key", "print", "doc", "mark", "at"])

    def probe(lines: pa.Table, shard: pa.Table) -> pa.Table:
        keep = np.zeros(lines.num_rows, bool)
        if shard.num_rows and lines.num_rows:
            own = Shard.load(*(shard.column(c)[0].as_py() for c in _ARRAYS))
            keep = own.drops(*(lines.column(c).to_numpy().view(np.uint64) for c in ("key", "print")), lines.column("doc").to_numpy(), documents)
        return lines.select(["doc", "mark", "at"]).filter(pa.array(keep))

    marked = boxed(docs, doc_id=F.col("doc_id").cast("long"), _bytes=text_bytes())
    marked = (marked.drop("row") if digest else marked).withColumn("mark", F.unhex(F.md5(F.coalesce(F.col("_bytes"), F.lit(b"")))))
    lines = marked.select("doc_id", "mark", "_bytes").filter("doc_id is not null").mapInArrow(probes, "shard int, salt int, key long, print long, doc long, mark binary, at long")
    copies = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    gone = lines.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(probe, "doc long, mark binary, at long")
    gone = gone.groupBy("doc", "mark").agg(F.collect_set("at").alias("_gone")).withColumnsRenamed({"doc": "_doc", "mark": "_mark"})
    both = marked.join(gone, (F.col("doc_id") == F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left")

    def results(texts: pa.Array, gone: pa.Array) -> list[tuple[int, int, bytes]]:
        return [_kept((t.as_py() or b"").split(b"\n"), g.as_py() or []) for t, g in zip(texts, gone, strict=True)]

    if digest:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in thrifty(batches):
                yield _digest(batch.column(0), results(batch.column(1), batch.column(2)))

        return both.select("doc_id", "_bytes", "_gone").mapInArrow(run, DIGEST)

    @F.arrow_udf(KEPT)
    def texts(raw: pa.Array, gone: pa.Array) -> pa.Array:
        return _texts(results(raw, gone))

    return _replaced(docs, both.select("row", texts("_bytes", "_gone").alias("made")))


def _run(docs: DataFrame, least: int, documents: int, broadcast_bytes: int, digest: bool) -> DataFrame:
    index, n_shards = build_index(docs, least, documents)
    size = index.agg(F.sum(sum((F.length(c) for c in index.columns[1:]), F.lit(0)))).first()[0] or 0
    step = _broadcast_pass if size <= broadcast_bytes else _routed_pass
    return step(docs, index, least, documents, digest, n_shards)


def dedup_lines(docs: DataFrame, least: int = 20, documents: int = 3, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Documents with repeated lines removed from `text` (and `n_chars`, where there is one, brought up to date)."""
    return _run(docs, least, documents, broadcast_bytes, False)


def line_digest(docs: DataFrame, least: int = 20, documents: int = 3, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped and the SHA-256 of the kept text of every document."""
    return _run(docs, least, documents, broadcast_bytes, True)
