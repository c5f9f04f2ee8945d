"""Substring deduplication by super-k-mer partitioning.

A window is `width` consecutive words of one document. The minimiser of a window is the smallest hash among its runs of
`MER` words; consecutive windows that share it travel together, as one packed string (a super-k-mer), to the bucket of
that minimiser. Equal windows have equal minimisers, so a bucket holds every occurrence of its windows: sorting them
there tells, exactly, in which documents a window also starts. Hashes only order the sort; equal neighbours are
compared word by word.

Skew: a batch ships a repeated string once, for its smallest document; for the others of the batch it already follows
that their windows repeat. Minimisers that a sample of the documents shows to be frequent are dealt by whole windows
instead, which only moves work between tasks: every window is still compared.

Defined results: a null text has no words; a null doc_id is compared with nothing and loses nothing; rows of one doc_id
are the same document (their windows do not repeat each other); other columns are ignored by the digest and kept by
`dedup_substrings`; a very long text is scanned whole and its windows travel like those of others; rows that share both
doc_id and the CRC-32 of their text share their ranges; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SCAN_BYTES, Words, bounded_batches, box_schema, boxed, discard, expand, mix, partitions, slices, squeeze, store, text_bytes, thrifty, unboxed

MER = 3
#: Buckets for each shuffle partition, at least: a task sorts one bucket at a time. So many more that a bucket has about
#: this many bytes of packed strings at most, which come to about three times the text's.
BUCKETS, BUCKET_BYTES, PACKED = 6, 64 << 20, 3
#: One document in this many is looked at for frequent minimisers, and at most so many are dealt by window.
SAMPLE, MOST_HOT = 64, 4096
#: Bytes of text shipped at once.
SHIP_BYTES = 8 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n words (runs that cross documents are meaningless and never used)."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        out = out * _GOLD + h[j : j + len(out)]
    return mix(out)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    span = 1
    while 2 * span <= n:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (n - span)], x[n - span :]) if n > span else x


def super_kmers(scan: Words, width: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of windows, bucket hash) of every super-k-mer, in order. Windows whose minimiser is in the
    sorted array `hot` stand alone, under a hash of the whole window."""
    h = scan.hashes()
    if len(h) < width:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    low = _sliding_min(_grams(h, MER), width - MER + 1)
    whole = scan.doc[: len(low)] == scan.doc[width - 1 :]
    alone = np.zeros(len(low), bool)
    if len(hot):
        alone = hot[np.minimum(np.searchsorted(hot, low), len(hot) - 1)] == low
        low = np.where(alone, _grams(h, width), low)
    cut = np.ones(len(low), bool)
    cut[1:] = (low[1:] != low[:-1]) | alone[1:] | (scan.doc[1 : len(low)] != scan.doc[: len(low) - 1])
    cut[1:] |= whole[1:] != whole[:-1]
    begins = np.flatnonzero(cut)
    counts = np.diff(np.append(begins, len(low)))
    real = whole[begins]
    return begins[real], counts[real], low[begins[real]]


def _deltas(rows: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(np.diff(rows, axis=0, prepend=0).T.astype(kind)).tobytes()


def _pack(strings: list[bytes], entries: np.ndarray, ids: np.ndarray, marks: np.ndarray, flags: np.ndarray) -> bytes:
    """entries: (string, document, first word); ids, marks: doc_id and checksum by document; flags: (document, from, to).
    Strings go in sorted order and numbers as differences, which compress well."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    place = np.empty(len(strings), np.int64)
    place[order] = np.arange(len(strings))
    entries[:, 0] = place[entries[:, 0]] if len(entries) else entries[:, 0]
    entries = entries[np.lexsort((entries[:, 2], entries[:, 1], entries[:, 0]))]
    head = np.array([len(strings), len(entries), len(ids), len(flags)], np.int64).tobytes()
    body = b"\n".join([strings[i] for i in order])
    return squeeze(head + _deltas(entries, np.int32) + _deltas(ids[:, None], np.int64) + marks.astype(np.uint32).tobytes() + _deltas(flags, np.int32) + body)


def _unpack(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    raw = expand(blob)
    n, e, d, f = np.frombuffer(raw, np.int64, 4).tolist()
    at = 32
    entries = np.frombuffer(raw, np.int32, 3 * e, at).reshape(3, -1).cumsum(1, dtype=np.int64).T
    ids = np.frombuffer(raw, np.int64, d, at := at + 12 * e).cumsum()
    marks = np.frombuffer(raw, np.uint32, d, at := at + 8 * d).astype(np.int64)
    flags = np.frombuffer(raw, np.int32, 3 * f, at := at + 4 * d).reshape(3, -1).cumsum(1, dtype=np.int64).T
    return raw[at + 12 * f :].split(b"\n") if n else [], entries, np.stack((ids, marks), 1), flags


def _ship(ids: np.ndarray, marks: np.ndarray, texts: list[bytes | None], width: int, hot: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    """The blobs of one batch, by bucket. Rows are in ascending order of doc_id."""
    found: list[tuple[np.ndarray, ...]] = []
    texts_at = 0
    joined: list[bytes] = []
    for a, b in slices(texts, SCAN_BYTES):  # the scan's arrays are many times its text, what is kept of them is not
        scan = Words(texts[a:b], plain=True)
        begin, count, low = super_kmers(scan, width, hot)
        row = scan.doc[begin]
        ends = scan.at[begin + count + width - 1] - 1
        found.append((row + a, begin - scan.first[row], count, scan.at[begin] + texts_at, ends + texts_at, (mix(low) % np.uint64(n_buckets)).astype(np.int64)))
        joined.append(scan.plain)
        texts_at += len(scan.plain)
    row, start, count, left, right, bucket = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 6
    plain = b"".join(joined)
    del found, joined
    start, left, right = start.tolist(), left.tolist(), right.tolist()
    ids_of = ids[row].tolist()
    order = np.argsort(bucket, kind="stable")
    edges = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
    rows, counts = row.tolist(), count.tolist()
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        strings: dict[bytes, int] = {}
        held: list[int] = []
        entries, flags = [], []
        for k in order[a:b].tolist():
            text = plain[left[k] : right[k]]
            at = strings.setdefault(text, len(held))
            if at == len(held):
                held.append(ids_of[k])
            if held[at] == ids_of[k]:
                entries.append((at, rows[k], start[k]))
            else:  # a smaller document of this batch has the same string
                flags.append((rows[k], start[k], start[k] + counts[k] + width - 1))
        entries_, flags_ = (np.array(x, np.int64).reshape(-1, 3) for x in (entries, flags))
        used, own = np.unique(np.concatenate((entries_[:, 1], flags_[:, 0])), return_inverse=True)
        entries_[:, 1], flags_[:, 0] = own[: len(entries_)], own[len(entries_) :]
        yield int(bucket[order[a]]), _pack(list(strings), entries_, ids[used], marks[used], flags_)


def _windows_first(scan: Words, begins: np.ndarray, width: int, doc: np.ndarray) -> np.ndarray:
    """The smallest document of each window's equals. begins: first word of each window; doc: its document."""
    _, codes = np.unique(scan.hashes(), return_inverse=True)
    whole = _grams(scan.hashes(), width)[begins]
    order = np.argsort(whole, kind="stable")
    key = whole[order]
    same = key[1:] == key[:-1]
    near = np.flatnonzero(same)
    for j in range(width):  # equal hashes must be equal words
        if not (codes[begins[order[near]] + j] == codes[begins[order[near + 1]] + j]).all():
            rows = np.stack([codes[begins + j] for j in range(width)], 1)
            _, group = np.unique(rows, axis=0, return_inverse=True)
            order = np.argsort(group, kind="stable")
            same = group[order][1:] == group[order][:-1]
            break
    heads = np.flatnonzero(np.concatenate(([True], ~same)))
    low = np.minimum.reduceat(doc[order], heads)
    out = np.empty(len(begins), np.int64)
    out[order] = np.repeat(low, np.diff(np.append(heads, len(order))))
    return out


def _ranges(doc: np.ndarray, mark: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[list, list, list]:
    """(doc_id, checksum, packed int32 pairs) from covered word ranges."""
    if not len(doc):
        return [], [], []
    order = np.lexsort((low, mark, doc))
    doc, mark, pairs = doc[order], mark[order], np.stack((low[order], high[order]), 1).astype(np.int32)
    heads = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]))))
    return doc[heads].tolist(), mark[heads].tolist(), [x.tobytes() for x in np.split(pairs, heads[1:])]


def _bucket(blobs: list[bytes], width: int) -> tuple[list, list, list]:
    """The covered ranges that one bucket's windows show."""
    parts = [_unpack(b) for b in blobs]
    strings = [s for p in parts for s in p[0]]
    shift_s = np.cumsum([0] + [len(p[0]) for p in parts])
    shift_d = np.cumsum([0] + [len(p[2]) for p in parts])
    docs = np.concatenate([p[2] for p in parts])
    entries = np.concatenate([p[1] + [s, d, 0] for p, s, d in zip(parts, shift_s, shift_d, strict=False)])
    flags = np.concatenate([p[3] + [d, 0, 0] for p, d in zip(parts, shift_d, strict=False)])
    doc, mark = [docs[flags[:, 0], 0]], [docs[flags[:, 0], 1]]
    low, high = [flags[:, 1]], [flags[:, 2]]
    if strings:
        owner = np.empty(len(strings), np.int64)
        owner[entries[:, 0]] = docs[entries[:, 1], 0]
        scan = Words(strings)
        n = scan.counts - width + 1
        string = np.repeat(np.arange(len(strings)), n)
        step = np.arange(len(string)) - np.repeat(np.cumsum(n) - n, n)
        hit = _windows_first(scan, scan.first[string] + step, width, owner[string]) < owner[string]
        if hit.any():
            run = np.flatnonzero(hit)
            cut = np.concatenate(([True], (np.diff(run) > 1) | (np.diff(string[run]) > 0)))
            last = np.append(np.flatnonzero(cut)[1:] - 1, len(run) - 1)
            found = np.stack((string[run[cut]], step[run[cut]], step[run[last]] + width), 1)
            at = np.searchsorted(found[:, 0], entries[:, 0])
            to = np.searchsorted(found[:, 0], entries[:, 0], "right")
            pick = np.repeat(np.arange(len(entries)), to - at)
            span = found[np.repeat(at, to - at) + np.arange(len(pick)) - np.repeat(np.cumsum(to - at) - (to - at), to - at)]
            doc.append(docs[entries[pick, 1], 0])
            mark.append(docs[entries[pick, 1], 1])
            low.append(entries[pick, 2] + span[:, 1])
            high.append(entries[pick, 2] + span[:, 2])
    return _ranges(*(np.concatenate(x) for x in (doc, mark, low, high)))


def _checksum(text: bytes | None) -> int:
    return zlib.crc32(text or b"")


def _sampled(docs: DataFrame, width: int) -> tuple[list[tuple[int, int]], int, int]:
    """Of a sample of documents: the most frequent minimisers with their numbers of super-k-mers, the number of all
    super-k-mers, and the bytes of text."""
    none = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            texts = batch.column(0).to_pylist()
            found = [super_kmers(Words(texts[a:b]), width, none)[2] for a, b in slices(texts, SCAN_BYTES)]
            low, n = np.unique(np.concatenate(found), return_counts=True)
            size = sum(len(t) for t in texts if t)
            yield pa.RecordBatch.from_arrays([pa.array([*low.view(np.int64).tolist(), None], pa.int64()), pa.array([*n.tolist(), size], pa.int64())], ["low", "n"])

    few = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select(text_bytes())
    counts = store(few.mapInArrow(run, "low long, n long").groupBy("low").agg(F.sum("n").alias("n")), "minimisers")  # null: bytes of text
    rows = counts.filter("low is not null and n >= 4").orderBy(F.desc("n"), "low").limit(MOST_HOT).collect()
    everything, size = counts.agg(F.sum(F.when(F.col("low").isNotNull(), F.col("n"))), F.sum(F.when(F.col("low").isNull(), F.col("n")))).first()
    discard(counts)
    return [(r[0], r[1]) for r in rows], everything or 0, size or 0


def _frequent(docs: DataFrame, width: int, n_buckets: int, sampled: tuple[list[tuple[int, int]], int, int] | None = None) -> np.ndarray:
    """Minimisers of so many super-k-mers in a sample of documents that they would fill a good part of a bucket."""
    counts, everything, _ = sampled or _sampled(docs, width)
    return np.sort(np.array([low for low, n in counts if n * n_buckets * 8 > everything], np.int64).view(np.uint64))


def repeated_ranges(docs: DataFrame, width: int = 13) -> DataFrame:
    """doc_id, mark (checksum of the text), ranges: the word ranges of each text that repeat a smaller document's window."""
    sampled = _sampled(docs, width)
    n_buckets = max(partitions(docs.sparkSession) * BUCKETS, -(-sampled[2] * SAMPLE * PACKED // BUCKET_BYTES))
    hot = _frequent(docs, width, n_buckets, sampled)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            ids = batch.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            texts = batch.column(1).to_pylist()
            texts = [texts[i] for i in order]
            marks = np.array([_checksum(t) for t in texts], np.int64)
            ids = ids[order]
            made = [x for a, b in slices(texts, SHIP_BYTES) for x in _ship(ids[a:b], marks[a:b], texts[a:b], width, hot, n_buckets)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.int32()), pa.array([x[1] for x in made], pa.binary())], ["bucket", "blob"])

    def sort(table: pa.Table) -> pa.Table:
        doc, mark, pairs = _bucket(table.column("blob").to_pylist(), width)
        return pa.table([pa.array(doc, pa.int64()), pa.array(mark, pa.int64()), pa.array(pairs, pa.binary())], ["doc_id", "mark", "pairs"])

    bounded_batches(docs.sparkSession, SHIP_BYTES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).filter("doc_id is not null and text is not null")
    found = rows.mapInArrow(ship, "bucket int, blob binary").groupBy("bucket").applyInArrow(sort, "doc_id long, mark long, pairs binary")
    return found.groupBy("doc_id", "mark").agg(F.collect_list("pairs").alias("ranges"))  # bounded by the text's length


def removed_words(text: bytes | None, ranges: list[bytes] | None) -> tuple[list[bytes], np.ndarray]:
    """The words of a text and which of them the ranges cover."""
    words = (text or b"").split()  # of bytes: splits at space and 0x09 to 0x0D
    cover = np.zeros(len(words) + 1, np.int64)
    for pairs in ranges or []:
        span = np.frombuffer(pairs, np.int32).reshape(-1, 2)
        np.add.at(cover, span[:, 0], 1)
        np.add.at(cover, span[:, 1], -1)
    return words, np.cumsum(cover)[:-1] > 0


def _joined(marked: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """`marked`: documents with _doc and _mark. Adds _ranges."""
    ranges = repeated_ranges(docs, width).withColumnsRenamed({"doc_id": "_of", "mark": "_as", "ranges": "_ranges"})
    return marked.join(ranges, (F.col("_doc") == F.col("_of")) & (F.col("_mark") == F.col("_as")), "left").drop("_of", "_as", "_mark")


def substring_digest(docs: DataFrame, width: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space, of every document. Texts travel
    to their ranges compressed."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([_checksum(t) for t in texts], pa.int64()), pa.array([squeeze(t) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["_doc", "_mark", "_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            n, gone, digest = [], [], []
            for text, ranges in zip(batch.column("_text"), batch.column("_ranges"), strict=True):
                words, cover = removed_words(expand(text.as_py()), ranges.as_py())
                n.append(len(words))
                gone.append(int(cover.sum()))
                kept = words if not gone[-1] else [w for w, c in zip(words, cover.tolist(), strict=True) if not c]
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    bounded_batches(docs.sparkSession, SHIP_BYTES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).mapInArrow(packed, "_doc long, _mark long, _text binary")
    return _joined(rows, docs, width).select("_doc", "_text", "_ranges").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_substrings(docs: DataFrame, width: int = 13) -> DataFrame:
    """Documents whose text keeps only the words that repeat nothing; a text that repeats nothing stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            texts = []
            for text, ranges in zip(batch.column("_text"), batch.column("_ranges"), strict=True):
                words, cover = removed_words(text.as_py(), ranges.as_py())
                texts.append(b" ".join(w for w, c in zip(words, cover.tolist(), strict=True) if not c).decode("utf-8", "replace") if cover.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "kept"])

    marked = boxed(docs, _text=text_bytes(), _doc=F.col("doc_id").cast("long")).withColumn("_mark", F.crc32(F.coalesce(F.col("_text"), F.lit(b""))))
    rows = _joined(marked, docs, width).select("row", "_text", "_ranges").mapInArrow(run, box_schema(docs, "kept string"))
    return unboxed(rows, docs, text=F.coalesce("kept", "row.text"))
