"""Near-duplicate detection: circulant MinHash banding, then exact Jaccard confirmation on full shingle sets.

Signatures come from two permutations of the 32-bit universe only: sigma scatters a set's elements once, and coordinate k
is the smallest pi(sigma(x) - k), pi under a circular shift by k. 48 bands of 6 coordinates miss a pair of similarity
0.8 with a probability of 5e-7, one of 0.85 with 1.4e-10.

Documents with equal sets collapse to one class first, so copies never meet. Bands link each class to the band's
smallest one; the components of these unconfirmed links hold every pair that shares a band. Inside a component a
breadth-first search over full sets confirms links: a class leaves the search once reached, so a group of near copies
costs about one comparison per member rather than all pairs, and only a spanning forest of links leaves the task. A
component beyond `BLOCK_SHINGLES` or `BLOCK_SETS` is dealt into blocks: part of one is searched with each other block,
and then only what that did not join to the largest component is searched with all sets of sizes that it could link to.

Defined results: a null or wordless text has an empty set and links with nothing; fewer words than a shingle give one
shingle, the whole sequence; rows of one `doc_id` count as the same document and share its component; a null `doc_id`
links with nothing, has a null component and is kept; texts are scanned whole, in slices, of which one longer than a
slice is one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SCAN_BYTES, Words, bounded_batches, boxed, discard, expand, mix, slices, squeeze, store, text_bytes, thrifty, unboxed
from .components import components, salted_join, split_join

BANDS, ROWS = 48, 6
BLOCK_SHINGLES, BLOCK_SETS = 1_000_000, 512
#: One set in so many of a cluster's first block is searched with all its other blocks.
HUB = 4
#: Candidates of a broadcast: two longs each. More travel to the texts by a shuffle.
BROADCAST_NODES = 1_000_000
_GOLD = 0x9E3779B97F4A7C15


def shingle_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (64 bits) of each text, A-Z lower-cased."""
    return [s for a, b in slices(texts, SCAN_BYTES) for s in _shingle_sets(texts[a:b], words)]


def _shingle_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    scan = Words([t.lower() if t else t for t in texts])
    h = scan.hashes()
    grams = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for j in range(words):
        grams = grams * np.uint64(_GOLD) + h[j : j + len(grams)]
    grams = mix(grams)
    out = []
    for a, b in zip(scan.first[:-1].tolist(), scan.first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        else:
            whole = 0
            for x in h[a:b].tolist():
                whole = (whole * _GOLD + x) % (1 << 64)
            out.append(np.array([whole ^ (b - a)][: b > a], np.uint64))
    return out


def _permute(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit universe."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash signatures of non-empty sets, a row each."""
    out = np.empty((len(sets), coordinates), np.uint32)
    sizes = np.array([len(s) for s in sets])
    chunk = np.concatenate(([0], np.cumsum(sizes)))[:-1] >> 17  # runs of about 131,072 elements stay in cache
    for part in np.split(np.arange(len(sets)), np.flatnonzero(np.diff(chunk)) + 1):
        if not len(part):
            continue
        own = [sets[i] for i in part]
        begins = np.concatenate(([0], np.cumsum(sizes[part])[:-1]))
        sigma = _permute((mix(np.concatenate(own)) >> np.uint64(32)).astype(np.uint32))
        for k in range(coordinates):
            out[part, k] = np.minimum.reduceat(_permute(sigma - np.uint32(k)), begins)
    return out


def bands(sets: list[np.ndarray], n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band keys (64 bits) of non-empty sets, a row each."""
    sig = signatures(sets, n_bands * rows).reshape(len(sets), n_bands, rows).astype(np.uint64)
    key = np.zeros(sig.shape[:2], np.uint64) + np.arange(n_bands, dtype=np.uint64)
    for j in range(rows):
        key = mix(key * np.uint64(_GOLD) + sig[:, :, j])
    return key


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, 128-bit set key, and the band keys on the first row of a set in each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            raw = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            first: dict[bytes, int] = {}
            for i, key in enumerate(raw):
                if key:
                    first.setdefault(key, i)
            shown: list[bytes | None] = [None] * len(sets)
            if first:
                at = list(first.values())
                for i, row in zip(at, bands([sets[i] for i in at]), strict=True):
                    shown[i] = row.tobytes()
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(raw, pa.binary()), pa.array(shown, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_key", "bands"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands binary")


def _candidates(classes: DataFrame) -> DataFrame:
    """Each class linked to the smallest class of each of its bands: as many links as band rows, at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            rep = np.repeat(batch.column("rep").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(rep)], ["band", "rep"])

    rows = classes.select("rep", "bands").mapInArrow(run, "band long, rep long")
    low = rows.groupBy("band").agg(F.min("rep").alias("v"), F.max("rep").alias("high")).filter("v <> high").select("band", "v")
    return salted_join(rows, low, ["band"], "rep").filter("rep <> v").select(F.col("rep").alias("u"), "v")


def linked(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links 100 * |intersection| >= percent * |union|: breadth-first, over full sets."""
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes = codes.astype(np.int32)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    mark = np.zeros(int(codes.max()) + 1, np.int32)
    waiting, out = np.arange(len(sets)), []
    flat, starts = codes, begins
    queue: list[int] = []
    since = len(waiting)
    while len(waiting):
        if not queue:
            queue.append(int(waiting[0]))
            waiting = waiting[1:]
            if not len(waiting):
                break
        if len(waiting) < since // 2 or since == len(sets):  # gather the rest anew, at each halving
            held, since = waiting, len(waiting)
            flat = np.concatenate([codes[begins[i] : ends[i]] for i in held])
            starts = np.concatenate(([0], np.cumsum(sizes[held])[:-1]))
        at = queue.pop()
        own = codes[begins[at] : ends[at]]
        mark[own] = 1
        common = np.add.reduceat(mark[flat], starts)
        mark[own] = 0
        alive = np.zeros(len(sets), bool)
        alive[waiting] = True
        near = held[alive[held] & ((100 * common >= percent * (sizes[held] + len(own) - common)) | (nodes[held] == nodes[at]))]
        if len(near):
            out += [(int(nodes[at]), int(nodes[i])) for i in near]
            queue += near.tolist()
            alive[near] = False
            waiting = waiting[alive[waiting]]
    return out


def _members(docs: DataFrame, clusters: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """The shingle sets of the classes that have candidates: node, cluster, blocks (of the cluster), n, shingles (uint64).
    Few enough candidates are broadcast, and no text travels. More than that meet the texts, compressed, in a hash join of
    which the candidates are the side that is hashed: no text is sorted. Blocks are counted before there are sets, so that
    sets need not travel to their counts."""

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            texts = [squeeze(t or b"") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["node", "_text"])

    def sets(opened: Callable[[bytes], bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in thrifty(batches):
                found = shingle_sets([opened(t or b"") for t in batch.column("_text").to_pylist()], words)
                columns = [batch.column("node"), batch.column("root"), batch.column("blocks"), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "cluster", "blocks", "n", "shingles"])

        return run

    made = "node long, cluster long, blocks int, n long, shingles binary"
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), text_bytes().alias("_text"))
    nodes = clusters.select("node", "root").unionByName(clusters.select(F.col("root").alias("node"), "root").distinct())
    sized = nodes.join(classes.groupBy(F.col("rep").alias("node")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sets")), "node")
    blocks = sized.groupBy("root").agg(F.sum("n").alias("n"), F.sum("sets").alias("sets")).select("root", _count_blocks("n", "sets").alias("blocks"))
    known = store(salted_join(nodes, blocks, ["root"], "node").select("node", "root", "blocks"), "candidates")
    if known.count() <= BROADCAST_NODES:
        out = texts.join(F.broadcast(known), "node").select("node", "root", "blocks", "_text").mapInArrow(sets(lambda t: t), made)
    else:
        out = texts.mapInArrow(squeezed, "node long, _text binary").join(known.hint("shuffle_hash"), "node").select("node", "root", "blocks", "_text").mapInArrow(sets(expand), made)
    members = store(out.filter("n > 0"), "members")
    discard(known)
    return members


def _count_blocks(n: str, sets: str) -> Column:
    return F.greatest(F.ceil(F.col(n) / BLOCK_SHINGLES), F.ceil(F.col(sets) / BLOCK_SETS)).cast("int")


def _dealt(parts: str, *seed: int) -> Column:
    return F.pmod(F.xxhash64("node", *map(F.lit, seed)), F.col(parts)).cast("int")


def _all_of(parts: str) -> Column:
    return F.sequence(F.lit(0), F.col(parts) - 1)


def _search(rows: DataFrame, percent: int, *keys: str) -> DataFrame:
    """The links inside each group of node, shingles."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("node").to_numpy(), kind="stable")
        raw = table.column("shingles")
        sets = [np.frombuffer(raw[int(i)].as_buffer(), np.uint64) for i in order]  # views, not copies
        pairs = linked(table.column("node").to_numpy()[order], sets, percent) if len(order) > 1 else []
        u, v = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return rows.select(*keys, "node", "shingles").groupBy(*keys).applyInArrow(run, "u long, v long")


def _unsettled(sized: DataFrame, first: DataFrame) -> DataFrame:
    """The rows of `sized` outside the largest component, by the links `first`, of their clusters. Stored."""
    joined = components(first)
    labels = sized.join(joined, "node", "left").withColumn("label", F.coalesce("root", "node"))
    most = labels.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("size")).groupBy("cluster").agg(F.max_by("label", F.struct("size", "label")).alias("most"))
    rest = store(salted_join(labels, most, ["cluster"], "node").filter("label <> most").select("cluster", "node", "n", "bin"), "unsettled")
    discard(joined)
    return rest


def _second_plan(sized: DataFrame, rest: DataFrame) -> DataFrame:
    """Where sets go in the second search: node, n, cluster, bin, part, chunk. Every set of a bin that unsettled sets can
    link to stays in its part of it; an unsettled set goes to all parts of its own bin and of the next ones. Stored."""
    bins = sized.groupBy("cluster", "bin").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("sets")).select("cluster", "bin", _count_blocks("total", "sets").alias("parts"))
    reach = rest.withColumnRenamed("bin", "home").withColumn("bin", F.explode(F.array(*(F.col("home") + k for k in (-1, 0, 1)))))
    chunks = reach.groupBy("cluster", "bin").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("sets")).select("cluster", "bin", _count_blocks("total", "sets").alias("chunks"))
    grid = store(bins.join(chunks, ["cluster", "bin"]), "bins")
    at = ["cluster", "bin"]
    whole = salted_join(sized, grid, at, "node").withColumn("part", _dealt("parts")).withColumn("chunk", F.explode(_all_of("chunks")))
    others = F.when(F.col("bin") == F.col("home"), F.array_remove(_all_of("parts"), _dealt("parts"))).otherwise(_all_of("parts"))
    loose = salted_join(reach, grid, at, "node").withColumn("chunk", _dealt("chunks", 1)).withColumn("part", F.explode(others))
    columns = ["node", "n", *at, "part", "chunk"]
    plan = store(whole.select(columns).unionByName(loose.select(columns)), "second-search")
    discard(grid)
    return plan


def _confirmed(members: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The links that full sets confirm, as spanning forests, and the stored tables that they read.

    A cluster of several blocks is searched twice. First each block with a part of block 0, which joins most of a group of
    near copies; then what is left outside the cluster's largest component with every set of a size that it can link to.
    Two texts that both are in that component are connected already, any other pair meets in the second search: linked
    sets differ in size by a factor of 100 / percent at most, so they are in the same bin of sizes or in adjacent ones.
    Everything but the searches themselves works on rows without sets.
    """
    own = _dealt("blocks")
    to_all = (own == 0) & (F.pmod(F.xxhash64("node", F.lit(2)), F.lit(HUB)) == 0)
    block = F.when(F.col("blocks") == 2, F.array(F.lit(0))).when(to_all, _all_of("blocks")).otherwise(F.array(own))
    first = store(_search(members.withColumn("block", F.explode(block)), percent, "cluster", "block"), "confirmed")
    large = members.filter("blocks > 2")  # two blocks were searched as one
    step = math.log(1.01 * 100 / percent)  # a little wide, so that rounding cannot part linked sizes by two bins
    sized = large.select("cluster", "node", "n", F.floor(F.log("n") / step).cast("int").alias("bin")).distinct()
    if sized.isEmpty():
        return first, [first]
    sized = store(sized, "sized")
    rest = _unsettled(sized, first)
    plan = _second_plan(sized, rest)
    for table in (sized, rest):
        discard(table)
    second = _search(large.select("node", "n", "shingles").join(plan, ["node", "n"]), percent, "cluster", "bin", "part", "chunk")
    return first.unionByName(second), [first, plan]


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept, of every document."""
    signed = store(_signed(docs, words), "signed")
    known = signed.filter("doc_id is not null and set_key is not null")
    classes = store(known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("bands").alias("bands"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies")), "classes")
    clusters = components(_candidates(classes))
    members = _members(docs, clusters, classes, words)
    discard(clusters)
    confirmed, read = _confirmed(members, percent)
    rows = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    own = known.join(rows, "doc_id").select("doc_id", "set_key").join(classes.select("set_key", "rep"), "set_key").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    found = components(confirmed.unionByName(own))
    for table in (members, *read):
        discard(table)
    roots = classes.join(found, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("root", "rep").alias("component_id"), F.col("copies").alias("_n"))
    out = signed.select("doc_id", "n_shingles", "set_key")
    alone = out.filter("doc_id is null or set_key is null").withColumn("component_id", F.col("doc_id"))
    out = split_join(out.filter("doc_id is not null and set_key is not null"), roots, ["set_key"]).unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents less all but one (the smallest doc_id) of each component; columns as they came."""
    gone = near_duplicates(docs, words, percent).filter("not kept").select(F.col("doc_id").alias("gone")).distinct()
    rows = boxed(docs, own=F.col("doc_id").cast("long"))
    kept = rows.filter("own is not null").join(gone, F.col("own") == F.col("gone"), "left_anti")
    return unboxed(kept.unionByName(rows.filter("own is null")), docs)
