"""Best-fit packing of tokenised documents into fixed-length training sequences.

Best-fit decreasing is planned on the driver over the histogram of piece lengths, which has at most `capacity` entries
however many documents there are. The plan is a list of runs: "items rank..rank+n-1 of this length go to sequences
s..s+n-1 at this offset". Every piece then finds its slot from its length and its rank within that length.

Defined results: a null text counts as empty (one piece with only the end id); rows with equal or null `doc_id` are
packed like any others, each with its own slots; texts of any length and content are tokenised whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, partitions, store, text_bytes, thrifty

VOCABULARY = "byte_bpe_50k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Bounds the plan: runs beyond it would not be broadcast. A capacity of 1024 yields a few thousand.
MOST_RUNS = 2_000_000
#: White space of more characters in a row is not handed to the merge loop.
LONG_SPACE = 100_000
_LONG_RUN = re.compile(rf"\s{{{LONG_SPACE}}}")


@lru_cache(2)
def encoder(path: str | None):
    """A function from a text to its ids. The byte-level BPE vocabulary of `path` (a `tokenizers` JSON file) is read and
    run by tiktoken's merge loop, which gives the same ids several times faster; special strings in a text become
    their special ids, as is the default of `tokenizers`. White space beyond `LONG_SPACE` characters in a row is more
    than that loop's pattern can look back over: such texts go to `tokenizers` itself."""
    import json

    import public_tokenizers
    import tiktoken
    import tokenizers

    file = str(path or public_tokenizers.path(VOCABULARY))
    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printable)}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(shown[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    own = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    whole: list[tokenizers.Tokenizer] = []  # read when first needed

    def encode(text: str) -> list[int]:
        if len(text) > LONG_SPACE and _LONG_RUN.search(text):
            if not whole:
                whole.append(tokenizers.Tokenizer.from_file(file))
            return whole[0].encode(text, add_special_tokens=False).ids
        return own.encode(text, allowed_special="all")

    return encode


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of `total` ids: only longer ones are cut, the first piece is shorter."""
    if total <= capacity:
        return [(0, total)]
    head = total % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, total, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Tokenise whole texts and cut them. One row per piece; `ids` (little-endian unsigned 32-bit) only if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in thrifty(batches):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array(encode((text.as_py() or b"").decode("utf-8", "replace")) + [end_id], "<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    raw = ids[start : start + n].tobytes()
                    out.append((doc, k, start, n, zlib.crc32(raw), raw if with_ids else None))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, PIECES + ", ids binary" * with_ids)


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over counts: runs (length, rank, count, sequence, offset), and the number of sequences.

    Equal items that face equal bins are placed in one step, so the work depends on the number of lengths, not of items.
    """
    bins: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = min((r for r in bins if r >= length and bins[r]), default=None)
            if room is None:
                room, fresh = capacity, -(-left // (capacity // length))
                bins.setdefault(room, []).append((opened, fresh))
                opened += fresh
            fits = room // length
            first, n = bins[room].pop()
            full = min(n, left // fits)
            taken, each = (full, fits) if full else (1, left)
            for j in range(each):
                runs.append((length, rank, taken, first, capacity - room + j * length))
                rank += taken
            left -= taken * each
            if n > taken:
                bins[room].append((first + taken, n - taken))
            if room - each * length:
                bins.setdefault(room - each * length, []).append((first, taken))
    return np.array(runs, np.int64).reshape(-1, 5), opened


def ranked(cuts: DataFrame) -> DataFrame:
    """Adds `rank`, 0-based and unique within `length`. A length that a third of all pieces share is dealt over many
    buckets, by its content too, as doc_ids may be null or equal: each bucket numbers its own rows and starts where the
    counts of the buckets before it end."""
    n = partitions(cuts.sparkSession)
    dealt = cuts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(n)).cast("int"))
    counts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    return dealt.withColumn("own", own).join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("own") - 1).drop("own", "base", "bucket")


def place(cuts: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds `sequence_id` and `offset` to pieces. `cuts` is read three times, so hand in a stored table."""
    spark = cuts.sparkSession
    histogram = {int(r[0]): int(r[1]) for r in cuts.groupBy("length").count().collect()}  # at most `capacity` rows
    runs, _ = plan(histogram, capacity)
    if len(runs) > MOST_RUNS:
        raise ValueError(f"a plan of {len(runs)} runs is too large to broadcast")
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shared = spark.sparkContext.broadcast(runs)
    rows = ranked(cuts)
    names = [c for c in rows.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        key = (table[:, 0] << 44) + table[:, 1]
        for batch in thrifty(batches):
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 44) + rank, "right") - 1
            slot = [pa.array(table[at, 3] + rank - table[at, 1], pa.int64()), pa.array(table[at, 4], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + slot, [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "rank")
    return rows.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pack every document. One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    Tokenising is stored once in the shared folder, since the histogram, the ranks and the slots all read it.
    """
    cuts = store(pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces")
    order = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset"]
    return place(cuts, capacity).select(order)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (little-endian unsigned 32-bit). Needs `with_ids`."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most `capacity` pieces
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
