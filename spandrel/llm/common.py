"""Helpers the operators of this subpackage share: table access, shared storage, vectorised word scanning and hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship

#: Bytes that separate words: space, and 0x09 to 0x0D.
WORD_SPACE = b" \t\n\x0b\x0c\r"
#: Most bytes of one Arrow batch sent to a Python worker, so that very long texts do not make a batch unbounded.
BATCH_BYTES = 4 << 20
#: Bytes of text whose scan's arrays, many times as large, are held at once.
SCAN_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of `sf_dir`, by whatever path Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound the bytes of Arrow batches, so that batches of long texts stay small, and see to it that workers can import
    this package. The operators need that bound when their result is consumed, so the session keeps it."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def _trimmer():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # not glibc
        return lambda _: 0


_trim = _trimmer()


def give_back() -> None:
    """Return memory that this worker's allocators hold but do not use. Workers outlive their tasks, so what one stage
    needed for a moment would else be missing in all later ones."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def thrifty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, with unused memory given back after each."""
    for batch in batches:
        yield batch
        del batch
        give_back()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session that names none gets one of this run's own; on a
    cluster a machine-local folder would lose data, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not is_local(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="spandrel-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def boxed(docs: DataFrame, **extra: Column) -> DataFrame:
    """`row`, the columns of `docs` as one struct, beside columns of our own, whose names then cannot clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in extra.items()))


def unboxed(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of `docs` out of `row`, some of them replaced."""
    return rows.select(*(changed.get(c, F.col("row").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def box_schema(docs: DataFrame, extra: str) -> T.StructType:
    """The schema of `row` and extra columns."""
    return T.StructType([T.StructField("row", docs.schema), *T.StructType.fromDDL(extra).fields])


#: Tables that `store` wrote and nobody has deleted yet, with the configuration of their file system.
STORED: dict[str, object] = {}


def store(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write `df` as a Parquet table in the shared folder and read it back. Survives lost executors.
    Results may read such tables until they are consumed; `cleanup` deletes all of them, and so does the end of the
    driver's Python process."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    STORED[path] = spark.sparkContext._jsc.hadoopConfiguration()
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._stored_at = path
    return made


def _delete(path: str) -> None:
    target = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(STORED.pop(path)).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete a table that `store` returned, once nothing reads it any more."""
    _delete(df._stored_at)


def cleanup(spark: SparkSession | None = None) -> None:
    """Delete every table that this process stored. Call it when results have been written or collected. Each table
    knows its own file system; `spark` need not be given."""
    for path in list(STORED):
        _delete(path)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone first
        cleanup()


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which a deployment sets in proportion to its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(column: str = "text"):
    """The text as bytes: exact for any content, also for what is not valid UTF-8."""
    return F.col(column).cast("binary")


_CODEC = pa.Codec("zstd", compression_level=3)


def squeeze(raw: bytes) -> bytes:
    """Compressed bytes that know their own length, for what must be shuffled."""
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def expand(blob: bytes) -> bytes:
    return _CODEC.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


def slices(texts: list[bytes | None], most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of texts of about `most` bytes (a longer text stands alone); at least one, maybe empty, range."""
    out, begin, total = [], 0, 0
    for i, text in enumerate(texts):
        total += len(text or b"") + 1
        if total >= most:
            out.append((begin, i + 1))
            begin, total = i + 1, 0
    return out + [(begin, len(texts))] if begin < len(texts) or not out else out


_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(0, 1 << 61)) * 8 + 5
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int, kind: str) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, np.uint64(_BASE if kind == "up" else _BASE_INVERSE))
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[kind] = have
    return have[:n]


class Words:
    """The words of a batch of texts, found in one vectorised scan.

    `starts`, `ends`: byte positions in `data`, the texts joined by a line feed. `first`: index of each text's first word,
    with the total at the end. `doc`: the text each word belongs to. `plain`: the words joined by single spaces, where
    word i sits at `at[i]:at[i] + length`. A null text has no words.
    """

    def __init__(self, texts: list[bytes | None], plain: bool = False):
        self.data = np.frombuffer(b"\n".join([t or b"" for t in texts]) + b"\n", np.uint8)
        space = (self.data == 32) | ((self.data >= 9) & (self.data <= 13))
        edge = np.empty(len(space) + 1, bool)
        edge[0] = not space[0]
        np.not_equal(space[1:], space[:-1], out=edge[1:-1])
        edge[-1] = False
        cuts = np.flatnonzero(edge)
        self.starts, self.ends = cuts[0::2], cuts[1::2]
        begins = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t or b"") + 1 for t in texts], out=begins[1:])
        self.begins = begins
        self.first = np.searchsorted(self.starts, begins)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.counts)
        if plain:
            length = self.ends - self.starts
            self.at = np.concatenate(([0], np.cumsum(length + 1)))
            keep = ~space
            keep[self.ends] = True
            self.plain = np.where(space, np.uint8(32), self.data)[keep].tobytes()

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word: differences of a running polynomial sum over random byte values, then mixed."""
        out = np.empty(len(self.starts), np.uint64)
        cuts = np.unique(np.append(np.searchsorted(self.starts, np.arange(0, len(self.data), 1 << 20)), len(out)))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            low, high = int(self.starts[a]), int(self.ends[b - 1])
            run = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_BYTE[self.data[low:high]] * _powers(high - low, "up"), out=run[1:])
            starts, ends = self.starts[a:b] - low, self.ends[a:b] - low
            out[a:b] = (run[ends] - run[starts]) * _powers(high - low, "down")[starts] + (ends - starts).astype(np.uint64)
        return mix(out)
