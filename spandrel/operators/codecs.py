"""Codecs and their registry.

A codec is an object with metadata and two functions on bytes. Codecs are registered on the driver; the registry becomes
a small DataFrame for routing and scoring, and the codecs themselves travel to Arrow UDFs by their identifier.
"""

from __future__ import annotations

import inspect
import math
import time
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from importlib import metadata as packages
from typing import Protocol, runtime_checkable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wire import DEFLATE_MAGIC

REGISTRY_SCHEMA = "reg_order int, name string, version string, magic string, throughput double, compression_ratio double, description string"


class FrameError(Exception):
    """An error with a kind, as rows carry it."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind, self.message = kind, message


@dataclass(frozen=True)
class CodecInfo:
    """magic: the four identifying bytes, as 8 hex digits. throughput in MB/s, compression_ratio in (0, 1]."""

    name: str
    version: str
    magic: str
    throughput: float
    compression_ratio: float
    description: str = ""


#: Bytes that a codec works on between two looks at whether it should stop.
CHUNK = 64 << 10
#: Raises if work should stop.
Check = Callable[[], None]


def deadline(seconds: float) -> Check:
    """A check that raises once so many seconds have passed; 0 never."""
    end = time.monotonic() + seconds

    def check() -> None:
        if seconds > 0 and time.monotonic() >= end:
            raise FrameError("Timeout", f"Operation timed out after {seconds:g}s")

    return check


def _chunks(data: bytes, check: Check | None) -> Iterable[memoryview]:
    view = memoryview(data)
    for at in range(0, len(view), CHUNK):
        if check:
            check()
        yield view[at : at + CHUNK]


def stoppable(run: Callable[..., bytes]) -> bool:
    """Whether a codec's function takes a check."""
    return "check" in inspect.signature(run).parameters


@runtime_checkable
class Codec(Protocol):
    """What a codec offers. `decompress` may stop once it has `limit` + 1 bytes. Both may take a `check` besides, which
    they call after every `CHUNK` bytes or so, and which raises if they should stop."""

    info: CodecInfo

    def compress(self, data: bytes) -> bytes: ...

    def decompress(self, data: bytes, limit: int) -> bytes: ...

    def detect(self, head: bytes) -> bool: ...


class Deflate:
    """Raw DEFLATE (RFC 1951) at the usual level."""

    info = CodecInfo("deflate", "1.0.0", DEFLATE_MAGIC, 200.0, 0.35, "Standard DEFLATE compression (RFC 1951)")

    def __init__(self, level: int = 6):
        self.level = level

    def compress(self, data: bytes, check: Check | None = None) -> bytes:
        packer = zlib.compressobj(self.level, zlib.DEFLATED, -15)
        return b"".join([*map(packer.compress, _chunks(data, check)), packer.flush()])

    def decompress(self, data: bytes, limit: int, check: Check | None = None) -> bytes:
        opener, out, size = zlib.decompressobj(-15), [], 0
        try:
            for chunk in _chunks(data, check):
                piece: bytes | memoryview = chunk
                while not opener.eof and size <= limit and len(piece):  # a chunk may unpack to very much
                    out.append(opener.decompress(piece, min(limit + 1 - size, 16 * CHUNK)))
                    size += len(out[-1])
                    piece = opener.unconsumed_tail
                    if check and len(piece):
                        check()
                if opener.eof or size > limit:
                    break
            if not opener.eof and size <= limit:
                out.append(opener.flush())
        except zlib.error as e:
            raise FrameError("OperationFailed", f"DEFLATE decompression failed: {e}") from e
        if not opener.eof and size <= limit:
            raise FrameError("OperationFailed", "DEFLATE decompression failed: truncated stream")
        return b"".join(out)

    def detect(self, head: bytes) -> bool:
        return True


def check(info: CodecInfo) -> str | None:
    """Why a codec cannot be registered; None if it can. NaN is rejected too."""
    if not info.name:
        return "Plugin name cannot be empty"
    if not info.version:
        return "Plugin version cannot be empty"
    if not info.throughput > 0:
        return f"Plugin {info.name} has invalid throughput: {info.throughput}"
    if not 0 < info.compression_ratio <= 1:
        return f"Plugin {info.name} has invalid compression ratio: {info.compression_ratio}"
    return None


class Registry:
    """Codecs by identifier, in order of registration. The first codec of an identifier stays."""

    def __init__(self, codecs: Iterable[Codec] = ()):
        self.codecs: dict[str, Codec] = {}
        self.warnings: list[str] = []
        self.ready = False
        self.init(codecs)

    def init(self, codecs: Iterable[Codec]) -> None:
        """Start afresh. The first invalid codec aborts and leaves the registry not ready."""
        self.codecs, self.warnings, self.ready = {}, [], False
        for codec in codecs:
            self.register(codec)
        self.ready = True

    def register(self, codec: Codec) -> None:
        if why := check(codec.info):
            raise FrameError("InvalidCodec", why)
        if held := self.codecs.get(codec.info.magic):
            self.warnings.append(f"Duplicate magic number {codec.info.magic}: '{codec.info.name}' conflicts with '{held.info.name}', which stays")
            return
        self.codecs[codec.info.magic] = codec

    def infos(self) -> list[CodecInfo]:
        return [c.info for c in self.codecs.values()]

    def by_name(self, name: str, any_case: bool = False) -> Codec:
        fold = str.casefold if any_case else str
        for codec in self.codecs.values():
            if fold(codec.info.name) == fold(name):
                return codec
        raise FrameError("NotFound", f"Plugin '{name}' not found")

    def default(self) -> Codec:
        if DEFLATE_MAGIC not in self.codecs:
            raise FrameError("NotFound", "No default codec is registered")
        return self.codecs[DEFLATE_MAGIC]

    def frame(self, spark: SparkSession) -> DataFrame:
        """The registry as rows: a handful, so it is safe to broadcast."""
        rows = [(i, c.name, c.version, c.magic.upper(), float(c.throughput), float(c.compression_ratio), c.description) for i, c in enumerate(self.infos())]
        return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def installed() -> list[Codec]:
    """The built-in codec, and those that installed packages offer under the entry point group `spandrel.codecs`."""
    return [Deflate(), *(e.load()() for e in packages.entry_points(group="spandrel.codecs"))]


_DEFAULT: Registry | None = None


def init_codecs() -> Registry:
    """(Re)build the default registry."""
    global _DEFAULT
    _DEFAULT = Registry(installed())
    return _DEFAULT


def default_registry() -> Registry:
    return _DEFAULT or init_codecs()


#: Spark holds less than this many bytes in one value.
MOST_BYTES = (1 << 31) - 1 - 64


def encode(codec: Codec, data: Column, seconds: float = 0.0) -> Column:
    """A payload column through a codec. Null gives null. A payload that takes more than `seconds` fails the job with an
    error of kind Timeout; 0 is without end."""

    def pack(value: bytes) -> bytes:
        return codec.compress(value, check=deadline(seconds)) if seconds > 0 and stoppable(codec.compress) else codec.compress(value)

    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else pack(v) for v in values.to_pylist()], pa.binary())

    return run(data)


def decode(registry: Registry, magic: Column, payload: Column, size: Column) -> Column:
    """struct<data, kind, message> of payloads through the codec their identifier names; a null payload gives null.

    Rows that failed before hand in null, since a UDF inside CASE runs on every row. A claimed size bounds the output.
    """
    codecs = {k.upper(): c for k, c in registry.codecs.items()}

    @F.arrow_udf("struct<data: binary, kind: string, message: string>")
    def run(magics: pa.Array, payloads: pa.Array, sizes: pa.Array) -> pa.Array:
        rows = []
        for key, value, claimed in zip(magics.to_pylist(), payloads.to_pylist(), sizes.to_pylist(), strict=True):
            row = {"data": None, "kind": None, "message": None}
            if value is not None:
                try:
                    row["data"] = codecs[key].decompress(value, min(int(claimed), MOST_BYTES))
                except FrameError as e:
                    row |= {"kind": e.kind, "message": e.message}
                except Exception as e:  # a codec of another package may fail in its own ways
                    row |= {"kind": "OperationFailed", "message": f"{type(e).__name__}: {e}"}
            rows.append(row)
        return pa.array(rows, pa.struct([("data", pa.binary()), ("kind", pa.string()), ("message", pa.string())]))

    return run(magic, payload, size)


def scores(infos: list[CodecInfo], weights: tuple[float, float]) -> dict[str, float]:
    """Driver-side scores of a registry, for choosing one codec for a whole job (`selection.scored` is the SQL form)."""
    if len(infos) < 2:
        return {i.name: 1.0 for i in infos}
    speed, size = [math.log(i.throughput) for i in infos], [i.compression_ratio for i in infos]

    def scale(x: float, low: float, high: float) -> float:
        return 1.0 if high - low < 1e-9 else (x - low) / (high - low)

    return {i.name: weights[0] * scale(s, min(speed), max(speed)) + weights[1] * scale(-r, -max(size), -min(size)) for i, s, r in zip(infos, speed, size, strict=True)}


def choose(registry: Registry, weights: tuple[float, float], name: str | None = None) -> Codec:
    """The codec of a name, or the best score; of equals the first by name."""
    if name is not None:
        return registry.by_name(name)
    if not registry.codecs:
        raise FrameError("NotFound", "No codecs are registered")
    found = scores(registry.infos(), weights)
    return registry.by_name(min(found, key=lambda n: (-found[n], n)))


#: What codecs are tested on.
SELF_TEST = "A codec must give back exactly what it was given: 0123456789, abc, ABC, and a repeated, repeated, repeated word."
