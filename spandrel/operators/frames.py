"""Frames as DataFrame transforms: compress, inspect and decompress.

Each adds columns and keeps the others. Errors are rows, not exceptions: `error_kind` and `error_message` name the first
check that failed, in the order in which a reader meets them. Only the codec itself needs a Python worker; inspection
has no Python node at all, and a plan that does not use the content never decodes it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wire
from ..functions.report import LEVELS
from .codecs import MOST_BYTES, SELF_TEST, FrameError, Registry, choose, decode, default_registry, encode


def weights(throughput: float, compression_ratio: float) -> tuple[float, float]:
    """Checked scoring weights: not negative, adding up to 1. NaN is rejected too."""
    if throughput < 0 or compression_ratio < 0:
        raise FrameError("InvalidWeights", "Weights cannot be negative")
    if not abs(throughput + compression_ratio - 1) <= 1e-6:
        raise FrameError("InvalidWeights", f"Weights must sum to 1.0, got {throughput + compression_ratio}")
    return throughput, compression_ratio


class Cancellable(Protocol):
    """What options need of a token: `control.Token` is one."""

    def check(self) -> None: ...


@dataclass(frozen=True)
class Options:
    """How to compress. plugin: a codec's name, else the weights choose. mtime, permissions: columns to store. timeout:
    seconds that one payload may take, and an action that `control.perform` runs. token: asks to stop; `compress` looks at
    it, and so does `control.perform` while its action runs."""

    plugin: str | None = None
    weights: tuple[float, float] = LEVELS["library"]
    timeout: float = 0.0
    mtime: str | None = None
    permissions: str | None = None
    token: Cancellable | None = None

    def with_plugin(self, name: str) -> Options:
        return replace(self, plugin=name)

    def with_weights(self, throughput: float, compression_ratio: float) -> Options:
        return replace(self, weights=weights(throughput, compression_ratio))

    def with_timeout(self, seconds: float) -> Options:
        """Seconds that a payload, or an action, may take; 0 is without end."""
        return replace(self, timeout=seconds)

    def with_cancel_token(self, token: Cancellable) -> Options:
        return replace(self, token=token)

    def with_file_metadata(self, mtime: str | None = "mtime", permissions: str | None = "permissions") -> Options:
        return replace(self, mtime=mtime, permissions=permissions)


def compress(df: DataFrame, data: str = "data", frame: str = "frame", options: Options | None = None, registry: Registry | None = None) -> DataFrame:
    """Adds `frame`. Without options the default codec is taken, without any selection. Null data gives a null frame."""
    registry = registry or default_registry()
    codec = registry.default() if options is None else choose(registry, options.weights, options.plugin)
    options = options or Options()
    if options.token:
        options.token.check()
    packed = df.withColumn("_payload", encode(codec, F.col(data), options.timeout))
    attribute = lambda name: F.col(name).cast("long") if name else None
    made = wire.assemble(F.col("_payload"), F.octet_length(data), attribute(options.mtime), attribute(options.permissions), codec.info.magic)
    return packed.withColumn(frame, made).drop("_payload")


def _parsed(df: DataFrame, frame: str) -> DataFrame:
    """The parts of a frame, null where a frame is too short to hold them. Staged, so that each is computed once."""
    f, n = F.col(frame), F.col("_n")
    df = df.withColumn("_n", F.octet_length(f))
    crc, meta = wire.has_crc(f), wire.has_metadata(f)
    df = df.withColumn("_crc", F.coalesce(crc, F.lit(False))).withColumn("_meta", F.coalesce(meta, F.lit(False)))
    df = df.withColumn("_at", F.when(F.col("_crc"), F.lit(wire.HEADER_SIZE + 4)).otherwise(F.lit(wire.HEADER_SIZE)))
    checked = F.col("_crc") & (n >= wire.HEADER_SIZE + 4)
    df = df.withColumn("_stored", F.when(checked, wire.unsigned(f.substr(F.lit(17), F.lit(4)), 4)))
    df = df.withColumn("_computed", F.when(checked, F.crc32(f.substr(F.lit(21), n))))
    df = df.withColumn("_length", F.when(F.col("_meta"), wire.unsigned(f.substr(F.col("_at") + 1, F.lit(2)), 2).cast("int")))
    whole = F.col("_meta") & (n >= F.col("_at") + 2 + F.col("_length"))
    df = df.withColumn("_attributes", wire.read_attributes(F.when(whole, f.substr(F.col("_at") + 3, F.col("_length"))).otherwise(F.lit(b""))))
    return df.withColumn("_magic", F.when(n >= 4, wire.magic(f)))


def _routed(df: DataFrame, registry: Registry) -> DataFrame:
    """The codec's name by identifier: a left join with the broadcast registry, a few rows."""
    codecs = registry.frame(df.sparkSession).select(F.col("magic").alias("_known"), F.col("name").alias("_name"))
    return df.join(F.broadcast(codecs), F.col("_magic") == F.col("_known"), "left").drop("_known")


def _hex8(number: Column) -> Column:
    return F.lower(F.lpad(F.hex(number), 8, "0"))


def _bytes_text(digits: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.regexp_extract_all(digits, F.lit("(..)")), ", "), F.lit("]"))


def _error(frame: str, strict: bool, available: str) -> Column:
    """struct<kind, message> of the first check that fails, null without one. strict: a wrong checksum is an error."""
    f, n = F.col(frame), F.col("_n")
    err = lambda kind, message: F.struct(F.lit(kind).alias("kind"), (F.lit(message) if isinstance(message, str) else message).alias("message"))
    after = F.col("_at") + F.when(F.col("_meta"), 2).otherwise(0)
    out = F.when(f.isNull(), F.lit(None))
    out = out.when(n < wire.HEADER_SIZE, err("InvalidHeader", F.format_string("Invalid header format: Input too short: %s bytes, expected at least 16", n.cast("string"))))
    out = out.when(~wire.has_prefix(f), err("InvalidMagic", F.concat(F.lit("Invalid magic number: "), _bytes_text(F.col("_magic")))))
    out = out.when(~wire.has_version(f), err("InvalidHeader", "Invalid header format: unsupported version"))
    out = out.when(F.col("_crc") & (n < wire.HEADER_SIZE + 4), err("InvalidHeader", "Invalid header format: Truncated: CRC32 flag set but no CRC32 data"))
    if strict:
        differ = F.col("_stored") != F.col("_computed")
        out = out.when(differ, err("CrcMismatch", F.concat(F.lit("CRC32 mismatch: expected "), _hex8(F.col("_stored")), F.lit(", got "), _hex8(F.col("_computed")))))
    out = out.when(F.col("_meta") & (n < after), err("InvalidHeader", "Invalid header format: Truncated: metadata flag set but no metadata length"))
    out = out.when(F.col("_meta") & (n < after + F.col("_length")), err("InvalidHeader", "Invalid header format: Truncated: metadata length exceeds payload size"))
    out = out.when(F.col("_attributes.error").isNotNull(), err("InvalidMetadata", F.concat(F.lit("Invalid metadata format: "), F.col("_attributes.error"))))
    missing = F.concat(F.lit("No plugin found for magic number "), _bytes_text(F.col("_magic")), F.lit(available))
    return out.when(F.col("_name").isNull(), err("NotFound", missing))


def _own(df: DataFrame) -> DataFrame:
    return df.drop("_n", "_crc", "_meta", "_at", "_stored", "_computed", "_length", "_attributes", "_magic", "_name", "_error", "_decoded", "_size")


def inspect(df: DataFrame, frame: str = "frame", registry: Registry | None = None) -> DataFrame:
    """Adds original_size (DECIMAL(20,0)), compressed_size, plugin_name, crc_valid, mtime, permissions, error_kind and
    error_message. A wrong or missing checksum is not an error but crc_valid = false. Never decodes the payload."""
    df = _routed(_parsed(df, frame), registry or default_registry()).withColumn("_error", _error(frame, False, ""))
    good = F.col("_error").isNull() & F.col(frame).isNotNull()
    return _own(
        df.withColumns({
            "original_size": F.when(good, wire.original_size(F.col(frame))),
            "compressed_size": F.when(good, F.col("_n").cast("long")),
            "plugin_name": F.when(good, F.col("_name")),
            "crc_valid": F.when(good, F.coalesce(F.col("_stored") == F.col("_computed"), F.lit(False))),
            "mtime": F.when(good, F.col("_attributes.mtime")),
            "permissions": F.when(good, F.col("_attributes.permissions")),
            "error_kind": F.col("_error.kind"),
            "error_message": F.col("_error.message"),
        })
    )


def decompress(df: DataFrame, frame: str = "frame", data: str = "data", registry: Registry | None = None) -> DataFrame:
    """Adds `data`, mtime, permissions, error_kind and error_message. Frames that fail a check are never decoded."""
    registry = registry or default_registry()
    names = ", ".join(sorted(i.name for i in registry.infos()))
    df = _routed(_parsed(df, frame), registry).withColumn("_error", _error(frame, True, f". Available plugins: {names}"))
    f = F.col(frame)
    start = F.col("_at") + F.when(F.col("_meta"), F.col("_length") + 2).otherwise(0)
    payload = F.when(F.col("_error").isNull(), f.substr(start + 1, F.col("_n")))
    df = df.withColumn("_size", wire.original_size(f))
    claimed = F.least(F.col("_size"), F.lit(MOST_BYTES)).cast("long")
    df = df.withColumn("_decoded", decode(registry, F.col("_magic"), payload, claimed))
    got = F.octet_length("_decoded.data")
    err = lambda kind, message: F.struct(F.lit(kind).alias("kind"), message.alias("message"))
    late = (
        F.when(F.col("_error").isNotNull(), F.col("_error"))
        .when(F.col("_decoded.kind").isNotNull(), F.struct(F.col("_decoded.kind").alias("kind"), F.col("_decoded.message").alias("message")))
        .when(F.col("_size") > MOST_BYTES, err("InvalidHeader", F.lit("Invalid header format: Original size exceeds platform limits")))
        .when(got != F.col("_size"), err("CorruptedData", F.format_string("Corrupted data: Size mismatch: header says %s bytes, got %s bytes", F.col("_size").cast("string"), F.when(got > F.col("_size"), F.lit("more")).otherwise(got.cast("string")))))
    )
    df = df.withColumn("_error", late)
    good = F.col("_error").isNull()
    return _own(
        df.withColumns({
            data: F.when(good, F.col("_decoded.data")),
            "mtime": F.when(good, F.col("_attributes.mtime")),
            "permissions": F.when(good, F.col("_attributes.permissions")),
            "error_kind": F.col("_error.kind"),
            "error_message": F.col("_error.message"),
        })
    )


def fail_fast(df: DataFrame) -> DataFrame:
    """Fails the job at the first row with an error, before anything is written."""
    return df.filter(F.when(F.col("error_kind").isNotNull(), F.raise_error(F.concat_ws(": ", "error_kind", "error_message")).cast("boolean")).otherwise(F.lit(True)))



def self_test(spark: SparkSession, registry: Registry | None = None) -> DataFrame:
    """Every codec on a fixed text, forth and back: name, original_size, passed."""
    registry = registry or default_registry()
    out: DataFrame | None = None
    for info in registry.infos():
        rows = spark.createDataFrame([(info.name, bytearray(SELF_TEST, "utf-8"))], "name string, before binary")
        back = decompress(compress(rows, data="before", options=Options(plugin=info.name), registry=registry), registry=registry)
        tested = back.select("name", F.octet_length("before").cast("long").alias("original_size"), F.col("data").eqNullSafe(F.col("before")).alias("passed"))
        out = out.unionAll(tested) if out else tested
    return out if out is not None else spark.createDataFrame([], "name string, original_size long, passed boolean")
