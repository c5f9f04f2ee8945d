"""The frame layout as column expressions: header, checksum and attribute records.

A frame is a 16-byte header, a CRC-32 of everything after it (if flag bit 0), attribute records with a length (if bit 1)
and the codec's payload. Numbers are little-endian. Nothing here needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format.
PREFIX = bytes([0x43, 0x52])
VERSION = 1
HEADER_SIZE = 16
FLAG_CRC, FLAG_METADATA = 1, 2
TAG_MTIME, TAG_PERMISSIONS = 1, 2
DEFLATE_MAGIC = "43520100"


def _swap(digits: Column, width: int) -> Column:
    """Hex digits of `width` bytes in the opposite byte order."""
    return F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in range(width - 1, -1, -1)))


def le(number: Column, width: int) -> Column:
    """A long as `width` little-endian bytes (two's complement)."""
    digits = F.lpad(F.hex(number.cast("long")), 16, "0")
    return F.unhex(_swap(F.substring(digits, 17 - 2 * width, 2 * width), width))


def unsigned(raw: Column, width: int) -> Column:
    """Little-endian bytes as a number: DECIMAL(20,0) for 8 bytes, BIGINT below. Missing bytes give null."""
    digits = F.conv(_swap(F.hex(raw), width), 16, 10)
    return F.when(F.octet_length(raw) == width, digits.cast("decimal(20,0)") if width == 8 else digits.cast("long"))


def signed(raw: Column) -> Column:
    """Eight little-endian bytes as a signed BIGINT."""
    return F.when(F.octet_length(raw) == 8, F.conv(_swap(F.hex(raw), 8), 16, -10).cast("long"))


def header(original_size: Column, flags: Column | int, magic: Column | str = DEFLATE_MAGIC) -> Column:
    """The 16 header bytes. magic: 8 hex digits."""
    magic = F.lit(magic) if isinstance(magic, str) else magic
    flags = F.lit(flags) if isinstance(flags, int) else flags
    return F.concat(F.unhex(magic), le(original_size, 8), le(flags, 1), F.unhex(F.lit("000000")))


def with_crc(flags: Column) -> Column:
    return flags.bitwiseOR(F.lit(FLAG_CRC))


def with_metadata(flags: Column) -> Column:
    return flags.bitwiseOR(F.lit(FLAG_METADATA))


def magic(frame: Column) -> Column:
    """The codec identifier, as 8 hex digits."""
    return F.hex(F.substring(frame, 1, 4))


def has_prefix(frame: Column) -> Column:
    return F.substring(frame, 1, 2) == F.lit(PREFIX)


def has_version(frame: Column) -> Column:
    return F.substring(frame, 3, 1) == F.lit(bytes([VERSION]))


def codec_id(frame: Column) -> Column:
    return unsigned(F.substring(frame, 4, 1), 1).cast("int")


def original_size(frame: Column) -> Column:
    return unsigned(F.substring(frame, 5, 8), 8)


def flags(frame: Column) -> Column:
    return unsigned(F.substring(frame, 13, 1), 1).cast("int")


def has_crc(frame: Column) -> Column:
    return flags(frame).bitwiseAND(F.lit(FLAG_CRC)) != 0


def has_metadata(frame: Column) -> Column:
    return flags(frame).bitwiseAND(F.lit(FLAG_METADATA)) != 0


def attributes(mtime: Column, permissions: Column) -> Column:
    """The attribute records of two nullable numbers: empty where both are null."""
    none = F.lit(b"")
    first = F.coalesce(F.concat(F.unhex(F.lit("0108")), le(mtime, 8)), none)
    second = F.coalesce(F.concat(F.unhex(F.lit("0204")), le(permissions, 4)), none)
    return F.concat(first, second)


def read_attributes(raw: Column) -> Column:
    """Attribute records as struct<mtime, permissions, error>. Unknown tags are skipped, of repeated ones the last counts,
    and reading stops at the first error. A fold over the records: a step for each, and none once the end is reached."""
    size = F.octet_length(raw)
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(size / 2).cast("int")))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("long").alias("mtime"), F.lit(None).cast("long").alias("permissions"), F.lit(None).cast("string").alias("error"))

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        tag = unsigned(raw.substr(at + 1, F.lit(1)), 1)
        length = unsigned(raw.substr(at + 2, F.lit(1)), 1).cast("int")
        value = raw.substr(at + 3, length)
        error = (
            F.when(at + 2 > size, F.lit("Incomplete TLV record"))
            .when(at + 2 + length > size, F.lit("Incomplete TLV value"))
            .when((tag == TAG_MTIME) & (length != 8), F.lit("Invalid mtime length"))
            .when((tag == TAG_PERMISSIONS) & (length != 4), F.lit("Invalid permissions length"))
        )
        after = F.struct(
            (at + 2 + length).alias("at"),
            F.when(tag == TAG_MTIME, signed(value)).otherwise(state["mtime"]).alias("mtime"),
            F.when(tag == TAG_PERMISSIONS, unsigned(value, 4)).otherwise(state["permissions"]).alias("permissions"),
            error.alias("error"),
        )
        over = state["error"].isNotNull() | (at >= size)
        failed = F.struct(at.alias("at"), state["mtime"].alias("mtime"), state["permissions"].alias("permissions"), error.alias("error"))
        return F.when(over, state).when(error.isNotNull(), failed).otherwise(after)

    return F.aggregate(steps, start, step, lambda s: F.struct(s["mtime"].alias("mtime"), s["permissions"].alias("permissions"), s["error"].alias("error")))


def assemble(payload: Column, size: Column, mtime: Column | None = None, permissions: Column | None = None, codec: Column | str = DEFLATE_MAGIC) -> Column:
    """A frame around a codec's payload: always with a checksum, with attributes where any is given."""
    none = F.lit(None).cast("long")
    records = attributes(none if mtime is None else mtime, none if permissions is None else permissions)
    some = F.octet_length(records) > 0
    body = F.when(some, F.concat(le(F.octet_length(records), 2), records, payload)).otherwise(payload)
    bits = F.when(some, F.lit(FLAG_CRC | FLAG_METADATA)).otherwise(F.lit(FLAG_CRC))
    return F.concat(header(size, bits, codec), le(F.crc32(body), 4), body)
