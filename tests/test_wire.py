"""The frame layout, against byte-exact vectors and an independent writer."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from spandrel.functions import wire


def frame(data, mtime=None, permissions=None, codec=0, payload=None, crc=True):
    """A frame written without Spark."""
    tlv = (b"\x01\x08" + struct.pack("<q", mtime) if mtime is not None else b"") + (b"\x02\x04" + struct.pack("<I", permissions) if permissions is not None else b"")
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = (struct.pack("<H", len(tlv)) + tlv if tlv else b"") + (packer.compress(data) + packer.flush() if payload is None else payload)
    flags = (1 if crc else 0) | (2 if tlv else 0)
    return b"CR\x01" + bytes([codec]) + struct.pack("<QB3x", len(data), flags) + (struct.pack("<I", zlib.crc32(body)) if crc else b"") + body


@pytest.mark.parametrize("flags, text", [(0, "43520100393000000000000000000000"), (3, "43520100393000000000000003000000")])
def test_header(spark, flags, text):
    assert spark.range(1).select(F.hex(wire.header(F.lit(12345), flags))).first()[0] == text


def test_numbers(spark):
    rows = spark.createDataFrame([(0,), (1,), (255,), (1 << 40,), (-5,), ((1 << 63) - 1,)], "n long")
    for n, raw, back in rows.select("n", wire.le(F.col("n"), 8), wire.signed(wire.le(F.col("n"), 8))).collect():
        assert bytes(raw) == struct.pack("<q", n) and back == n
    top = spark.range(1).select(wire.unsigned(F.lit(b"\xff" * 8), 8), wire.unsigned(F.lit(b"\xff"), 4), wire.unsigned(F.lit(b"\x01\x02"), 2)).first()
    assert int(top[0]) == (1 << 64) - 1 and top[1] is None and top[2] == 513


def test_attributes(spark):
    rows = spark.createDataFrame([(1234567890, 0o644), (-5, None), (None, 7), (None, None)], "m long, p long")
    got = [r[0] for r in rows.select(F.hex(wire.attributes(F.col("m"), F.col("p")))).collect()]
    assert got == ["0108D2029649000000000204A4010000", "0108FBFFFFFFFFFFFFFF", "020407000000", ""]


@pytest.mark.parametrize(
    "text, mtime, permissions, error",
    [
        ("", None, None, None),
        ("7F02AAAA", None, None, None),
        ("0108D2029649000000000204A4010000", 1234567890, 0o644, None),
        ("0204A40100000108FBFFFFFFFFFFFFFF", -5, 0o644, None),
        ("0204010000000204A4010000", None, 0o644, None),
        ("7F00" * 300 + "020402000000", None, 2, None),
        ("01", None, None, "Incomplete TLV record"),
        ("010800", None, None, "Incomplete TLV value"),
        ("010400000000", None, None, "Invalid mtime length"),
        ("02020000", None, None, "Invalid permissions length"),
    ],
)
def test_read_attributes(spark, text, mtime, permissions, error):
    row = spark.range(1).select(wire.read_attributes(F.lit(bytes.fromhex(text))).alias("a")).select("a.*").first()
    assert row["error"] == error
    if not error:
        assert (row["mtime"], row["permissions"]) == (mtime, permissions)


def test_assembled_frames_equal_the_plain_writer(spark):
    empty = bytes.fromhex("0300")
    rows = spark.createDataFrame([(bytearray(empty), None, None), (bytearray(empty), 1234567890, 0o644), (bytearray(empty), None, 0o755)], "p binary, m long, q long")
    got = rows.select("m", "q", wire.assemble(F.col("p"), F.lit(0), F.col("m"), F.col("q"))).collect()
    assert [bytes(r[2]) for r in got] == [frame(b"", r[0], r[1], payload=empty) for r in got]
    assert bytes(got[0][2]).hex() == "435201000000000000000000010000003c41f46a0300"
