"""Reports, files, configuration, control, command line, streaming and the catalogue."""

import math
import os
import threading
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_wire import frame

from spandrel import cli
from spandrel.control import Resources, Token, bounded
from spandrel.functions import report
from spandrel.operators import reports, selection
from spandrel.operators.codecs import FrameError, default_registry
from spandrel.operators.frames import compress, decompress, inspect
from spandrel.plans import config
from spandrel.sources.files import from_bytes, read_files, read_folder, write_files
from spandrel.streaming.folders import frames, to_parquet, watch


def value(spark, column):
    return spark.range(1).select(column).first()[0]


# --- reports ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("original, packed, want", [(100, 50, 50.0), (100, 100, 100.0), (0, 50, 0.0)])
def test_ratio(spark, original, packed, want):
    assert value(spark, report.ratio(F.lit(original), F.lit(packed))) == want


@pytest.mark.parametrize("size, seconds, want", [(1 << 20, 1.0, 1.0), (1024, 0.0, 0.0)])
def test_throughput(spark, size, seconds, want):
    assert value(spark, report.throughput(F.lit(size), F.lit(seconds))) == want


def test_one_decimal(spark):
    numbers = [0.0, 0.25, 0.35, 0.75, 12.25, 99.95, 100.0, 33.333, 1e-9, 1234.55, 99999.949]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", reports.one_decimal(F.col("x"))).collect()
    assert [r[1] for r in rows] == [f"{r[0]:.1f}" for r in rows]


def test_one_decimal_beside_ties(spark):
    """Ties and the doubles next to them, of every tenth and many sizes; the ratio 3161 / 80 is such a neighbour."""
    ties = [whole + (2 * tenth + 1) / 20 for whole in (0, 1, 12, 1023, 1024, 3951, 99999, 2**31, 2**40) for tenth in range(10)]
    numbers = [x for tie in ties for x in (math.nextafter(tie, 0.0), tie, math.nextafter(tie, math.inf))]
    numbers += [3161 / 80 * 100.0, 2.0**53 + 2, 1.8446744073709552e21, 5e-324, -0.04, -4575.25]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", reports.one_decimal(F.col("x"))).collect()
    assert [r[1] for r in rows] == [f"{r[0]:.1f}" for r in rows]


def test_csv_lines(spark):
    rows = spark.createDataFrame([(1, "a,b", 80, 3161, "deflate", True), (2, "c", 0, 20, "deflate", False), (3, "d", None, 20, None, None), (4, "e", 1, 22000000, "deflate", True)], "k int, path string, original_size long, compressed_size long, plugin_name string, crc_valid boolean")
    got = {r["k"]: r["value"] for r in reports.csv_lines(rows.withColumn("original_size", F.col("original_size").cast("decimal(20,0)")), "path", "k").collect()}
    assert got == {1: "a,b,80,3161,3951.3,deflate,true", 2: "c,0,20,0.0,deflate,false", 3: None, 4: "e,1,22000000,2200000000.0,deflate,true"}
    assert reports.csv_lines(rows).columns == ["value"]


def test_names(spark):
    for path, packed, inside, restored in (("in/a.txt", "in/a.txt.frame", "out/a.frame", "in/a"), ("a", "a.frame", "out/a.frame", "a"), ("a.tar.gz", "a.tar.gz.frame", "out/a.tar.frame", "a.tar"), ("/x.y/.hidden", "/x.y/.hidden.frame", "out/.hidden.frame", "/x.y/.hidden")):
        assert value(spark, report.frame_path(F.lit(path))) == packed
        assert value(spark, report.frame_path(F.lit(path), F.lit("out/"))) == inside
        assert value(spark, report.restored_path(F.lit(path))) == restored
        assert value(spark, report.restored_path(F.lit(packed))) == path


def test_human_reports():
    row = Row(original_size=100, compressed_size=50, plugin_name="deflate", crc_valid=True, mtime=7)
    text = reports.human_inspect("f", row)
    assert "50.0% (compressed to 50.0% of original)" in text and "CRC32: VALID" in text and text.endswith("Modification time: 7")
    assert "0.0% (same size)" in reports.human_inspect("f", Row(**row.asDict() | {"compressed_size": 100}))
    assert "-50.0% (expanded to 150.0% of original)" in reports.human_inspect("f", Row(**row.asDict() | {"compressed_size": 150}))
    summary = reports.human_summary([("a", row), ("b", Row(**row.asDict() | {"crc_valid": False}))])
    assert "Total Files: 2" in summary and "Overall Size Reduction: 50.0%" in summary and "All CRC Valid: false" in summary
    assert reports.human_compressed("a", "b", 100, 50, 0, "auto") == "Compressed a -> b (50.0% smaller, 0.0 MB/s, auto)"
    assert reports.human_codecs([]) == "No plugins registered" and "Total plugins: 1" in reports.human_codecs(default_registry().infos())
    assert "Magic Number: 0x43520100" in reports.human_codec(default_registry().infos()[0])


def test_summary(spark):
    df = spark.createDataFrame([(1, bytearray(frame(b"a" * 100))), (1, bytearray(frame(b"b")[:16] + bytes(4) + frame(b"b")[20:])), (2, bytearray(frame(b"")))], "k int, frame binary")
    rows = {r["k"]: r for r in reports.summarise(inspect(df), "k").collect()}
    assert (rows[1]["files"], int(rows[1]["total_original"]), rows[1]["all_crc_valid"]) == (2, 101, False)
    assert (rows[2]["files"], rows[2]["all_crc_valid"], rows[2]["reduction"]) == (1, True, 100.0)
    none = reports.summarise(inspect(df.limit(0))).first()
    assert (none["files"], int(none["total_original"]), none["reduction"]) == (0, 0, 100.0)


def test_json_keeps_nulls(spark):
    line = reports.json_objects(inspect(spark.createDataFrame([(bytearray(frame(b"abc")),)], "frame binary"))).first()[0]
    assert line.endswith('"plugin_name":"deflate","crc_valid":true,"metadata":{"mtime":null,"permissions":null}}')
    assert '"magic_number":"0x43520100"' in reports.codec_objects(default_registry().frame(spark)).first()[0]


def test_messages(spark):
    told = lambda kind, text="": value(spark, report.friendly(F.lit(kind), F.lit(text)))
    assert told("InvalidMagic") == "Not a valid archive: invalid magic number"
    assert told("CrcMismatch", "CRC32 mismatch: expected 0000000a, got 0000000b") == "File corrupted: CRC32 checksum mismatch (expected 0000000a, got 0000000b). The compressed file may be damaged."
    assert told("CorruptedData", "x") == "x"


def test_validated_registry_fails_at_the_first_problem(spark):
    rows = default_registry().frame(spark)
    assert selection.validated(rows).count() == 1
    with pytest.raises(Exception, match="invalid throughput"):
        selection.validated(rows.withColumn("throughput", F.lit(float("nan")))).collect()
    assert selection.scored(rows.limit(0), (0.7, 0.3)).count() == 0


# --- files ------------------------------------------------------------------------------------------------------------


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"data one")
    (tmp_path / "empty").write_bytes(b"")
    os.utime(tmp_path / "a.txt", (1600000000, 1600000000))
    (tmp_path / "a.txt").chmod(0o755)
    rows = {os.path.basename(r["path"]): r for r in read_files(spark, [str(tmp_path / n) for n in ("a.txt", "empty", "none")] + [str(tmp_path)]).collect()}
    assert bytes(rows["a.txt"]["data"]) == b"data one" and rows["a.txt"]["mtime"] == 1600000000 and rows["a.txt"]["permissions"] & 0o777 == 0o755
    assert [rows[n]["error_message"].split(":")[0] for n in ("empty", "none", tmp_path.name)] == ["Input file is empty", "Input file does not exist", "Input path is not a file"]
    assert read_folder(spark, str(tmp_path), "*.txt").count() == 1
    assert bytes(from_bytes(spark, b"x").first()["data"]) == b"x"


def test_written_files(spark, tmp_path):
    rows = spark.createDataFrame([(str(tmp_path / f"f{i}"), bytearray(b"c%d" % i), 1600000000 + i, 0o100600) for i in range(5)], "t string, c binary, m long, p long")
    write_files(rows, "t", "c", "m", "p")
    for i in range(5):
        found = (tmp_path / f"f{i}").stat()
        assert (tmp_path / f"f{i}").read_bytes() == b"c%d" % i and found.st_mtime == 1600000000 + i and found.st_mode & 0o777 == 0o600
    with pytest.raises(Exception, match="already exists"):
        write_files(rows, "t", "c")
    write_files(rows.withColumn("c", F.lit(b"new")), "t", "c", force=True)
    assert (tmp_path / "f0").read_bytes() == b"new"
    with pytest.raises(Exception, match="does not exist"):
        write_files(rows.withColumn("t", F.concat(F.lit(f"{tmp_path}/none/"), F.col("m"))), "t", "c")
    with pytest.raises(Exception, match="already exists"):
        write_files(rows.withColumn("t", F.lit(str(tmp_path / "same"))), "t", "c")
    assert sorted(os.listdir(tmp_path)) == [f"f{i}" for i in range(5)]


def test_a_failed_row_leaves_nothing(spark, tmp_path):
    df = decompress(spark.createDataFrame([(str(tmp_path / "x"), bytearray(frame(b"x"))), (str(tmp_path / "y"), bytearray(b"bad"))], "t string, frame binary"))
    from spandrel.operators.frames import fail_fast

    with pytest.raises(Exception, match="Input too short"):
        write_files(fail_fast(df), "t", "data")
    assert os.listdir(tmp_path) == []


# --- control ----------------------------------------------------------------------------------------------------------


def test_bounded(spark):
    assert bounded(spark, lambda: spark.range(10).count()) == 10
    with pytest.raises(ZeroDivisionError):
        bounded(spark, lambda: 1 // 0, 5)
    slow = lambda: spark.range(1, 200).repartition(8).select(F.expr("java_method('java.lang.Thread', 'sleep', 500L)")).collect()
    for seconds, cancel, kind in ((0.5, False, "Timeout"), (0, True, "Cancelled")):
        token, began = Token(), time.time()
        if cancel:
            threading.Timer(0.3, token.cancel).start()
        with pytest.raises(FrameError) as e:
            bounded(spark, lambda: spark.range(200).select(F.udf(lambda x: time.sleep(0.2) or x)("id")).collect(), seconds, token)
        assert e.value.kind == kind and time.time() - began < 8
    del slow
    token = Token()
    token.cancel()
    with pytest.raises(FrameError):
        bounded(spark, lambda: 1, 0, token)
    token.reset()
    assert bounded(spark, lambda: 1, 0, token) == 1


@pytest.mark.parametrize("complete", [True, False])
def test_resources(tmp_path, complete):
    out, temp = tmp_path / "out", tmp_path / "temp"
    with Resources() as held:
        for path in (held.output(str(out)), held.temp(str(temp))):
            open(path, "w").close()
        if complete:
            held.mark_complete()
    assert out.exists() == complete and temp.exists() == complete
    held.cleanup()
    assert not temp.exists()


# --- configuration ----------------------------------------------------------------------------------------------------


def test_config(tmp_path):
    path = str(tmp_path / "deep" / "c.toml")
    assert config.load(path) == config.DEFAULTS
    changed = config.put(config.put(dict(config.DEFAULTS), "compression.timeout-seconds", "30"), "logging.file", 'a"b\\c')
    config.save(changed, path)
    assert config.load(path) == changed and config.get(changed, "compression.timeout_seconds") == "30" and config.get(changed, "output.progress-bars") == "true"
    for key, text in (("compression.level", "x"), ("output.quiet", "yes"), ("compression.timeout_seconds", "-1"), ("a", "b"), ("a.b", "c"), ("logging.level", "loud"), ("a.b.c", "d")):
        with pytest.raises(FrameError):
            config.put(dict(config.DEFAULTS), key, text)
    (tmp_path / "bad").write_text("not toml")
    with pytest.raises(FrameError):
        config.load(str(tmp_path / "bad"))


def test_config_layers():
    env = {"SPANDREL_COMPRESSION_LEVEL": "best", "SPANDREL_COMPRESSION_DEFAULT_PLUGIN": "x", "SPANDREL_OUTPUT_PROGRESSBARS": "false", "SPANDREL_UNKNOWN": "y", "OTHER": "z"}
    got = config.with_cli(config.with_env(dict(config.DEFAULTS), env), verbose=2, quiet=True, log_format="json", log_file="f")
    assert (got["compression.level"], got["compression.default_plugin"], got["output.progress_bars"], got["output.quiet"], got["logging.level"], got["logging.format"], got["logging.file"]) == ("best", "x", False, True, "trace", "json", "f")
    assert config.with_cli(dict(config.DEFAULTS) | {"logging.format": "json"})["logging.format"] == "human"
    with pytest.raises(FrameError):
        config.with_env(dict(config.DEFAULTS), {"SPANDREL_OUTPUT_QUIET": "yes"})


# --- command line -----------------------------------------------------------------------------------------------------


@pytest.fixture
def run(spark, tmp_path, monkeypatch, capfd):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(cli, "session", lambda: spark)

    def call(*args):
        code = cli.main(["--config", str(tmp_path / "c.toml"), *args])
        out, err = capfd.readouterr()
        return code, out, err

    return call


def test_cli_round_trip(run, tmp_path):
    (tmp_path / "file1.txt").write_bytes(b"data one")
    (tmp_path / "file2.txt").write_bytes(b"data two two")
    os.utime(tmp_path / "file1.txt", (1600000000, 1600000000))
    (tmp_path / "file1.txt").chmod(0o755)
    assert run("compress", "file1.txt", "file2.txt")[0] == 0
    code, out, _ = run("inspect", "-s", "file1.txt.frame", "file2.txt.frame")
    assert code == 0 and "Total Files: 2" in out and "Total Original Size: 20" in out and "All CRC Valid: true" in out
    code, out, _ = run("inspect", "-f", "csv", "file2.txt.frame", "file1.txt.frame")
    assert [x.split(",")[0] for x in out.splitlines()] == ["file_path", "file2.txt.frame", "file1.txt.frame"]
    assert '"crc_valid": true' in run("inspect", "-f", "json", "file1.txt.frame")[1]
    code, _, err = run("compress", "file1.txt")
    assert code == 2 and "already exists" in err
    assert run("compress", "-f", "--timeout", "60", "-l", "best", "-p", "deflate", "file1.txt")[0] == 0
    os.remove(tmp_path / "file1.txt")
    assert run("decompress", "file1.txt.frame")[0] == 0
    found = (tmp_path / "file1.txt").stat()
    assert (tmp_path / "file1.txt").read_bytes() == b"data one" and found.st_mtime == 1600000000 and found.st_mode & 0o777 == 0o755


def test_cli_errors(run, tmp_path):
    (tmp_path / "text").write_text("this is not a frame at all")
    (tmp_path / "empty").write_text("")
    assert run("inspect", "text")[0] == 1 and "invalid magic number" in run("inspect", "text")[2]
    assert run("compress", "empty")[0] == 2 and run("compress", "none")[0] == 2
    assert run("compress", "-p", "none", "text")[0] == 1
    assert run("config", "set", "compression.level", "x")[0] == 2
    (tmp_path / "c.toml").write_text("[compression\n")
    assert run("config", "list")[0] == 2


def test_cli_config_and_plugins(run):
    assert run("config", "set", "compression.level", "best")[1] == "Set compression.level = best\n"
    assert run("config", "get", "compression.level")[1] == "best\n" and 'level = "best"' in run("config", "list")[1]
    assert run("config", "reset", "-y")[0] == 0 and run("config", "get", "compression.level")[1] == "balanced\n"
    assert "Total plugins: 1" in run("plugins", "list")[1] and '"count": 1' in run("plugins", "list", "-f", "json")[1]
    assert run("plugins", "list", "-f", "csv")[0] == 2 and "Version: 1.0.0" in run("plugins", "info", "DEFLATE")[1]
    assert "PASSED" in run("plugins", "test", "deflate")[1] and run("plugins", "info", "x")[0] == 2


# --- streams ----------------------------------------------------------------------------------------------------------


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / str(i)).write_bytes(b"x%d" % i * 100)
    start = lambda: to_parquet(frames(watch(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    start()
    (tmp_path / "in" / "3").write_bytes(b"late")
    start()
    back = decompress(spark.read.parquet(str(tmp_path / "out")).drop("mtime"))
    assert sorted(bytes(r["data"]) for r in back.collect()) == sorted([b"x%d" % i * 100 for i in range(3)] + [b"late"])


def test_compress_on_a_table_with_nulls(spark):
    df = spark.createDataFrame([(None,), (bytearray(b"a"),)], "data binary")
    got = decompress(compress(df).drop("data")).collect()
    assert sorted([r["data"] for r in got], key=str) == [None, bytearray(b"a")] or sorted(str(r["data"]) for r in got) == ["None", str(bytearray(b"a"))]
    assert all(r["error_kind"] is None for r in got)
