"""Queries over what works on the driver: configuration, reports, files, tokens, timeouts and the command line.

Each calls the real functions and shows what they give as rows. The SQL states the rows that are due as literals, but for
those that follow from a table.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import signal
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..control import CancelOnExit, Resources, Token, bounded, perform
from ..functions import report
from ..operators import reports
from ..operators.codecs import CHUNK, CodecInfo, Deflate, FrameError, Registry, deadline, default_registry, init_codecs
from ..operators.frames import Options, compress, decompress, fail_fast, inspect, weights
from . import config
from .catalogue import _shared, query, table

Rows = list[tuple]


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}::DOUBLE"
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def literal(name: str, schema: str, *due: tuple) -> Callable[[Callable[[SparkSession], Rows]], Callable]:
    """Registers a function that gives rows, with the rows that are due."""
    kinds = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    columns = [c.split() for c in schema.split(", ")]
    casts = ", ".join(f"CAST({c} AS {kinds[k]}) AS {c}" for c, k in columns)
    rows = ", ".join(f"({', '.join(map(_sql, r))})" for r in due)

    def add(f: Callable[[SparkSession], Rows]) -> Callable:
        @query(name, f"SELECT {casts} FROM (VALUES {rows}) t({', '.join(c for c, _ in columns)})")
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.createDataFrame(f(spark), schema)

        run.__doc__ = f.__doc__
        return f

    return add


def problem(f: Callable[[], object]) -> str | None:
    """The message of the error that a call raises."""
    try:
        f()
    except FrameError as e:
        return e.message
    return None


# --- options and configuration ---------------------------------------------------------------------------------------


@literal(
    "weights_validation",
    "throughput double, compression_ratio double, problem string",
    (0.5, 0.5, None), (0.7, 0.3, None), (1.0, 0.0, None), (-0.1, 1.1, "Weights cannot be negative"), (0.6, 0.6, "Weights must sum to 1.0, got 1.2"), (0.5, 0.4, "Weights must sum to 1.0, got 0.9"),
)
def weights_validation(spark: SparkSession) -> Rows:
    return [(t, r, problem(lambda: weights(t, r))) for t, r in ((0.5, 0.5), (0.7, 0.3), (1.0, 0.0), (-0.1, 1.1), (0.6, 0.6), (0.5, 0.4))]  # noqa: B023


@literal(
    "env_scan",
    "key string, value string",
    ("compression.default_plugin", "auto"), ("compression.level", "best"), ("compression.timeout_seconds", "45"), ("output.progress_bars", "false"), ("output.color", "never"),
    ("output.quiet", "false"), ("logging.format", "json"), ("logging.level", "info"), ("logging.file", ""),
)
def env_scan(spark: SparkSession) -> Rows:
    """Variables with underscores in a key and without, unknown ones and those of others."""
    names = {"COMPRESSION_LEVEL": "best", "COMPRESSION_TIMEOUT_SECONDS": "45", "OUTPUT_PROGRESSBARS": "false", "OUTPUT_COLOR": "never", "LOGGING_FORMAT": "json", "UNKNOWN_KEY": "x"}
    env = {config.PREFIX + k: v for k, v in names.items()} | {"OTHER_LOGGING_LEVEL": "trace"}
    return [(k, config.show(v)) for k, v in config.with_env(dict(config.DEFAULTS), env).items()]


_SAID = "Configuration error: "
_STEPS = (
    ("get", "compression.level", None, "balanced", None),
    ("set", "compression.level", "fast", "fast", None),
    ("set", "compression.timeout-seconds", "30", "30", None),
    ("set", "output.quiet", "true", "true", None),
    ("set", "compression.level", "turbo", None, _SAID + "Invalid compression level: 'turbo' (must be fast, balanced, or best)"),
    ("set", "output.color", "pink", None, _SAID + "Invalid color setting: 'pink' (must be auto, always, or never)"),
    ("set", "logging.format", "xml", None, _SAID + "Invalid log format: 'xml' (must be human or json)"),
    ("set", "output.quiet", "yes", None, _SAID + "Invalid boolean value: 'yes' (must be true or false)"),
    ("set", "compression.timeout_seconds", "soon", None, _SAID + "Invalid timeout value: 'soon' (must be a number)"),
    ("get", "compression.speed", None, None, _SAID + "Invalid config key: 'compression.speed' (unknown key)"),
    ("get", "level", None, None, _SAID + "Invalid config key: 'level' (must be section.key format)"),
)


@literal("config_operations", "action string, key string, asked string, value string, problem string", *_STEPS)
def config_operations(spark: SparkSession) -> Rows:
    """Reading and setting keys, in either spelling, and what is refused."""
    out: Rows = []
    for action, key, asked, *_ in _STEPS:
        value: list[str] = []

        def run() -> None:
            held = dict(config.DEFAULTS) if action == "get" else config.put(dict(config.DEFAULTS), key, asked)  # noqa: B023
            value.append(config.get(held, key))  # noqa: B023

        why = problem(run)
        out.append((action, key, asked, value[0] if value else None, why))
    return out


@literal(
    "config_file",
    "key string, value string",
    ("compression.default_plugin", "auto"), ("compression.level", "best"), ("compression.timeout_seconds", "7"), ("output.progress_bars", "true"), ("output.color", "auto"),
    ("output.quiet", "true"), ("logging.format", "human"), ("logging.level", "info"), ("logging.file", 'a "b"\\c'), ("(missing file)", "balanced"), ("(broken file)", _SAID + "Invalid config file format"),
)
def config_file(spark: SparkSession) -> Rows:
    """A configuration written to its file and read again; a file that is not there, and one that is broken."""
    top = _shared(spark)
    held = config.DEFAULTS | {"compression.level": "best", "compression.timeout_seconds": 7, "output.quiet": True, "logging.file": 'a "b"\\c'}
    config.save(held, f"{top}/deep/config.toml")
    with open(f"{top}/broken.toml", "w", encoding="utf-8") as f:
        f.write("[compression\nlevel = ")
    broken = problem(lambda: config.load(f"{top}/broken.toml")) or ""
    back = [(k, config.show(v)) for k, v in config.load(f"{top}/deep/config.toml").items()]
    return [*back, ("(missing file)", config.show(config.load(f"{top}/none.toml")["compression.level"])), ("(broken file)", broken.rsplit(": ", 1)[0][: len(_SAID) + 26])]


@literal("verbose_levels", "times int, quiet boolean, level string, silent boolean", (0, False, "info", False), (1, False, "debug", False), (2, False, "trace", False), (3, False, "trace", False), (0, True, "info", True))
def verbose_levels(spark: SparkSession) -> Rows:
    out = [(v, q, config.with_cli(dict(config.DEFAULTS), v, q)) for v, q in ((0, False), (1, False), (2, False), (3, False), (0, True))]
    return [(v, q, c["logging.level"], c["output.quiet"]) for v, q, c in out]


_LEVELS = ((None, "warn", "warn"), ("debug", "warn", "debug"), ("TRACE", "error", "trace"), ("nonsense", "info", "info"), ("", "error", "error"))


@literal("log_levels", "asked string, configured string, level string", *_LEVELS)
def log_levels(spark: SparkSession) -> Rows:
    """The environment's level goes before the configured one."""
    from ..cli import log_level

    return [(a, c, log_level(config.DEFAULTS | {"logging.level": c}, {} if a is None else {config.PREFIX + "LOG": a})) for a, c, _ in _LEVELS]


# --- codecs and their registry ---------------------------------------------------------------------------------------


@query("codec_detect", "SELECT doc_id, true AS detected FROM documents")
def codec_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the default codec claims the head of a payload."""
    codec = default_registry().default()

    @F.arrow_udf("boolean")
    def detect(heads: pa.Array) -> pa.Array:
        return pa.array([codec.detect(h) for h in heads.to_pylist()], pa.bool_())

    return table(spark, sf_dir, "documents").select("doc_id", detect(F.substring(F.encode("text", "UTF-8"), 1, 16)).alias("detected"))


@query(
    "codec_chunks",
    f"SELECT doc_id, n AS checks, true AS same, n > 1 AS stopped FROM (SELECT doc_id, (40 * octet_length(encode(text)) + {CHUNK - 1}) // {CHUNK} AS n FROM documents)",
)
def codec_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codec's loop over every text forty times over: how often it looks whether to stop, that it gives back the same,
    and that it stops at its second look if asked to."""

    @F.arrow_udf("struct<checks: long, same: boolean, stopped: boolean>")
    def run(values: pa.Array) -> pa.Array:
        codec, out = Deflate(), []
        for value in values.to_pylist():
            data, looks, token = value * 40, [], Token()

            def second() -> None:
                looks.append(1)  # noqa: B023
                if len(looks) > 1:  # noqa: B023
                    token.cancel()  # noqa: B023
                token.check()  # noqa: B023

            stopped = problem(lambda: codec.compress(data, second)) is not None  # noqa: B023
            looks.clear()
            packed = codec.compress(data, lambda: looks.append(1))  # noqa: B023
            out.append({"checks": len(looks), "same": codec.decompress(packed, len(data), lambda: None) == data, "stopped": stopped})
        return pa.array(out, pa.struct([("checks", pa.int64()), ("same", pa.bool_()), ("stopped", pa.bool_())]))

    made = table(spark, sf_dir, "documents").select("doc_id", run(F.encode("text", "UTF-8")).alias("r"))
    return made.select("doc_id", "r.checks", "r.same", "r.stopped")


class _Other(Deflate):
    def __init__(self, name: str, magic: str = Deflate.info.magic):
        super().__init__()
        self.info = CodecInfo(name, "1.0.0", magic, 100.0, 0.5)


@literal(
    "registry_life",
    "step int, did string, ready boolean, codecs int, note string",
    (1, "init", True, 1, None), (2, "register", True, 2, None), (3, "duplicate", True, 2, "Duplicate magic number 43520100: 'twin' conflicts with 'deflate', which stays"),
    (4, "init with an invalid codec", False, 1, "Plugin name cannot be empty"), (5, "init again", True, 1, None), (6, "no codecs", True, 0, "No default codec is registered"),
    (7, "installed", True, 1, "deflate"),
)
def registry_life(spark: SparkSession) -> Rows:
    """Registration, a duplicate, a failed start that leaves a part, starting again, and what is installed."""
    held = Registry([Deflate()])
    out = [(1, "init", held.ready, len(held.codecs), None)]
    held.register(_Other("more", "43520109"))
    out.append((2, "register", held.ready, len(held.codecs), None))
    held.register(_Other("twin"))
    out.append((3, "duplicate", held.ready, len(held.codecs), held.warnings[-1]))
    why = problem(lambda: held.init([Deflate(), _Other("", "43520109"), _Other("late", "4352010A")]))
    out.append((4, "init with an invalid codec", held.ready, len(held.codecs), why))
    held.init([Deflate()])
    out.append((5, "init again", held.ready, len(held.codecs), None))
    none = Registry()
    out.append((6, "no codecs", none.ready, len(none.codecs), problem(none.default)))
    own = [i.name for i in init_codecs().infos()]
    return [*out, (7, "installed", default_registry().ready, 1, own[0])]


_INFOS = [CodecInfo("deflate", "1.0.0", "43520100", 200.0, 0.35, "Usual"), CodecInfo("fast", "2.1", "4352010a", 1234.56, 0.8, "Quick")]


@literal(
    "registry_texts",
    "text string, content string",
    ("none", "No plugins registered"),
    ("list", f"Name{' ' * 12}Version    Throughput{' ' * 6}Compression     Description\n{'-' * 80}\ndeflate{' ' * 9}1.0.0      200.0{' ' * 9}MB/s 35.0{' ' * 9}% Usual\n"
             f"fast{' ' * 12}2.1        1234.6{' ' * 8}MB/s 80.0{' ' * 9}% Quick\n\nTotal plugins: 2"),
    ("info", "Plugin: fast\nVersion: 2.1\nMagic Number: 0x4352010A\n\nPerformance Characteristics:\n  Throughput: 1234.6 MB/s\n  Compression Ratio: 80.0%\n\nDescription:\n  Quick"),
    ("json", '{"name":"deflate","version":"1.0.0","magic_number":"0x43520100","throughput_mbps":200.0,"compression_ratio":0.35,"description":"Standard DEFLATE compression (RFC 1951)"}'),
)
def registry_texts(spark: SparkSession) -> Rows:
    """The registry as texts, and the installed one as JSON."""
    found = reports.codec_objects(Registry([Deflate()]).frame(spark)).first()[0]
    return [("none", reports.human_codecs([])), ("list", reports.human_codecs(_INFOS)), ("info", reports.human_codec(_INFOS[1])), ("json", found)]


# --- reports ---------------------------------------------------------------------------------------------------------


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up inspection rows of every document."""
    n = F.octet_length(F.encode("text", "UTF-8")).cast("decimal(20,0)")
    return table(spark, sf_dir, "documents").select(
        "doc_id", n.alias("original_size"), (F.col("doc_id") * 7919 % 5000 + 20).alias("compressed_size"), F.lit("deflate").alias("plugin_name"), (F.col("doc_id") % 7 != 0).alias("crc_valid"))


_MADE = "SELECT doc_id, octet_length(encode(text)) AS n, 20 + doc_id * 7919 % 5000 AS c, doc_id % 7 <> 0 AS ok FROM documents"


@query(
    "human_reports",
    f"""SELECT doc_id, 'File: d' || doc_id || chr(10) || '  Original size: ' || n || chr(10) || '  Compressed size: ' || c || chr(10) || '  Size reduction: '
               || CASE WHEN 100.0::DOUBLE - s = 0 THEN '0.0% (same size)' ELSE printf('%.1f', 100.0::DOUBLE - s) || '% (' || CASE WHEN 100.0::DOUBLE - s > 0 THEN 'compressed' ELSE 'expanded' END
               || ' to ' || printf('%.1f', s) || '% of original)' END || chr(10) || '  Plugin: deflate' || chr(10) || '  CRC32: ' || CASE WHEN ok THEN 'VALID' ELSE 'INVALID' END
               || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '  Modification time: ' || doc_id * 60 ELSE '' END AS report
        FROM (SELECT *, CASE WHEN n > 0 THEN c::DOUBLE / n * 100.0::DOUBLE ELSE 0.0::DOUBLE END AS s FROM ({_MADE}))""",
)
def human_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of one file, for made-up sizes of every document."""

    @F.arrow_udf("string")
    def told(path: pa.Array, original: pa.Array, packed: pa.Array, name: pa.Array, valid: pa.Array, mtime: pa.Array) -> pa.Array:
        keys = ("original_size", "compressed_size", "plugin_name", "crc_valid", "mtime")
        rows = zip(*(x.to_pylist() for x in (path, original, packed, name, valid, mtime)), strict=True)
        return pa.array([reports.human_inspect(p, dict(zip(keys, r, strict=True))) for p, *r in rows], pa.string())

    mtime = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") * 60)
    columns: list[Column | str] = [F.concat(F.lit("d"), F.col("doc_id")), F.col("original_size").cast("long"), "compressed_size", "plugin_name", "crc_valid", mtime]
    return _sized(spark, sf_dir).select("doc_id", told(*columns).alias("report"))


@literal(
    "human_summary",
    "text string",
    ("\n--- Summary ---\n  File: a | Original: 1000 | Compressed: 400 | Plugin: deflate | CRC: VALID\n  File: b | Original: 500 | Compressed: 600 | Plugin: fast | CRC: INVALID\n-----------------\n"
     "  Total Files: 2\n  Total Original Size: 1500\n  Total Compressed Size: 1000\n  Overall Size Reduction: 33.3%\n  All CRC Valid: false",),
)
def human_summary(spark: SparkSession) -> Rows:
    kinds = ("original_size", "compressed_size", "plugin_name", "crc_valid")
    rows = [("a", (1000, 400, "deflate", True)), ("b", (500, 600, "fast", False))]
    return [(reports.human_summary([(p, dict(zip(kinds, r, strict=True))) for p, r in rows]),)]


@literal(
    "transfer_lines",
    "line string",
    ("Compressed a -> a.frame (50.0% smaller, 2.0 MB/s, auto)",), ("Compressed b -> b.frame (50.0% larger, 0.0 MB/s, deflate)",), ("Compressed c -> c.frame (same size, 0.0 MB/s, auto)",), ("Decompressed a.frame -> a (2.0 MB/s)",),
)
def transfer_lines(spark: SparkSession) -> Rows:
    made = [("a", 1 << 20, 1 << 19, 0.5, "auto"), ("b", 100, 150, 0.0, "deflate"), ("c", 10, 10, 1.0, "auto")]
    return [(reports.human_compressed(p, f"{p}.frame", n, c, s, k),) for p, n, c, s, k in made] + [(reports.human_restored("a.frame", "a", 2 << 20, 1.0),)]


@query(
    "inspect_totals",
    f"""SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS total_original, CAST(sum(c) AS BIGINT) AS total_compressed, bool_and(ok) AS all_crc_valid,
               round(100.0::DOUBLE - sum(c)::DOUBLE / sum(n)::DOUBLE * 100.0::DOUBLE, 9) AS reduction FROM ({_MADE})""",
)
def inspect_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a summary, for made-up packed sizes and checksums."""
    rows = reports.summarise(_sized(spark, sf_dir))
    return rows.select("files", F.col("total_original").cast("long").alias("total_original"), F.col("total_compressed").cast("long").alias("total_compressed"), "all_crc_valid", F.round("reduction", 9).alias("reduction"))


_TOLD = (
    ("InvalidHeader", "Invalid header format: x", "Not a valid archive: invalid file header"),
    ("InvalidMagic", "Invalid magic number: [1]", "Not a valid archive: invalid magic number"),
    ("CrcMismatch", "CRC32 mismatch: expected 0000000a, got 0000000b", "File corrupted: CRC32 checksum mismatch (expected 0000000a, got 0000000b). The compressed file may be damaged."),
    ("NotFound", "x", "Compression plugin 'x' not found. List the codecs to see what is available."),
    ("Timeout", "Operation timed out after 30s", "Compression timeout after 30s"),
    ("Timeout", "Operation timed out after 2.75s", "Compression timeout after 2s"),
    ("Timeout", "Operation timed out after 0.5s", "Compression timeout after 0s"),
    ("Panic", "x", "Plugin panicked during execution"),
    ("Cancelled", "x", "Operation cancelled"),
    ("Interrupted", "x", "Operation cancelled"),
    ("CorruptedData", "Corrupted data: x", "Corrupted data: x"),
    ("InvalidInput", "Invalid input: x", "Invalid input: x"),
)


@query("user_messages", f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in _TOLD)}) t(kind, message, told)")
def user_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users are told about every kind of error."""
    rows = spark.createDataFrame([r[:2] for r in _TOLD], "kind string, message string")
    return rows.withColumn("told", report.friendly(F.col("kind"), F.col("message")))


@literal("warning_lines", "colour boolean, line string", (False, "Warning: odd"), (True, "\x1b[33mWarning: odd\x1b[0m"))
def warning_lines(spark: SparkSession) -> Rows:
    from ..cli import warning

    return [(c, warning("odd", c)) for c in (False, True)]


# --- files -----------------------------------------------------------------------------------------------------------


@literal(
    "overwrite_policy",
    "name string, force boolean, problem string",
    ("new", False, None), ("there", False, "Output file already exists: /there. Use --force to overwrite."), ("there", True, None), ("none/new", False, "Output directory does not exist: /none"), ("none/new", True, "Output directory does not exist: /none"),
)
def overwrite_policy(spark: SparkSession) -> Rows:
    from ..sources.files import check_target

    top = _shared(spark)
    open(f"{top}/there", "w").close()
    asked = (("new", False), ("there", False), ("there", True), ("none/new", False), ("none/new", True))
    return [(n, f, (check_target(f"{top}/{n}", f) or "").replace(top, "") or None) for n, f in asked]


@literal("write_cleanup", "step string, files int", ("left early", 0), ("marked complete", 2), ("cleaned up", 1), ("written", 4), ("one target is wrong", 0), ("target exists", 4))
def write_cleanup(spark: SparkSession) -> Rows:
    """What is left of files that an operation wrote, and of distributed writes that fail."""
    from ..sources.files import write_files

    top, out = _shared(spark), []
    for step in ("early", "complete"):
        os.makedirs(f"{top}/{step}")
        with contextlib.suppress(KeyError), Resources() as held:
            for path in (held.output(f"{top}/{step}/out"), held.temp(f"{top}/{step}/temp")):
                open(path, "w").close()
            if step == "early":
                raise KeyError(step)
            held.mark_complete()
        out.append((("left early", "marked complete")[step == "complete"], len(os.listdir(f"{top}/{step}"))))
    held.cleanup()
    out.append(("cleaned up", len(os.listdir(f"{top}/complete"))))
    for name in ("good", "bad"):
        os.makedirs(f"{top}/{name}")
    rows = spark.range(4).select("id", F.encode(F.col("id").cast("string"), "UTF-8").alias("data"))
    good = rows.withColumn("target", F.concat(F.lit(f"{top}/good/"), "id"))
    write_files(good, "target", "data")
    out.append(("written", len(os.listdir(f"{top}/good"))))
    wrong = F.when(F.col("id") == 3, F.lit(f"{top}/none/3")).otherwise(F.concat(F.lit(f"{top}/bad/"), F.col("id")))
    for step, made, name in (("one target is wrong", rows.withColumn("target", wrong), "bad"), ("target exists", good, "good")):
        with contextlib.suppress(Exception):  # what is left is what counts
            write_files(made, "target", "data")
        out.append((step, len(os.listdir(f"{top}/{name}"))))
    return out


@literal("file_attributes", "name string, length long, mtime long, permissions long", ("a", 3, 1000, 33152), ("b", 4, -5, 33188), ("c", 5, 1234567890, 33261))
def file_attributes(spark: SparkSession) -> Rows:
    """Length, time and mode of files that were written with them."""
    from ..sources.files import listing, write_files

    top = _shared(spark)
    made = [(f"{top}/{n}", bytearray(b"x" * size), t, mode) for n, size, t, mode in (("a", 3, 1000, 0o600), ("b", 4, -5, 0o644), ("c", 5, 1234567890, 0o755))]
    write_files(spark.createDataFrame(made, "target string, data binary, t long, p long"), "target", "data", "t", "p")
    return [(r["path"].rsplit("/", 1)[1], r["length"], r["mtime"], r["permissions"]) for r in listing(spark, [m[0] for m in made]).collect()]


@literal("fail_fast_inspect", "files int, inspected long, problem string", (3, 3, None), (4, None, "InvalidMagic"))
def fail_fast_inspect(spark: SparkSession) -> Rows:
    """Files are inspected together; one that is no frame ends the call."""
    from ..sources.files import read_files

    top, out = _shared(spark), []
    texts = spark.createDataFrame([(i, bytearray(f"content {i}", "utf-8")) for i in range(3)], "id int, data binary")
    for r in compress(texts).select("id", "frame").collect():
        with open(f"{top}/{r['id']}.frame", "wb") as f:
            f.write(r["frame"])
    with open(f"{top}/3.frame", "wb") as f:
        f.write(b"this is no frame, but long enough to be one")
    for n in (3, 4):
        rows = read_files(spark, [f"{top}/{i}.frame" for i in range(n)]).select("path", F.col("data").alias("frame"))
        try:
            out.append((n, fail_fast(inspect(rows)).count(), None))
        except Exception as e:  # the job's error carries the row's
            out.append((n, None, next(iter(re.findall("Invalid[A-Z][a-z]+", str(e))), str(e)[:80])))
    return out


@literal("stdin_frames", "path string, size long, restored string, again string", ("-", 12, "some content", None))
def stdin_frames(spark: SparkSession) -> Rows:
    """Bytes without a file, as standard input gives them, framed, and the frame's bytes restored."""
    from ..sources.files import from_bytes

    row = compress(from_bytes(spark, b"some content")).first()
    back = decompress(from_bytes(spark, bytes(row["frame"])).withColumnRenamed("data", "frame")).first()
    return [(row["path"], len(row["data"]), bytes(back["data"]).decode(), back["error_kind"])]


# --- tokens and timeouts ---------------------------------------------------------------------------------------------


@literal("token_states", "step int, did string, cancelled boolean, problem string", (1, "new", False, None), (2, "cancel", True, "Operation cancelled"), (3, "cancel again", True, "Operation cancelled"), (4, "reset", False, None))
def token_states(spark: SparkSession) -> Rows:
    token, out = Token(), []
    for i, (did, act) in enumerate((("new", None), ("cancel", token.cancel), ("cancel again", token.cancel), ("reset", token.reset))):
        if act:
            act()
        out.append((i + 1, did, token.is_cancelled(), problem(token.check)))
    return out


@literal(
    "timeouts",
    "name string, outcome string, token_set boolean",
    ("in time", "10", False), ("without end", "10", False), ("too late", "Operation timed out after 0.5s", True), ("cancelled before", "Operation cancelled", True), ("own error", "ZeroDivisionError", False),
    ("guard", None, True), ("guard dismissed", None, False), ("options in time", "10", False), ("cancelled options", "Operation cancelled", True), ("payload in time", None, None), ("payload too late", "Operation timed out after 0.001s", None),
)
def timeouts(spark: SparkSession) -> Rows:
    """Actions under a timeout and a token, the guard that sets a token, options that carry both, and the check that a
    codec's loop makes."""
    slow = F.udf(lambda x: time.sleep(0.2) or x)
    count, sleepy = (lambda: spark.range(10).count()), (lambda: spark.range(400).select(slow("id")).collect())
    out: Rows = []

    def case(name: str, run: Callable[[Token], object], cancelled: bool = False) -> None:
        token = Token()
        if cancelled:
            token.cancel()
        try:
            got = str(run(token))
        except FrameError as e:
            got = e.message
        except ArithmeticError as e:
            got = type(e).__name__
        out.append((name, got, token.is_cancelled()))

    case("in time", lambda t: bounded(spark, count, 60, t))
    case("without end", lambda t: bounded(spark, count, 0, t))
    case("too late", lambda t: bounded(spark, sleepy, 0.5, t))
    case("cancelled before", lambda t: bounded(spark, count, 60, t), True)
    case("own error", lambda t: bounded(spark, lambda: 1 // 0, 60, t))
    for name, dismiss in (("guard", False), ("guard dismissed", True)):
        token = Token()
        with CancelOnExit(token) as guard:
            if dismiss:
                guard.dismiss()
        out.append((name, None, token.is_cancelled()))
    case("options in time", lambda t: perform(spark, count, Options().with_timeout(60).with_cancel_token(t)))
    case("cancelled options", lambda t: compress(spark.range(1).selectExpr("cast('x' AS binary) AS data"), options=Options().with_cancel_token(t)), True)
    brief = deadline(0.001)
    time.sleep(0.01)
    long = b"x" * (4 * CHUNK)
    return [*out, ("payload in time", problem(lambda: Deflate().compress(long, deadline(60))), None), ("payload too late", problem(lambda: Deflate().compress(long, brief)), None)]


# --- the command line ------------------------------------------------------------------------------------------------

_COMMANDS = (
    ("config get compression.level", 0, "balanced"),
    ("config set compression.level best", 0, "Set compression.level = best"),
    ("config get compression.level", 0, "best"),
    ("config set compression.level turbo", 2, "Error: " + _SAID + "Invalid compression level: 'turbo' (must be fast, balanced, or best)"),
    ("config reset -y", 0, "Configuration reset to defaults"),
    ("plugins info DEFLATE", 0, "Plugin: deflate"),
    ("plugins info none", 2, "Error: Invalid input: Plugin 'none' not found"),
    ("plugins list --format csv", 2, "Error: Invalid input: CSV format not supported for plugins list"),
    ("plugins test deflate", 0, "Testing plugin 'deflate'..."),
    ("compress /a.txt", 0, "Compressed /a.txt -> /a.txt.frame"),
    ("compress /a.txt", 2, "Error: Invalid input: Output file already exists: /a.txt.frame. Use --force to overwrite."),
    ("compress --force -p none /a.txt", 1, "Error: Compression plugin 'Plugin 'none' not found' not found. List the codecs to see what is available."),
    ("compress /missing.txt", 2, "Error: Invalid input: Input file does not exist: /missing.txt"),
    ("inspect --format csv /a.txt.frame", 0, "file_path,original_size,compressed_size,compression_ratio,plugin,crc_valid"),
    ("inspect /a.txt.frame", 0, "File: /a.txt.frame"),
    ("inspect /a.txt.frame /a.txt", 1, "Error: Not a valid archive: invalid magic number"),
    ("decompress -o /b.txt /a.txt.frame", 0, "Decompressed /a.txt.frame -> /b.txt"),
    ("decompress -o /b.txt /a.txt.frame", 2, "Error: Invalid input: Output file already exists: /b.txt. Use --force to overwrite."),
    ("decompress -f -o /b.txt /a.txt", 1, "Error: Not a valid archive: invalid magic number"),
)


@literal("command_line", "step int, command string, code int, told string", *((i, *c) for i, c in enumerate(_COMMANDS)), (len(_COMMANDS), "(b.txt)", 0, "words of a file, " * 5))
def command_line(spark: SparkSession) -> Rows:
    """Commands with their exit codes and the first line of what they say, in a folder of their own."""
    from ..cli import main

    top, out = _shared(spark), []
    with open(f"{top}/a.txt", "w", encoding="utf-8") as f:
        f.write("words of a file, " * 5)
    before = signal.getsignal(signal.SIGINT)
    try:
        for i, (command, *_) in enumerate(_COMMANDS):
            said = io.StringIO()
            with contextlib.redirect_stdout(said), contextlib.redirect_stderr(said):
                code = main(["--config", f"{top}/config.toml", *(f"{top}{a}" if a.startswith("/") else a for a in command.split())])
            line = next(iter(said.getvalue().replace(top, "").splitlines()), "")
            out.append((i, command, code, re.sub(r" \([^()]*MB/s[^()]*\)$", "", line)))
    finally:
        with contextlib.suppress(ValueError, TypeError):  # only the main thread may set it
            signal.signal(signal.SIGINT, before)
    with open(f"{top}/b.txt", encoding="utf-8") as f:
        return [*out, (len(_COMMANDS), "(b.txt)", 0, f.read())]
