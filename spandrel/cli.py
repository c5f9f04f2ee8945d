"""The command line: compress, decompress, inspect, config and plugins, over a local Spark session.

Files of a call are handled in order and the first error ends it, with what was written before left in place. Errors go
to stderr as one line; the exit code says whether usage (2), the operation (1) or an interrupt (130) was at fault.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import time
from collections.abc import Mapping

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .control import Resources, Token, bounded, on_interrupt, perform
from .functions.report import LEVELS, exit_code, frame_path, friendly, restored_path
from .operators import reports
from .operators.codecs import FrameError, default_registry
from .operators.frames import Options, compress, decompress, inspect, self_test
from .plans import config as settings
from .ship import ship
from .sources.files import check_target, from_bytes, read_files, restore_attributes

LOG_LEVELS = {"error": logging.ERROR, "warn": logging.WARNING, "info": logging.INFO, "debug": logging.DEBUG, "trace": 5}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spandrel", description="Pack, unpack and inspect checksummed compressed frames.")
    loud = top.add_mutually_exclusive_group()
    loud.add_argument("-v", "--verbose", action="count", default=0)
    loud.add_argument("-q", "--quiet", action="store_true")
    top.add_argument("--log-format", choices=("human", "json"), default="human")
    top.add_argument("--log-file")
    top.add_argument("--config", default=os.environ.get(settings.PREFIX + "CONFIG_FILE", os.path.expanduser("~/.config/spandrel/config.toml")))
    commands = top.add_subparsers(dest="command", required=True)
    c = commands.add_parser("compress")
    c.add_argument("files", nargs="*")
    c.add_argument("-o", "--output")
    c.add_argument("--stdout", action="store_true")
    c.add_argument("-p", "--plugin")
    c.add_argument("-l", "--level", choices=("fast", "balanced", "best"), default="balanced")
    c.add_argument("-f", "--force", action="store_true")
    c.add_argument("--timeout", type=float, default=0.0)
    d = commands.add_parser("decompress")
    d.add_argument("files", nargs="*")
    d.add_argument("-o", "--output")
    d.add_argument("-f", "--force", action="store_true")
    d.add_argument("--stdout", action="store_true")
    i = commands.add_parser("inspect")
    i.add_argument("files", nargs="+")
    i.add_argument("-f", "--format", choices=("human", "json", "csv"), default="human")
    i.add_argument("-s", "--summary", action="store_true")
    k = commands.add_parser("config").add_subparsers(dest="action", required=True)
    put = k.add_parser("set")
    put.add_argument("key")
    put.add_argument("value")
    k.add_parser("get").add_argument("key")
    k.add_parser("list")
    k.add_parser("reset").add_argument("-y", "--yes", action="store_true")
    p = commands.add_parser("plugins").add_subparsers(dest="action", required=True)
    p.add_parser("list").add_argument("-f", "--format", choices=("human", "json", "csv"), default="human")
    p.add_parser("info").add_argument("name")
    p.add_parser("test").add_argument("name")
    return top


def session() -> SparkSession:
    """The session at hand, or a local one."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        spark = SparkSession.builder.master("local[*]").appName("spandrel").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def _one(df: DataFrame, *columns) -> Row:
    row = df.select(*columns).first()
    if row["error_kind"]:
        raise FrameError(row["error_kind"], row["error_message"])
    return row


def _target(path: str, output: str | None, make) -> str:
    """A file that is named outright, or derived from the input, beside it or in a folder."""
    if output and not os.path.isdir(output):
        return output
    spark = session()
    return spark.range(1).select(make(F.lit(path), F.lit(output) if output else None)).first()[0]


def _put(path: str, content: bytes, force: bool) -> None:
    if why := check_target(path, force):
        raise FrameError("InvalidInput", f"Invalid input: {why}")
    with Resources() as held:
        with open(held.output(path), "wb") as f:
            f.write(content)
        held.mark_complete()


def warning(line: str, colour: bool) -> str:
    """A warning line, yellow on a terminal."""
    return f"\x1b[33mWarning: {line}\x1b[0m" if colour else f"Warning: {line}"


def _warn(lines: list[str]) -> None:
    for line in lines:
        print(warning(line, sys.stderr.isatty()), file=sys.stderr)


def run_compress(args: argparse.Namespace, token: Token) -> None:
    if not args.files and not (args.output or args.stdout):
        raise FrameError("InvalidInput", "Invalid input: reading standard input needs --output or --stdout")
    spark = session()
    on_interrupt(spark, token)
    for path in args.files or [None]:
        began = time.monotonic()
        token.check()
        options = Options(plugin=args.plugin).with_weights(*LEVELS[args.level]).with_timeout(args.timeout).with_cancel_token(token)
        target = None if args.stdout else args.output if path is None else _target(path, args.output, frame_path)
        if path is None:
            rows = from_bytes(spark, sys.stdin.buffer.read()).withColumns({"error_kind": F.lit(None).cast("string"), "error_message": F.lit(None).cast("string")})
        else:
            if why := check_target(target or _target(path, None, frame_path), args.force):
                raise FrameError("InvalidInput", f"Invalid input: {why}")
            rows, options = read_files(spark, [path]), options.with_file_metadata()
        framed = compress(rows, options=options)
        row = perform(spark, lambda: _one(framed, "frame", F.octet_length("data").alias("size"), "error_kind", "error_message"), options)  # noqa: B023
        if target is None:
            sys.stdout.buffer.write(row["frame"])
            sys.stdout.buffer.flush()
            continue
        _put(target, row["frame"], args.force)
        print(reports.human_compressed(path or "-", target, row["size"], len(row["frame"]), time.monotonic() - began, args.plugin or "auto"))


def run_decompress(args: argparse.Namespace, token: Token) -> None:
    if not args.files and not args.stdout:
        raise FrameError("InvalidInput", "Invalid input: reading standard input needs --stdout")
    spark = session()
    on_interrupt(spark, token)
    for path in args.files or [None]:
        began = time.monotonic()
        token.check()
        if path is None:
            rows = from_bytes(spark, sys.stdin.buffer.read()).withColumnRenamed("data", "frame")
        else:
            found = read_files(spark, [path])
            _one(found, "error_kind", "error_message")
            rows = found.select("path", F.col("data").alias("frame"))
        row = bounded(spark, lambda: _one(decompress(rows), "data", "mtime", "permissions", "error_kind", "error_message"), 0, token)  # noqa: B023
        if args.stdout or path is None:
            sys.stdout.buffer.write(row["data"])
            sys.stdout.buffer.flush()
            continue
        target = _target(path, args.output, restored_path)
        _put(target, row["data"], args.force)
        _warn(restore_attributes(target, row["mtime"], row["permissions"]))
        print(reports.human_restored(path, target, len(row["data"]), time.monotonic() - began))


def run_inspect(args: argparse.Namespace, token: Token) -> None:
    spark = session()
    found = read_files(spark, args.files)
    for row in found.select("path", "error_kind", "error_message").collect():
        if row["error_kind"]:
            raise FrameError(row["error_kind"], row["error_message"])
    seen = inspect(found.select("path", F.col("data").alias("frame"))).drop("frame")
    by_path = {r["path"]: r for r in seen.collect()}  # an explicit list of files
    rows = [(p, by_path[p]) for p in args.files]
    for _, row in rows:
        if row["error_kind"]:
            raise FrameError(row["error_kind"], row["error_message"])
    if args.format == "json":
        fields = ("original_size", "compressed_size", "plugin_name", "crc_valid")
        out = [{k: int(r[k]) if k.endswith("size") else r[k] for k in fields} | {"metadata": {"mtime": r["mtime"], "permissions": r["permissions"]}} for _, r in rows]
        print(json.dumps(out, indent=2))
    elif args.format == "csv":
        print(reports.CSV_HEADER)
        ordered = spark.createDataFrame([(i, *(r[c] for c in ("path", "original_size", "compressed_size", "plugin_name", "crc_valid"))) for i, (_, r) in enumerate(rows)], "i int, path string, original_size decimal(20,0), compressed_size long, plugin_name string, crc_valid boolean")
        for line in reports.csv_lines(ordered.orderBy("i").coalesce(1)).collect():
            print(line[0])
    elif args.summary:
        print(reports.human_summary(rows))
    else:
        print("\n".join(reports.human_inspect(p, r) for p, r in rows))


def run_config(args: argparse.Namespace, token: Token) -> None:
    if args.action == "set":
        settings.save(settings.put(settings.load(args.config), args.key, args.value), args.config)
        print(f"Set {args.key} = {args.value}")
    elif args.action == "get":
        print(settings.get(settings.load(args.config), args.key))
    elif args.action == "list":
        print(settings.dump(settings.load(args.config)))
    else:
        if not args.yes:
            print("All settings go back to their defaults. Go on? (y/N): ", end="", flush=True)
            if sys.stdin.readline().strip().lower() != "y":
                print("Reset cancelled")
                return
        settings.save(dict(settings.DEFAULTS), args.config)
        print("Configuration reset to defaults")


def run_plugins(args: argparse.Namespace, token: Token) -> None:
    registry = default_registry()
    if args.action == "list":
        if args.format == "csv":
            raise FrameError("InvalidInput", "Invalid input: CSV format not supported for plugins list")
        if args.format == "json":
            found = [{"name": i.name, "version": i.version, "magic_number": f"0x{i.magic.upper()}", "throughput_mbps": i.throughput, "compression_ratio": i.compression_ratio, "description": i.description} for i in registry.infos()]
            print(json.dumps({"plugins": found, "count": len(found)}, indent=2))
        else:
            print(reports.human_codecs(registry.infos()))
        return
    try:
        codec = registry.by_name(args.name, any_case=True)
    except FrameError as e:
        raise FrameError("InvalidInput", f"Invalid input: {e.message}") from e
    if args.action == "info":
        print(reports.human_codec(codec.info))
        return
    row = self_test(session(), registry).filter(F.col("name") == codec.info.name).first()
    print(f"Testing plugin '{codec.info.name}'...\n  Original: {row['original_size']} bytes")
    if not row["passed"]:
        raise FrameError("InvalidInput", "Invalid input: Roundtrip validation failed: data mismatch")
    print(f"  Roundtrip validation: PASSED\n\nPlugin '{codec.info.name}' is working correctly")


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"timestamp": self.formatTime(record), "level": record.levelname, "target": record.name, "message": record.getMessage()})


def log_level(config: settings.Config, env: Mapping[str, str]) -> str:
    """The level that counts: that of the environment's log variable, where it names one, before the configured one."""
    asked = env.get(settings.PREFIX + "LOG", "").strip().lower()
    return asked if asked in LOG_LEVELS else str(config["logging.level"])


def logs(config: settings.Config) -> None:
    """Human or JSON lines, to stderr or a file."""
    handler = logging.FileHandler(str(config["logging.file"])) if config["logging.file"] else logging.StreamHandler(sys.stderr)
    handler.setFormatter(JsonLines() if config["logging.format"] == "json" else logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    logger = logging.getLogger("spandrel")
    logger.handlers, logger.propagate = [handler], False
    logger.setLevel(LOG_LEVELS[log_level(config, os.environ)])


def told(error: FrameError) -> tuple[str, int]:
    """What a user reads, and the exit code."""
    if error.kind in ("Config", "InvalidInput"):
        text = error.message if error.message.startswith(("Invalid input: ", "Configuration error: ")) else f"Invalid input: {error.message}"
        return text, 2
    spark = SparkSession.getActiveSession()
    if spark is None:
        return error.message, 130 if error.kind in ("Cancelled", "Interrupted") else 1
    row = spark.range(1).select(friendly(F.lit(error.kind), F.lit(error.message)), exit_code(F.lit(error.kind))).first()
    return row[0], row[1]


RUN = {"compress": run_compress, "decompress": run_decompress, "inspect": run_inspect, "config": run_config, "plugins": run_plugins}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    token = Token()
    try:
        config = settings.with_env(settings.load(args.config), os.environ)
        config = settings.validate(settings.with_cli(config, args.verbose, args.quiet, args.log_format, args.log_file))
        logs(config)
        logging.getLogger("spandrel").debug("command %s", args.command)
        RUN[args.command](args, token)
    except FrameError as e:
        text, code = told(e)
        print(f"Error: {text}", file=sys.stderr)
        return code
    except OSError as e:
        print(f"Error: I/O error: {e}", file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        print("Error: Operation cancelled", file=sys.stderr)
        return 130
    return 0
