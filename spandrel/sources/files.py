"""Files as rows, and rows as files.

Reading goes through Spark's `binaryFile` source, which lists and splits by itself; what it leaves out (empty files, file
modes) is added by a stat of the paths. Writing goes through a Python data source: every task writes temporary files,
the commit renames them, an abort removes them.
"""

from __future__ import annotations

import os
import stat as modes
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAT = "path string, length long, mtime long, permissions long, error_kind string, error_message string"


def stat(path: str, absolute: str) -> tuple:
    """(path, length, mtime in seconds, mode, error kind and message) of a path that should be a file with content."""
    wrong = lambda text: (path, None, None, None, "InvalidInput", text)
    try:
        found = os.stat(absolute)
    except FileNotFoundError:
        return wrong(f"Input file does not exist: {path}")
    except OSError as e:
        return wrong(f"Cannot read input file {path}: {e.strerror}")
    if not modes.S_ISREG(found.st_mode):
        return wrong(f"Input path is not a file: {path}")
    if not found.st_size:
        return wrong(f"Input file is empty: {path}")
    return path, found.st_size, int(found.st_mtime // 1), found.st_mode, None, None


def listing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row for each path, with its attributes or what is wrong with it. Paths are of a file system that all share."""
    rows = spark.createDataFrame([(p, os.path.abspath(p)) for p in paths], "path string, absolute string")  # workers have a folder of their own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["path", "length", "mtime", "permissions", "error_kind", "error_message"]
        for batch in batches:
            found = list(zip(*map(stat, batch.column(0).to_pylist(), batch.column(1).to_pylist()), strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, kinds, strict=True)], names)

    return rows.mapInArrow(run, STAT)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Whole files: path, data, mtime, permissions, error_kind, error_message; a wrong path is a row with an error."""
    known = listing(spark, paths)
    good = [os.path.abspath(p) for p in paths if os.path.isfile(p)]  # `binaryFile` fails on a path that is not there
    empty = "path string, modificationTime timestamp, length long, content binary"
    files = spark.read.format("binaryFile").load(good) if good else spark.createDataFrame([], empty)
    content = files.select(F.regexp_replace("path", "^file:/*", "/").alias("_path"), F.col("content").alias("data"))
    names = spark.createDataFrame([(p, os.path.abspath(p)) for p in dict.fromkeys(paths)], "path string, _path string")
    absolute = known.join(names, "path")
    return absolute.join(content, "_path", "left").select("path", "data", "mtime", "permissions", "error_kind", "error_message")


def read_folder(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """Every non-empty file under a folder of any file system: path, data and mtime. Filters on length and
    modificationTime reach the listing; content is read only where it is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)
    return files.select("path", F.col("content").alias("data"), F.unix_seconds("modificationTime").alias("mtime"), "length")


def from_bytes(spark: SparkSession, data: bytes, path: str = "-") -> DataFrame:
    """In-memory bytes, or standard input, as one row without attributes."""
    return spark.createDataFrame([(path, bytearray(data))], "path string, data binary")


def check_target(path: str, force: bool) -> str | None:
    """Why a file cannot be written; None if it can."""
    if os.path.exists(path) and not force:
        return f"Output file already exists: {path}. Use --force to overwrite."
    parent = os.path.dirname(path)
    return f"Output directory does not exist: {parent}" if parent and not os.path.isdir(parent) else None


@dataclass
class Written(WriterCommitMessage):
    """The temporary and final names of a task's files, and its warnings."""

    files: list[tuple[str, str]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


class FileWriter(DataSourceWriter):
    """Rows (target, content, mtime, permissions) become files; mtime and permissions are restored where not null."""

    def __init__(self, options: dict[str, str]):
        self.force = str(options.get("force", "false")).lower() == "true"

    def write(self, iterator: Iterator[Row]) -> Written:
        done = Written()
        try:
            for row in iterator:
                if why := check_target(row["target"], self.force):
                    raise FileExistsError(why)
                temporary = f"{row['target']}.{uuid.uuid4().hex}.tmp"
                done.files.append((temporary, row["target"]))
                with open(temporary, "wb") as out:
                    out.write(row["content"] or b"")
                done.warnings += restore_attributes(temporary, row["mtime"], row["permissions"])
        except BaseException:
            self._remove([done])
            raise
        return done

    @staticmethod
    def _remove(messages: list[Written | None]) -> None:
        for message in messages:
            for temporary, _ in message.files if message else []:
                if os.path.exists(temporary):
                    os.remove(temporary)

    def commit(self, messages: list[Written | None]) -> None:
        targets = [t for m in messages for _, t in (m.files if m else [])]
        twice = sorted({t for t in targets if targets.count(t) > 1}) if len(set(targets)) < len(targets) else []
        if twice and not self.force:
            self._remove(messages)
            raise FileExistsError(f"Output file already exists: {twice[0]}. Use --force to overwrite.")
        for message in messages:
            for temporary, target in message.files if message else []:
                os.replace(temporary, target)

    def abort(self, messages: list[Written | None]) -> None:
        self._remove(messages)


def restore_attributes(path: str, mtime: int | None, permissions: int | None) -> list[str]:
    """Set modification time, then mode; what fails is a warning."""
    warnings = []
    for value, what, apply in ((mtime, "modification time", lambda v: os.utime(path, (v, v))), (permissions, "permissions", lambda v: os.chmod(path, modes.S_IMODE(v)))):
        if value is not None:
            try:
                apply(value)
            except (OSError, OverflowError) as e:
                warnings.append(f"Failed to set {what} of {path}: {e}")
    return warnings


class FileSink(DataSource):
    """`df.write.format("frame_files")`: a file for each row. Local and shared POSIX paths only."""

    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> str:
        return "target string, content binary, mtime long, permissions long"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(dict(self.options) | ({"force": "true"} if overwrite else {}))


def write_files(df: DataFrame, target: str, content: str, mtime: str | None = None, permissions: str | None = None, force: bool = False) -> None:
    """Write a binary column to the files that another column names; nothing stays of a write that fails."""
    df.sparkSession.dataSource.register(FileSink)
    pick = lambda name: (F.col(name) if name else F.lit(None)).cast("long")
    rows = df.select(F.col(target).alias("target"), F.col(content).alias("content"), pick(mtime).alias("mtime"), pick(permissions).alias("permissions"))
    rows.write.format("frame_files").option("force", str(force).lower()).mode("append").save()


def write_report(lines: DataFrame, path: str, header: str | None = None) -> None:
    """A report as one text: lines in the order of the DataFrame, meant for the explicit file lists of the CLI."""
    text = [r[0] for r in lines.toLocalIterator()]
    with open(path, "w", encoding="utf-8") as out:
        out.writelines(f"{x}\n" for x in ([header] if header else []) + text)
