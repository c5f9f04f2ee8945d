"""Derived numbers, names and messages of frame processing, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a frame file is called; a deployment may choose its own.
SUFFIX = ".frame"
#: Files beyond this many bytes are worth a progress display.
LARGE = 1 << 20
# The weights (throughput, ratio) of each level.
LEVELS = {"fast": (0.9, 0.1), "balanced": (0.5, 0.5), "best": (0.1, 0.9), "library": (0.7, 0.3)}


def ratio(original: Column, packed: Column) -> Column:
    """Packed size in percent of the original; 0 where the original is empty."""
    return F.when(original > 0, packed.cast("double") / original.cast("double") * 100.0).otherwise(F.lit(0.0))


def reduction(original: Column, packed: Column) -> Column:
    return F.lit(100.0) - ratio(original, packed)


def throughput(size: Column, seconds: Column) -> Column:
    """MiB a second; 0 where no time passed."""
    return F.when(seconds > 0, size.cast("double") / F.lit(1048576.0) / seconds).otherwise(F.lit(0.0))


def is_large(size: Column) -> Column:
    return size > LARGE


def magic_text(digits: Column) -> Column:
    return F.concat(F.lit("0x"), F.upper(digits))


def _name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*/)?[^/]*$", 1)


def _stem(name: Column) -> Column:
    """A file name without its last extension; a leading dot is part of the stem."""
    return F.regexp_replace(name, "^(.+)\\.[^.]*$", "$1")


def frame_path(path: Column, directory: Column | None = None, suffix: str = SUFFIX) -> Column:
    """Where a file's frame goes: the suffix is appended, or replaces the extension inside a given directory (so that
    a.txt and a.csv share a name there, which the writer reports)."""
    if directory is None:
        return F.concat(path, F.lit(suffix))
    return F.concat(F.regexp_replace(directory, "^(.*?)/*$", "$1/"), _stem(_name(path)), F.lit(suffix))


def restored_path(path: Column, directory: Column | None = None, suffix: str = SUFFIX) -> Column:
    """Where a frame's content goes: the suffix is stripped, or else the last extension."""
    name = _name(path)
    bare = F.when(name.endswith(suffix) & (F.length(name) > len(suffix)), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(_stem(name))
    return F.concat(_folder(path) if directory is None else F.regexp_replace(directory, "^(.*?)/*$", "$1/"), bare)


# Error kinds by family, which decides the exit code.
CORE = ("InvalidMagic", "CrcMismatch", "InvalidHeader", "CorruptedData", "InvalidWeights", "InvalidMetadata", "NotFound", "DuplicateMagic", "InvalidCodec", "OperationFailed", "Timeout", "Panic", "Io")
USAGE = ("Config", "InvalidInput")
STOPPED = ("Cancelled", "Interrupted")


def exit_code(kind: Column) -> Column:
    """0 without an error, 1 for failures, 2 for wrong usage or configuration, 130 when interrupted."""
    return F.when(kind.isNull(), 0).when(kind.isin(*USAGE), 2).when(kind.isin(*STOPPED), 130).otherwise(1)


def friendly(kind: Column, message: Column) -> Column:
    """What a user is told about an error."""
    return (
        F.when(kind == "InvalidHeader", "Not a valid archive: invalid file header")
        .when(kind == "InvalidMagic", "Not a valid archive: invalid magic number")
        .when(kind == "CrcMismatch", F.concat(F.lit("File corrupted: CRC32 checksum mismatch ("), F.regexp_replace(message, "^CRC32 mismatch: ", ""), F.lit("). The compressed file may be damaged.")))
        .when(kind == "NotFound", F.concat(F.lit("Compression plugin '"), message, F.lit("' not found. List the codecs to see what is available.")))
        .when(kind == "Timeout", F.concat(F.lit("Compression timeout after "), F.floor(F.coalesce(F.regexp_extract(message, "([0-9.]+)s$", 1).try_cast("double"), F.lit(0.0))).cast("string"), F.lit("s")))
        .when(kind == "Panic", "Plugin panicked during execution")
        .when(kind.isin(*STOPPED), "Operation cancelled")
        .otherwise(message)
    )
