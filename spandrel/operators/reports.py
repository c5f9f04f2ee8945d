"""Summaries and reports of inspected frames.

Aggregates and report lines are native. The human forms are small texts that the driver formats, since their rounding is
that of exact binary values.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.report import magic_text, ratio, reduction
from .codecs import CodecInfo

CSV_HEADER = "file_path,original_size,compressed_size,compression_ratio,plugin,crc_valid"


def summarise(inspected: DataFrame, *keys: str) -> DataFrame:
    """Files, total sizes (DECIMAL, which 64-bit sums cannot overflow), overall reduction and whether all checksums hold."""
    rows = inspected.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum(F.col("original_size").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("total_original"),
        F.coalesce(F.sum(F.col("compressed_size").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("total_compressed"),
        F.coalesce(F.bool_and("crc_valid"), F.lit(True)).alias("all_crc_valid"),
    )
    return rows.withColumn("reduction", reduction(F.col("total_original"), F.col("total_compressed")))


def _first_above(tenth: int) -> float:
    """The first double that rounds up from this tenth: beyond the tie in the middle, or at it where the tenth is odd."""
    near, tie = (2 * tenth + 1) / 20, Fraction(2 * tenth + 1, 20)
    return near if Fraction(near) > tie or (Fraction(near) == tie and tenth % 2) else math.nextafter(near, 1.0)


def one_decimal(number: Column) -> Column:
    """A double with one digit, rounded by its exact binary value, ties to even; NULL from 2 ** 115 on, beyond any ratio.

    Scaled to integers, small and large numbers lose bits and look like ties. Whole part and rest of a double are doubles,
    and the rest is compared with the bounds of the ten tenths.
    """
    size, unit = F.when(F.abs(number) < F.lit(2.0**115), F.abs(number)), 2**53
    high = F.floor(size / F.lit(float(unit)))
    low = size - high * F.lit(float(unit))
    rest = low - F.floor(low)
    tenths = reduce(add, ((rest >= F.lit(_first_above(t))).cast("int") for t in range(10)))
    whole = high.cast("decimal(20,0)") * F.lit(unit).cast("decimal(16,0)") + F.floor(low) + F.when(tenths == 10, 1).otherwise(0)
    return F.concat(F.when(number < 0, "-").otherwise(""), whole.cast("string"), F.lit("."), (tenths % 10).cast("string"))


def csv_lines(inspected: DataFrame, path: str = "path", *keys: str) -> DataFrame:
    """One line a frame, unquoted, to be written with the text writer under CSV_HEADER; beside key columns, if any. NULL
    where a field is, as those of a frame with an error are."""
    share = one_decimal(ratio(F.col("original_size"), F.col("compressed_size")))
    parts = [F.col(path), F.col("original_size").cast("string"), F.col("compressed_size").cast("string"), share, F.col("plugin_name"), F.col("crc_valid").cast("string")]
    return inspected.select(*keys, F.concat(parts[0], *(x for part in parts[1:] for x in (F.lit(","), part))).alias("value"))


def json_objects(inspected: DataFrame, *keys: str) -> DataFrame:
    """One JSON object a frame: without its path, and with nulls kept; beside key columns, if any."""
    one = F.struct("original_size", "compressed_size", "plugin_name", "crc_valid", F.struct("mtime", "permissions").alias("metadata"))
    return inspected.select(*keys, F.to_json(one, {"ignoreNullFields": "false"}).alias("value"))


def codec_objects(registry: DataFrame) -> DataFrame:
    """One JSON object a codec."""
    one = F.struct("name", "version", magic_text(F.col("magic")).alias("magic_number"), F.col("throughput").alias("throughput_mbps"), "compression_ratio", "description")
    return registry.select(F.to_json(one).alias("value"))


def _percent(original: int, packed: int) -> float:
    return packed / original * 100.0 if original else 0.0


def human_inspect(path: str, row: Row) -> str:
    share = _percent(int(row["original_size"]), int(row["compressed_size"]))
    less = 100.0 - share
    kind = "compressed" if less > 0 else "expanded"
    change = f"{less:.1f}% ({kind} to {share:.1f}% of original)" if less else "0.0% (same size)"
    lines = [f"File: {path}", f"  Original size: {row['original_size']}", f"  Compressed size: {row['compressed_size']}", f"  Size reduction: {change}", f"  Plugin: {row['plugin_name']}", f"  CRC32: {'VALID' if row['crc_valid'] else 'INVALID'}"]
    return "\n".join(lines + ([f"  Modification time: {row['mtime']}"] if row["mtime"] is not None else []))


def human_summary(rows: list[tuple[str, Row]]) -> str:
    """The summary of an explicit list of files."""
    original, packed = (sum(int(r[c]) for _, r in rows) for c in ("original_size", "compressed_size"))
    each = [f"  File: {p} | Original: {r['original_size']} | Compressed: {r['compressed_size']} | Plugin: {r['plugin_name']} | CRC: {'VALID' if r['crc_valid'] else 'INVALID'}" for p, r in rows]
    totals = [f"  Total Files: {len(rows)}", f"  Total Original Size: {original}", f"  Total Compressed Size: {packed}", f"  Overall Size Reduction: {100.0 - _percent(original, packed):.1f}%", f"  All CRC Valid: {str(all(r['crc_valid'] for _, r in rows)).lower()}"]
    return "\n".join(["", "--- Summary ---", *each, "-----------------", *totals])


def human_compressed(source: str, target: str, original: int, packed: int, seconds: float, plugin: str) -> str:
    less = 100.0 - _percent(original, packed)
    change = f"{abs(less):.1f}% {'smaller' if less > 0 else 'larger'}" if less else "same size"
    return f"Compressed {source} -> {target} ({change}, {_speed(original, seconds):.1f} MB/s, {plugin})"


def human_restored(source: str, target: str, size: int, seconds: float) -> str:
    return f"Decompressed {source} -> {target} ({_speed(size, seconds):.1f} MB/s)"


def _speed(size: int, seconds: float) -> float:
    return size / 1048576.0 / seconds if seconds > 0 else 0.0


def human_codecs(infos: list[CodecInfo]) -> str:
    if not infos:
        return "No plugins registered"
    head = f"{'Name':<15} {'Version':<10} {'Throughput':<15} {'Compression':<15} Description"
    rows = [f"{i.name:<15} {i.version:<10} {i.throughput:<13.1f} MB/s {i.compression_ratio * 100:<13.1f}% {i.description}" for i in infos]
    return "\n".join([head, "-" * 80, *rows, "", f"Total plugins: {len(infos)}"])


def human_codec(info: CodecInfo) -> str:
    return "\n".join([f"Plugin: {info.name}", f"Version: {info.version}", f"Magic Number: 0x{info.magic.upper()}", "", "Performance Characteristics:", f"  Throughput: {info.throughput:.1f} MB/s", f"  Compression Ratio: {info.compression_ratio * 100:.1f}%", "", "Description:", f"  {info.description}"])
