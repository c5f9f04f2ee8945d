"""The query catalogue: each operator applied to whole tables, with the SQL that gives the same rows.

Results use plain types (hex text for binary, BIGINT or DOUBLE for numbers). DuckDB has neither DEFLATE nor CRC-32, so the
SQL derives what a correct frame must show: sizes, flags, routing, errors and content.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import report, wire
from ..operators import reports, selection
from ..operators.codecs import REGISTRY_SCHEMA, SELF_TEST, FrameError, default_registry
from ..operators.frames import Options, compress, decompress, inspect, self_test
from . import config

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def payloads(spark: SparkSession, sf_dir: str, name: str, text: str, *keys: str) -> DataFrame:
    """Key columns and `data`, the bytes of a text column."""
    return table(spark, sf_dir, name).select(*keys, F.encode(text, "UTF-8").alias("data"))


def _text(binary: str) -> Column:
    return F.decode(binary, "UTF-8")


def documents(spark: SparkSession, sf_dir: str, options: Options | None = None) -> DataFrame:
    return compress(payloads(spark, sf_dir, "documents", "text", "doc_id", "lang"), options=options)


# --- header ----------------------------------------------------------------------------------------------------------


@query(
    "header_encode",
    f"""SELECT doc_id, '43520100' || (SELECT string_agg(substr(printf('%016X', octet_length(encode(text))), 15 - 2 * i, 2), '' ORDER BY i) FROM range(8) t(i)) || '01000000' AS header_hex
        FROM documents""",
)
def header_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of every document's frame, without a codec."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.hex(wire.header(F.octet_length(F.encode("text", "UTF-8")), wire.FLAG_CRC)).alias("header_hex"))


@query(
    "header_decode",
    """SELECT l_orderkey, l_linenumber, '43520100' AS magic, CAST(l_orderkey * 1000003 + l_linenumber AS BIGINT) AS original_size,
              CAST(l_linenumber % 4 AS INTEGER) AS flags, CAST(0 AS INTEGER) AS codec_id, true AS prefix_ok, true AS version_ok,
              l_linenumber % 2 = 1 AS has_crc, l_linenumber % 4 >= 2 AS has_metadata FROM lineitem""",
)
def header_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of made-up sizes and flags for every line item, encoded and decoded."""
    size = F.col("l_orderkey") * 1000003 + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", wire.header(size, F.col("l_linenumber") % 4).alias("h"))
    h = F.col("h")
    return rows.select(
        "l_orderkey", "l_linenumber", wire.magic(h).alias("magic"), wire.original_size(h).cast("long").alias("original_size"), wire.flags(h).alias("flags"), wire.codec_id(h).alias("codec_id"),
        wire.has_prefix(h).alias("prefix_ok"), wire.has_version(h).alias("version_ok"), wire.has_crc(h).alias("has_crc"), wire.has_metadata(h).alias("has_metadata"),
    )


# --- round trips -----------------------------------------------------------------------------------------------------


def _roundtrip(name: str, source: str, text: str, *keys: str) -> None:
    @query(name, f"SELECT {', '.join(keys)}, {text} AS restored, CAST(NULL AS VARCHAR) AS error_kind FROM {source}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = compress(payloads(spark, sf_dir, source, text, *keys)).drop("data")
        return decompress(frames).select(*keys, _text("data").alias("restored"), "error_kind")


_roundtrip("roundtrip_documents", "documents", "text", "doc_id")
_roundtrip("roundtrip_pages", "pages", "html", "page_id")
_roundtrip("roundtrip_conversations", "conversations", "text", "conv_id", "turn")
_roundtrip("roundtrip_events", "events", "props", "event_id")


@query("compression_effect")
def compression_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes before and after. Encoders differ in their output, so no SQL can tell the packed size."""
    rows = documents(spark, sf_dir)
    size, packed = F.octet_length("data").cast("long"), F.octet_length("frame").cast("long")
    return rows.select("doc_id", size.alias("original_size"), packed.alias("compressed_size"), report.ratio(size, packed).alias("ratio"), (packed < size).alias("smaller"))


# --- inspection ------------------------------------------------------------------------------------------------------


@query(
    "inspect_documents",
    """SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS original_size, 'deflate' AS plugin_name, true AS crc_valid,
              doc_id * 86400 - 5 AS mtime, 33188 + doc_id % 512 AS permissions, CAST(NULL AS VARCHAR) AS error_kind FROM documents""",
)
def inspect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with attributes, inspected without being decoded."""
    docs = payloads(spark, sf_dir, "documents", "text", "doc_id")
    docs = docs.withColumn("t", F.col("doc_id") * 86400 - 5).withColumn("p", F.col("doc_id") % 512 + 33188)
    frames = compress(docs, options=Options(mtime="t", permissions="p")).select("doc_id", "frame")
    return inspect(frames).select("doc_id", F.col("original_size").cast("long").alias("original_size"), "plugin_name", "crc_valid", "mtime", "permissions", "error_kind")


_SUMMARY = "count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS total_original, true AS all_crc_valid"


def _summary(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    rows = reports.summarise(inspect(documents(spark, sf_dir).select(*keys, "frame")), *keys)
    return rows.select(*keys, "files", F.col("total_original").cast("long").alias("total_original"), "all_crc_valid")


@query("inspect_summary", f"SELECT {_SUMMARY} FROM documents")
def inspect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: frames of all documents, inspected and summed up; partial sums, then one row."""
    return _summary(spark, sf_dir)


@query("inspect_summary_by_lang", f"SELECT lang, {_SUMMARY} FROM documents GROUP BY lang")
def inspect_summary_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, "lang")


def flip(frame: Column, at: Column) -> Column:
    """A frame with one byte (from 1) changed: all bits of it inverted."""
    byte = F.hex((F.lit(255) - wire.unsigned(frame.substr(at, F.lit(1)), 1)).cast("long"))
    return F.concat(frame.substr(F.lit(1), at - 1), F.unhex(F.lpad(byte, 2, "0")), frame.substr(at + 1, F.octet_length(frame)))


@query("corrupt_crc", "SELECT doc_id, doc_id % 5 <> 0 AS crc_valid, CASE WHEN doc_id % 5 = 0 THEN 'CrcMismatch' END AS error_kind FROM documents")
def corrupt_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One byte behind the header of every fifth frame changed: inspection flags it, decompression fails."""
    rows = documents(spark, sf_dir).select("doc_id", "frame")
    rows = rows.withColumn("frame", F.when(F.col("doc_id") % 5 == 0, flip(F.col("frame"), F.lit(17) + F.col("doc_id") % 6)).otherwise(F.col("frame")))
    return decompress(inspect(rows).drop("error_kind", "error_message", "mtime", "permissions")).select("doc_id", "crc_valid", "error_kind")


_DAMAGE = """SELECT doc_id, CASE doc_id % 9 WHEN 1 THEN 'InvalidHeader' WHEN 2 THEN 'InvalidMagic' WHEN 3 THEN 'InvalidHeader'
    WHEN 4 THEN 'InvalidHeader' WHEN 5 THEN 'CrcMismatch' WHEN 6 THEN 'NotFound' WHEN 7 THEN 'CorruptedData' WHEN 8 THEN 'InvalidMetadata' END AS error_kind FROM documents"""


def damaged(rows: DataFrame) -> DataFrame:
    """Frames damaged in eight ways, by doc_id: cut short, prefix, version, missing checksum, checksum, codec, size,
    attributes. The remainder 0 stays whole."""
    f, kind = F.col("frame"), F.col("doc_id") % 9
    part = lambda a, n=None: f.substr(F.lit(a), F.octet_length(f) if n is None else F.lit(n))
    bad = F.unhex(F.lit("0104000000"))
    body = F.concat(wire.le(F.lit(5), 2), bad, part(21))
    made = (
        F.when(kind == 1, part(1, 15))
        .when(kind == 2, F.concat(F.unhex(F.lit("FFFF")), part(3)))
        .when(kind == 3, F.concat(part(1, 2), F.unhex(F.lit("02")), part(4)))
        .when(kind == 4, part(1, 18))
        .when(kind == 5, flip(f, F.octet_length(f)))
        .when(kind == 6, F.concat(part(1, 3), F.unhex(F.lit("FF")), part(5)))
        .when(kind == 7, F.concat(part(1, 4), wire.le(wire.original_size(f).cast("long") + 1, 8), part(13)))
        .when(kind == 8, F.concat(part(1, 12), F.unhex(F.lit("03000000")), wire.le(F.crc32(body), 4), body))
        .otherwise(f)
    )
    return rows.withColumn("frame", made)


@query("validation_taxonomy", _DAMAGE)
def validation_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of error that decompression reports."""
    return decompress(damaged(documents(spark, sf_dir).select("doc_id", "frame"))).select("doc_id", "error_kind")


@query(
    "error_exit_codes",
    f"""SELECT doc_id, error_kind, CAST(CASE WHEN error_kind IS NULL THEN 0 ELSE 1 END AS INTEGER) AS exit_code,
               CASE error_kind WHEN 'InvalidHeader' THEN 'Not a valid archive: invalid file header' WHEN 'InvalidMagic' THEN 'Not a valid archive: invalid magic number' END AS told
        FROM ({_DAMAGE})""",
)
def error_exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes, and what users are told where that is a fixed text."""
    rows = decompress(damaged(documents(spark, sf_dir).select("doc_id", "frame")))
    told = F.when(F.col("error_kind").isin("InvalidHeader", "InvalidMagic"), report.friendly(F.col("error_kind"), F.col("error_message")))
    return rows.select("doc_id", "error_kind", report.exit_code(F.col("error_kind")).alias("exit_code"), told.alias("told"))


@query(
    "exit_code_table",
    """SELECT * FROM (VALUES ('InvalidMagic', 1), ('CrcMismatch', 1), ('InvalidHeader', 1), ('CorruptedData', 1), ('InvalidWeights', 1), ('InvalidMetadata', 1), ('NotFound', 1),
       ('DuplicateMagic', 1), ('InvalidCodec', 1), ('OperationFailed', 1), ('Timeout', 1), ('Panic', 1), ('Io', 1), ('Config', 2), ('InvalidInput', 2), ('Cancelled', 130), ('Interrupted', 130)) t(kind, code)""",
)
def exit_code_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(k,) for k in (*report.CORE, *report.USAGE, *report.STOPPED)], "kind string")
    return rows.withColumn("code", report.exit_code(F.col("kind")))


@query(
    "truncation_taxonomy",
    """SELECT doc_id, CAST(n AS INTEGER) AS cut, 'InvalidHeader' AS kind_inspect, CASE WHEN n < 20 THEN 'InvalidHeader' ELSE 'CrcMismatch' END AS kind_decompress
       FROM documents, (VALUES (5), (10), (16), (18), (21), (25)) t(n)""",
)
def truncation_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with attributes, cut at six lengths: with a checksum, decompression sees the mismatch before the cut."""
    docs = payloads(spark, sf_dir, "documents", "text", "doc_id").withColumn("t", F.lit(1234567890))
    frames = compress(docs, options=Options(mtime="t")).select("doc_id", "frame")
    cuts = frames.withColumn("cut", F.explode(F.array(*map(F.lit, (5, 10, 16, 18, 21, 25))))).withColumn("frame", F.col("frame").substr(F.lit(1), F.col("cut")))
    seen = inspect(cuts).select("doc_id", "cut", "frame", F.col("error_kind").alias("kind_inspect"))
    return decompress(seen).select("doc_id", "cut", "kind_inspect", F.col("error_kind").alias("kind_decompress"))


# --- attributes ------------------------------------------------------------------------------------------------------

_HEX = "(SELECT string_agg(substr(printf('%016X', {0}), 15 - 2 * i, 2), '' ORDER BY i) FROM range({1}) t(i))"
_ORDERED = "CAST(epoch(o_orderdate) AS BIGINT)"
_SHAPE = "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN {t} WHEN 2 THEN {p} ELSE {t} || {p} END"


def _attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    when = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    mtime = F.when(F.col("o_orderkey") % 4 % 2 == 1, when)
    permissions = F.when(F.col("o_orderkey") % 4 >= 2, F.col("o_custkey") % 4096)
    return orders.select("o_orderkey", wire.attributes(mtime, permissions).alias("raw"))


@query(
    "metadata_tlv_encode",
    "SELECT o_orderkey, " + _SHAPE.format(t="('0108' || " + _HEX.format(_ORDERED, 8) + ")", p="('0204' || " + _HEX.format("o_custkey % 4096", 4) + ")") + " AS attributes_hex FROM orders",
)
def metadata_tlv_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute records with both, either or none of the attributes."""
    return _attributes(spark, sf_dir).select("o_orderkey", F.hex("raw").alias("attributes_hex"))


@query(
    "metadata_tlv_decode",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 % 2 = 1 THEN {_ORDERED} END AS mtime, CASE WHEN o_orderkey % 4 >= 2 THEN o_custkey % 4096 END AS permissions,
               CASE o_orderkey % 5 WHEN 1 THEN 'Incomplete TLV record' WHEN 2 THEN 'Incomplete TLV value' WHEN 3 THEN 'Invalid mtime length' WHEN 4 THEN 'Invalid permissions length' END AS error FROM orders""",
)
def metadata_tlv_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records behind an unknown tag, read again; by key with a damaged record at the end."""
    tail = F.when(F.col("o_orderkey") % 5 == 1, "01").when(F.col("o_orderkey") % 5 == 2, "010800").when(F.col("o_orderkey") % 5 == 3, "010400000000").when(F.col("o_orderkey") % 5 == 4, "02020000").otherwise("")
    rows = _attributes(spark, sf_dir).withColumn("raw", F.concat(F.unhex(F.lit("7F02AAAA")), "raw", F.unhex(tail)))
    read = rows.withColumn("a", wire.read_attributes(F.col("raw")))
    return read.select("o_orderkey", "a.mtime", "a.permissions", "a.error")


# --- registry and selection ------------------------------------------------------------------------------------------

_CODECS = [
    (0, "deflate", "1.0.0", "43520100", 200.0, 0.35, ""),
    (1, "fast", "1.0.0", "43520101", 1000.0, 0.8, ""),
    (2, "slow", "1.0.0", "43520102", 100.0, 0.3, ""),
    (3, "late", "1.0.0", "43520101", 500.0, 0.5, ""),
    (4, "", "1.0.0", "43520104", 500.0, 0.5, ""),
    (5, "bare", "", "43520105", 500.0, 0.5, ""),
    (6, "idle", "1.0.0", "43520106", -10.0, 0.5, ""),
    (7, "wide", "1.0.0", "43520107", 500.0, 1.5, ""),
]
_VALUES = "(VALUES " + ", ".join(f"({r[0]}, '{r[1]}', '{r[2]}', '{r[3]}', {r[4]!r}::DOUBLE, {r[5]!r}::DOUBLE)" for r in _CODECS) + ") t(reg_order, name, version, magic, throughput, compression_ratio)"


def codecs(spark: SparkSession, *keep: str) -> DataFrame:
    """A registry of made-up codecs, all or some of them."""
    rows = spark.createDataFrame(_CODECS, REGISTRY_SCHEMA)
    return rows.filter(F.col("name").isin(*keep)) if keep else rows


@query(
    "registry_validate",
    f"""SELECT name, magic, CASE WHEN name = '' THEN 'Plugin name cannot be empty' WHEN version = '' THEN 'Plugin version cannot be empty'
        WHEN throughput <= 0 THEN 'Plugin ' || name || ' has invalid throughput: ' || throughput
        WHEN compression_ratio <= 0 OR compression_ratio > 1 THEN 'Plugin ' || name || ' has invalid compression ratio: ' || compression_ratio END AS problem FROM {_VALUES}""",
)
def registry_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.problems(codecs(spark)).select("name", "magic", "problem")


@query("registry_dedup", f"SELECT magic, arg_min(name, reg_order) AS name FROM {_VALUES} GROUP BY magic")
def registry_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of codecs with one identifier the first registered stays."""
    return selection.first_registered(codecs(spark)).select("magic", "name")


@query("registry_counts", f"SELECT magic, count(*) AS codecs FROM {_VALUES} GROUP BY magic")
def registry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.counted(codecs(spark))


@query("registry_names", f"SELECT string_agg(name, ', ' ORDER BY name) AS available FROM {_VALUES} WHERE name IN ('deflate', 'fast', 'slow')")
def registry_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.names(codecs(spark, "deflate", "fast", "slow"))


@query("registry_list", "SELECT 'deflate' AS name, '1.0.0' AS version, '0x43520100' AS magic_number, 200.0::DOUBLE AS throughput, 0.35::DOUBLE AS compression_ratio, 'Standard DEFLATE compression (RFC 1951)' AS description")
def registry_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codecs that are installed by default."""
    rows = default_registry().frame(spark)
    return rows.select("name", "version", report.magic_text(F.col("magic")).alias("magic_number"), "throughput", "compression_ratio", "description")


@query("codec_by_name", f"SELECT 'exact' AS lookup, name, magic FROM {_VALUES} WHERE name = 'fast' UNION ALL SELECT 'any case', name, magic FROM {_VALUES} WHERE lower(name) = 'slow'")
def codec_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups by name: exact, and in any case; a name in another case is not found exactly."""
    found = [("exact", selection.named(codecs(spark), "fast")), ("any case", selection.named(codecs(spark), "SLOW", True)), ("none", selection.named(codecs(spark), "SLOW"))]
    rows = [df.select(F.lit(how).alias("lookup"), "name", "magic") for how, df in found]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


def _score_sql(t: float, r: float) -> str:
    return f"""SELECT name, round({t} * (ln(throughput) - min(ln(throughput)) OVER ()) / (max(ln(throughput)) OVER () - min(ln(throughput)) OVER ())
        + {r} * (max(compression_ratio) OVER () - compression_ratio) / (max(compression_ratio) OVER () - min(compression_ratio) OVER ()), 9) AS score
        FROM {_VALUES} WHERE name IN ('deflate', 'fast', 'slow')"""


def _scores(level: str) -> None:
    weights = report.LEVELS[level]

    @query(f"codec_scores_{level}", _score_sql(*weights))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = selection.scored(codecs(spark, "deflate", "fast", "slow"), weights)
        return rows.select("name", F.round("score", 9).alias("score"))


for _level in report.LEVELS:
    _scores(_level)


@query("codec_select", " UNION ALL ".join(f"(SELECT '{k}' AS level, name FROM ({_score_sql(*w)}) ORDER BY score DESC, name LIMIT 1)" for k, w in report.LEVELS.items()))
def codec_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codec each level chooses."""
    rows = [selection.selected(codecs(spark, "deflate", "fast", "slow"), w).select(F.lit(k).alias("level"), "name") for k, w in report.LEVELS.items()]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3])


@query("codec_tie_break", "SELECT 'fast' AS name, 0.5::DOUBLE AS score")
def codec_tie_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two codecs with equal scores: the first by name."""
    return selection.selected(codecs(spark, "fast", "slow"), (0.5, 0.5)).select("name", F.round("score", 9).alias("score"))


@query("codec_single", "SELECT 'deflate' AS name, 1.0::DOUBLE AS score")
def codec_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lone codec always scores 1."""
    return selection.selected(codecs(spark, "deflate"), report.LEVELS["balanced"]).select("name", "score")


_MAGIC = "CASE doc_id % 3 WHEN 0 THEN '43520100' WHEN 1 THEN '43520101' ELSE '435201FF' END"


def _magics(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id") % 3
    return table(spark, sf_dir, "documents").select("doc_id", F.when(key == 0, "43520100").when(key == 1, "43520101").otherwise("435201FF").alias("magic"))


@query("route_join", f"SELECT doc_id, m AS magic, CASE m WHEN '43520100' THEN 'deflate' WHEN '43520101' THEN 'fast' END AS plugin_name FROM (SELECT doc_id, {_MAGIC} AS m FROM documents)")
def route_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames to codecs by identifier."""
    return selection.routed(_magics(spark, sf_dir), selection.first_registered(codecs(spark))).select("doc_id", "magic", "plugin_name")


@query("route_anti", f"SELECT doc_id, m AS magic FROM (SELECT doc_id, {_MAGIC} AS m FROM documents) WHERE m = '435201FF'")
def route_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that no codec claims."""
    return selection.unknown(_magics(spark, sf_dir), selection.first_registered(codecs(spark))).select("doc_id", "magic")


@query("codec_self_test", f"SELECT 'deflate' AS name, CAST(length('{SELF_TEST}') AS BIGINT) AS original_size, true AS passed")
def codec_self_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every installed codec on a fixed text, forth and back."""
    return self_test(spark)


# --- derived numbers and names ---------------------------------------------------------------------------------------


@query(
    "ratio_throughput",
    """SELECT l_orderkey, l_linenumber, CASE WHEN a > 0 THEN b / a * 100.0 ELSE 0.0 END AS ratio, 100.0 - CASE WHEN a > 0 THEN b / a * 100.0 ELSE 0.0 END AS reduction,
              CASE WHEN s > 0 THEN a / 1048576.0::DOUBLE / s ELSE 0.0 END AS mbps, a > 1048576 AS is_large
       FROM (SELECT l_orderkey, l_linenumber, CAST(CAST(floor(l_quantity) AS BIGINT) % 10 * 200000 AS DOUBLE) AS a, CAST(floor(l_extendedprice) AS DOUBLE) AS b,
                    CASE WHEN l_linenumber = 1 THEN 0.0::DOUBLE ELSE l_discount + 0.5 END AS s FROM lineitem)""",
)
def ratio_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio, reduction and throughput over made-up sizes and times of all line items, with empty originals and no time."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") % 10 * 200000).alias("a"), F.col("l_extendedprice").cast("long").alias("b"),
        F.when(F.col("l_linenumber") == 1, F.lit(0.0)).otherwise(F.col("l_discount") + 0.5).alias("s"),
    )
    a, b, s = F.col("a"), F.col("b"), F.col("s")
    return rows.select("l_orderkey", "l_linenumber", report.ratio(a, b).alias("ratio"), report.reduction(a, b).alias("reduction"), report.throughput(a, s).alias("mbps"), report.is_large(a).alias("is_large"))


_PATHS = "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'in/p' || page_id || '.txt' WHEN 1 THEN 'in/p' || page_id || '.tar.gz' WHEN 2 THEN 'p' || page_id ELSE 'in.d/p' || page_id || '.csv' END AS path FROM pages"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    made = F.when(k == 0, F.concat(F.lit("in/p"), i, F.lit(".txt"))).when(k == 1, F.concat(F.lit("in/p"), i, F.lit(".tar.gz"))).when(k == 2, F.concat(F.lit("p"), i)).otherwise(F.concat(F.lit("in.d/p"), i, F.lit(".csv")))
    return table(spark, sf_dir, "pages").select("page_id", made.alias("path"))


@query(
    "output_paths",
    f"""SELECT page_id, path, path || '.frame' AS packed,
               'out/' || CASE page_id % 4 WHEN 1 THEN 'p' || page_id || '.tar' ELSE 'p' || page_id END || '.frame' AS packed_in_folder,
               path AS restored, CASE page_id % 4 WHEN 0 THEN 'in/p' || page_id WHEN 1 THEN 'in/p' || page_id || '.tar' WHEN 2 THEN path ELSE 'in.d/p' || page_id END AS without_suffix
        FROM ({_PATHS})""",
)
def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where frames and restored files go: beside the input, in a folder, and for names without the suffix."""
    rows = _paths(spark, sf_dir).withColumn("packed", report.frame_path(F.col("path")))
    return rows.select("page_id", "path", "packed", report.frame_path(F.col("path"), F.lit("out")).alias("packed_in_folder"), report.restored_path(F.col("packed")).alias("restored"), report.restored_path(F.col("path")).alias("without_suffix"))


@query(
    "report_csv",
    """SELECT doc_id, 'd' || doc_id || ',' || n || ',' || c || ',' || (CASE WHEN n > 0 THEN printf('%.1f', c::DOUBLE / n * 100.0) ELSE '0.0' END) || ',deflate,true' AS line
       FROM (SELECT doc_id, octet_length(encode(text)) AS n, 20 + doc_id * 7919 % 5000 AS c FROM documents)""",
)
def report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV lines of made-up packed sizes, with ratios rounded by their exact binary value."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id", F.concat(F.lit("d"), F.col("doc_id")).alias("path"), F.octet_length(F.encode("text", "UTF-8")).cast("decimal(20,0)").alias("original_size"),
        (F.col("doc_id") * 7919 % 5000 + 20).alias("compressed_size"), F.lit("deflate").alias("plugin_name"), F.lit(True).alias("crc_valid"),
    )
    return reports.csv_lines(rows, "path", "doc_id").withColumnRenamed("value", "line")


@query(
    "report_json",
    """SELECT doc_id, '{"original_size":' || octet_length(encode(text)) || ',"plugin_name":"deflate","crc_valid":true,"metadata":{"mtime":null,"permissions":null}}' AS line FROM documents""",
)
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects with nulls kept; the packed size, which depends on the encoder, is taken out."""
    rows = inspect(documents(spark, sf_dir).select("doc_id", "frame"))
    return reports.json_objects(rows, "doc_id").select("doc_id", F.regexp_replace("value", '"compressed_size":[0-9]+,', "").alias("line"))


@query(
    "config_layering",
    """SELECT * FROM (VALUES ('compression.default_plugin', 'auto'), ('compression.level', 'best'), ('compression.timeout_seconds', '30'), ('output.progress_bars', 'false'),
       ('output.color', 'never'), ('output.quiet', 'true'), ('logging.format', 'json'), ('logging.level', 'trace'), ('logging.file', '')) t(key, value)""",
)
def config_layering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults, file, environment and command line, the last of which wins."""
    rows = [(k, config.show(v), "default") for k, v in config.DEFAULTS.items()]
    rows += [("compression.level", "fast", "file"), ("logging.level", "warn", "file"), ("output.color", "never", "file"), ("output.progress_bars", "false", "file")]
    rows += [("compression.level", "best", "env"), ("compression.timeout_seconds", "30", "env"), ("output.color", None, "env")]
    rows += [("logging.level", "trace", "cli"), ("logging.format", "json", "cli"), ("output.quiet", "true", "cli")]
    return config.layered(spark.createDataFrame(rows, "key string, value string, layer string"))


# --- files and streams -----------------------------------------------------------------------------------------------


def _shared(spark: SparkSession) -> str:
    """A new folder that driver and executors share, on a file system with plain paths; only a local session may do
    without naming one."""
    top = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or "").removeprefix("file:")
    top = "/" + top.lstrip("/") if top.startswith("//") else top
    if "://" in top:
        raise FrameError("InvalidInput", f"files need a shared folder with plain paths, not {top}")
    master = spark.sparkContext.master
    if not top and not (master == "local" or master.startswith("local[")):
        raise FrameError("InvalidInput", "set spark.checkpoint.dir to a folder that the driver and all executors share")
    if top:
        os.makedirs(top, exist_ok=True)
    return tempfile.mkdtemp(prefix="frames-", dir=top or None)


@query("files_roundtrip", "SELECT item_id, text AS restored, CAST(octet_length(encode(text)) AS BIGINT) AS length, item_id * 1000 AS mtime FROM benchmark")
def files_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item written to a file, read, framed into a file, read and restored to a file with its times."""
    from ..sources.files import read_folder, write_files

    top = _shared(spark)
    for name in ("in", "packed", "out"):
        os.makedirs(f"{top}/{name}")
    rows = payloads(spark, sf_dir, "benchmark", "text", "item_id")
    target = F.concat(F.lit(f"{top}/in/"), F.col("item_id"), F.lit(".txt"))
    write_files(rows.withColumn("target", target).withColumn("t", F.col("item_id") * 1000), "target", "data", "t")
    frames = compress(read_folder(spark, f"{top}/in").withColumn("path", F.regexp_replace("path", "^file:/*", "/")), options=Options(mtime="mtime"))
    write_files(frames.withColumn("target", report.frame_path(F.col("path"), F.lit(f"{top}/packed"))), "target", "frame")
    back = decompress(read_folder(spark, f"{top}/packed", "*.frame").select("path", F.col("data").alias("frame")))
    write_files(back.withColumn("target", F.concat(F.lit(f"{top}/out/"), F.regexp_extract("path", "([0-9]+)[.]frame$", 1))), "target", "data", "mtime")
    out = read_folder(spark, f"{top}/out")
    return out.select(F.regexp_extract("path", "([0-9]+)$", 1).cast("long").alias("item_id"), _text("data").alias("restored"), "length", "mtime")


@query("input_validation", "SELECT * FROM (VALUES ('empty', 'Input file is empty'), ('folder', 'Input path is not a file'), ('full', NULL), ('missing', 'Input file does not exist')) t(name, problem)")
def input_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with input paths."""
    from ..sources.files import read_files

    top = _shared(spark)
    os.makedirs(f"{top}/folder")
    for name, content in (("empty", b""), ("full", b"content")):
        with open(f"{top}/{name}", "wb") as f:
            f.write(content)
    rows = read_files(spark, [f"{top}/{n}" for n in ("empty", "folder", "full", "missing")])
    problem = F.when(F.col("error_message").isNotNull(), F.regexp_extract("error_message", "^([^:]*):", 1))
    return rows.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), problem.alias("problem"))


@query("stream_roundtrip", "SELECT item_id, text AS restored FROM benchmark")
def stream_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files streamed into frames, and the stored frames restored."""
    from ..sources.files import write_files
    from ..streaming.folders import frames, to_parquet, watch

    top = _shared(spark)
    os.makedirs(f"{top}/in")
    rows = payloads(spark, sf_dir, "benchmark", "text", "item_id")
    write_files(rows.withColumn("target", F.concat(F.lit(f"{top}/in/"), F.col("item_id"))), "target", "data")
    to_parquet(frames(watch(spark, f"{top}/in")), f"{top}/out", f"{top}/state").awaitTermination()
    stored = spark.read.parquet(f"{top}/out").drop("mtime")
    return decompress(stored).select(F.regexp_extract("path", "([0-9]+)$", 1).cast("long").alias("item_id"), _text("data").alias("restored"))


from . import surface as _surface  # noqa: E402, F401  registers the queries of the driver's side
