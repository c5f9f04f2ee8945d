"""A folder watched for new files, whose content is framed, inspected or restored as it arrives.

The operators are stateless projections, so any of them runs unchanged on a stream; the checkpoint location gives
exactly-once files in the Parquet sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.frames import Options, compress, decompress, inspect
from ..operators.codecs import Registry

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """path, data and mtime of every file that appears in a folder."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return files.select("path", F.col("content").alias("data"), F.unix_seconds("modificationTime").alias("mtime"))


def frames(stream: DataFrame, options: Options | None = None, registry: Registry | None = None) -> DataFrame:
    return compress(stream, options=options or Options(mtime="mtime"), registry=registry).drop("data")


def restored(stream: DataFrame, registry: Registry | None = None) -> DataFrame:
    return decompress(stream.drop("mtime"), registry=registry).drop("frame")


def inspected(stream: DataFrame, registry: Registry | None = None) -> DataFrame:
    return inspect(stream.drop("mtime"), registry=registry).drop("frame")


def to_parquet(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start writing a stream; by default what is there now, and then stop."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
