"""Document files as a batch or a stream, and parquet snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Schema of the binary file source, needed up front by a stream.
BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def scan_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """All files below ``path`` that match: path, modificationTime, length, content."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )


def stream_files(spark: SparkSession, path: str, glob: str = "*.pdf", per_batch: int = 500) -> DataFrame:
    """The same files as a stream; a checkpointed run sees only files it has not seen."""
    return (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", per_batch)
        .load(path)
    )


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    """A table folder whose files may have different columns."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def overwrite(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a table folder, or with ``partition_by`` only the partitions that occur."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)
