"""Streaming intake: new rows only, each batch safe to repeat, chunks on arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.operators.chunking import chunk_documents
from haulmark.sources.sizing import fresh_path

PREFIXES = 64
MAX_FILE_BYTES = 250 * 1000 * 1000


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet files of one table as a stream; the table is one file or a folder of files."""
    # A stream takes a single file only by a pattern; braces around the name match just the name.
    path = f"{folder.rstrip('/')}/{{{name}}}"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that has arrived, then stop."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def chunk_stream(docs: DataFrame, path: str, checkpoint: str) -> None:
    """Chunk documents as they arrive; chunking keeps no state."""
    run_available(chunk_documents(docs), path, checkpoint)


def key_store(path: str) -> str:
    """Folder of the keys that the table at ``path`` holds."""
    return f"{path.rstrip('/')}-keys"


def known_keys(batch: DataFrame, store: str, key: str, batch_id: int, prefixes: int = PREFIXES) -> DataFrame:
    """Stored keys that rows of ``batch`` could repeat: only the prefixes that occur in it are read.

    Keys of the batch itself, stored by an attempt that failed, are not counted as known.
    """
    spark = batch.sparkSession
    # At most ``prefixes`` numbers.
    held = [r[0] for r in batch.select(_prefix(key, prefixes)).distinct().collect()]
    keys = spark.read.schema(f"`{key}` {dict(batch.dtypes)[key]}, prefix int, batch_id bigint").parquet(store)
    return keys.where(F.col("prefix").isin(held) & (F.col("batch_id") != batch_id)).select(key)


def _prefix(key: str, prefixes: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(prefixes)).cast("int").alias("prefix")


def insert_batch(batch: DataFrame, batch_id: int, path: str, key: str, prefixes: int = PREFIXES) -> None:
    """Add the rows of a micro-batch whose key the table lacks, one row per key (null is a key).

    Rows go to the partition ``batch_id`` of the table, their keys to the key store, which is
    partitioned by a hash prefix of the key.  Both are replaced when the batch is repeated after a
    failure, so a repeated batch adds nothing.
    """
    known = known_keys(batch, key_store(path), key, batch_id, prefixes).withColumnRenamed(key, "_known")
    one = batch.dropDuplicates([key])
    fresh = one.join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti").withColumn("batch_id", F.lit(batch_id).cast("bigint"))

    def replace(rows: DataFrame, folder: str, *by: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(folder)

    replace(fresh, path, "batch_id")
    stored = batch.sparkSession.read.schema(fresh.schema).parquet(path).where(F.col("batch_id") == batch_id)
    replace(stored.select(key, _prefix(key, prefixes), "batch_id").repartition("prefix"), key_store(path), "prefix", "batch_id")


def intake_new(stream: DataFrame, path: str, checkpoint: str, key: str, prefixes: int = PREFIXES) -> None:
    """Insert everything that has arrived and whose key the table lacks, then stop."""
    # The folders exist from the start, so the first batch can read them.
    empty = stream.sparkSession.createDataFrame([], stream.schema)
    empty.write.mode("append").parquet(f"{path}/batch_id=-1")
    empty.select(key).write.mode("append").parquet(f"{key_store(path)}/prefix=0/batch_id=-1")
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: insert_batch(batch, number, path, key, prefixes))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def intake_files(stream: DataFrame, path: str, checkpoint: str, delivery: str, max_bytes: int = MAX_FILE_BYTES) -> None:
    """Take in the files that have arrived, then stop: path, length, content, too_large, delivery.

    Files beyond ``max_bytes`` are listed without their content, which is not read.  A checkpointed
    run sees only files that no earlier run has seen; each micro-batch replaces its own partition.
    """

    def store(batch: DataFrame, number: int) -> None:
        fits = batch.where(F.col("length") <= max_bytes).select("path", "length", "content", F.lit(False).alias("too_large"))
        large = batch.where(F.col("length") > max_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit(True).alias("too_large"))
        rows = fits.unionByName(large).withColumns({"delivery": F.lit(delivery), "batch_id": F.lit(number).cast("bigint")})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def scratch(spark: SparkSession, name: str) -> tuple[str, str]:
    """A new output folder and its checkpoint folder in the shared folder."""
    base = fresh_path(spark, name)
    return f"{base}/data", f"{base}/checkpoint"
