"""Reading the given tables and keeping intermediate ones in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from haulmark.sources.sizing import materialize

BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and go on from the files; a lost executor costs nothing."""
    return materialize(df, name)


def in_batches(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_BYTES``.

    A batch lies in the JVM and in the Python worker at once, so its size, not the number of its
    rows, has to be bounded where texts differ in length by orders of magnitude.  The limit is a
    setting of the session; it is only ever lowered.
    """
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH, "64m").rstrip("bB").replace("m", "0" * 6)) not in range(1, BATCH_BYTES + 1):
        conf.set(_BATCH, f"{BATCH_BYTES}b")
    return df.mapInArrow(function, schema)


def text_key(column: str = "text") -> Column:
    """128-bit key of a text as a string of 32 hex digits; null for a null text."""
    return F.md5(F.col(column))


def bounded_sample(df: DataFrame, by: Sequence[str], rows: int) -> DataFrame:
    """About ``rows`` rows chosen by a hash of ``by``, the same ones on every run.

    The share is set from the row count, so the sample lies evenly over the whole table; all
    rows where the table is no larger.  Never more than ``rows`` rows are returned.
    """
    total = df.count()
    if total <= rows:
        return df
    cut = int(1.1 * rows / total * (1 << 30)) + 1
    place = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in by]), F.lit(1 << 30))
    return df.where(place < cut).orderBy(place, *[F.col(f"`{c}`") for c in by]).limit(rows)


def held_out(column: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))
