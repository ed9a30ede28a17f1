"""Registered queries: a Spark builder and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Builder
    sql: str | None


REGISTRY: dict[str, Query] = {}


def portable(df: DataFrame) -> DataFrame:
    """Plain column types: bigint, double, string, boolean and date."""

    def plain(field: T.StructField):
        column = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            return column.cast("bigint").alias(field.name)
        if isinstance(kind, (T.DecimalType, T.FloatType)):
            return column.cast("double").alias(field.name)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            return F.array_join(column, "|").alias(field.name)
        return column

    return df.select(*[plain(f) for f in df.schema.fields])


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under ``name``; ``sql`` is its check."""

    def add(build: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(lambda spark, sf_dir: portable(build(spark, sf_dir)), sql)
        return build

    return add
