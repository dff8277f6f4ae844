"""Sinks: files by outcome, CSV, JSON lines, messages in batches, bucketed tables. Appends and new versions are in commits.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def by_outcome(df: DataFrame, path: str, column: str = "outcome") -> None:
    df.write.mode("overwrite").partitionBy(column).json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def with_errors(df: DataFrame, result: str, reason: str) -> DataFrame:
    """JSON lines in which a row has its result or the error that kept it from one."""
    return df.select(F.to_json(F.struct(*[c for c in df.columns if c not in (result, reason)], F.when(F.col(reason).isNull(), F.col(result)).alias(result), F.col(reason).alias("error"))).alias("value"))


def outbox(df: DataFrame, key: str, parts: int = 16, size: int = 10) -> DataFrame:
    """Messages to publish with their ``batch``: ``size`` of them at most, numbered within one of ``parts`` hash parts of the key."""
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    number = F.floor((F.row_number().over(Window.partitionBy(part).orderBy(key)) - 1) / size)
    return df.withColumn("batch", F.concat_ws("-", part, number))


def reload(df: DataFrame, name: str, keys: list[str] | None = None, buckets: int = 0) -> None:
    """Drop, create and fill a table, bucketed by the keys it is joined on, and gather its statistics."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer = df.write.format("parquet")
    (writer.bucketBy(buckets, *keys).sortBy(*keys) if keys and buckets else writer).saveAsTable(name)
    statistics(spark, name)


def add_columns(spark: SparkSession, name: str, columns: dict[str, str]) -> list[str]:
    """Add the columns that a table lacks; a second run adds none. Returns those added."""
    have = {c.lower() for c in spark.table(name).columns}
    new = {c: t for c, t in columns.items() if c.lower() not in have}
    if new:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'{c} {t}' for c, t in new.items())})")
    return list(new)


def statistics(spark: SparkSession, table: str) -> None:
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
