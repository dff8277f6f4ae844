"""Work through a table in batches that can be stopped and taken up again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import duration

PROGRESS = "batch long, first_id string, last_id string, processed long, found long, errors long, started_at timestamp_ntz, ended_at timestamp_ntz"


def load_progress(spark: SparkSession, path: str) -> DataFrame:
    """The batches that have been done; none if nothing was saved yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], PROGRESS)
    return spark.read.schema(PROGRESS).parquet(path)


def save_progress(done: DataFrame, path: str) -> None:
    done.write.mode("append").parquet(path)


def clear_progress(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def not_done(rows: DataFrame, key: str, progress: DataFrame) -> DataFrame:
    """Rows behind the last batch, by the key as text."""
    last = progress.agg(F.max("last_id").alias("_last"))
    return rows.crossJoin(F.broadcast(last)).where(F.col("_last").isNull() | (F.col(key).cast("string") > F.col("_last"))).drop("_last")


def next_batch(rows: DataFrame, key: str, progress: DataFrame, size: int) -> DataFrame:
    return not_done(rows, key, progress).orderBy(F.col(key).cast("string")).limit(size)


def totals(progress: DataFrame, total: Column | int) -> DataFrame:
    """processed, found, errors, percent, rate (rows a second), eta_seconds and elapsed of all batches."""
    out = progress.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("processed", "found", "errors")], F.coalesce((F.unix_micros(F.max("ended_at").cast("timestamp")) - F.unix_micros(F.min("started_at").cast("timestamp"))) / 1e6, F.lit(0.0)).alias("elapsed_seconds"))
    all_ = F.lit(total) if isinstance(total, int) else total
    rate = F.when(F.col("elapsed_seconds") > 0, F.col("processed") / F.col("elapsed_seconds")).otherwise(0.0)
    out = out.withColumn("percent", F.when(all_ > 0, F.col("processed") / all_ * 100).otherwise(0.0)).withColumn("rate", rate)
    return out.withColumn("eta_seconds", F.when(F.col("rate") > 0, (all_ - F.col("processed")) / F.col("rate")).otherwise(0.0)).withColumn("elapsed", duration("elapsed_seconds"))


def run(rows: DataFrame, key: str, path: str, size: int, work: Callable[[DataFrame], tuple[int, int]], keep: bool = False) -> int:
    """Do ``work`` (returns what it found, and its errors) on batch after batch; the number of batches done by this call.

    Each batch is noted at ``path`` when it is done, so a run that was stopped goes on behind it. When all is done the notes
    go, unless they are to be kept. Batches are large; within one Spark deals the rows to all executors.
    """
    spark, n = rows.sparkSession, 0
    while True:
        progress = load_progress(spark, path)
        batch = next_batch(rows, key, progress, size).persist()
        span = batch.agg(F.count("*").alias("n"), F.min(F.col(key).cast("string")).alias("a"), F.max(F.col(key).cast("string")).alias("b")).first()
        if not span["n"]:
            batch.unpersist()
            break
        began = spark.sql("SELECT current_timestamp()::timestamp_ntz").first()[0]
        found, errors = work(batch)
        ended = spark.sql("SELECT current_timestamp()::timestamp_ntz").first()[0]
        number = progress.count() + 1
        save_progress(spark.createDataFrame([(number, span["a"], span["b"], span["n"], found, errors, began, ended)], PROGRESS).coalesce(1), path)
        batch.unpersist()
        n += 1
    if not keep:
        clear_progress(spark, path)
    return n
