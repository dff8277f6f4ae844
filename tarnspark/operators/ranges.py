"""Work through a table in ranges of its key that are dealt out once, and can be stopped and taken up again.

``deal`` sorts the table into ranges by one exchange and writes each to a folder of its own, with the ranges' bounds beside. A range that
has been worked on gets a marker, so a restart lists the markers and reads only the folders that have none: over all runs each row
is read once, but for those of a range whose work broke off.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import PROGRESS, clear_progress, load_progress, save_progress

_RANGE = "_range"


def _there(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def deal(rows: DataFrame, key: str, path: str, n: int) -> DataFrame:
    """The bounds (range, first, last, rows) of at most n ranges of ``key``, whose rows are now at ``path``; dealt out once, read on later calls.

    Rows of equal keys are in one range; null keys come first. What a killed call has left is written anew.
    """
    spark = rows.sparkSession
    if not _there(spark, f"{path}/bounds/_SUCCESS"):
        dealt = rows.repartitionByRange(n, key).withColumn(_RANGE, F.spark_partition_id())
        dealt.write.mode("overwrite").partitionBy(_RANGE).parquet(f"{path}/data")
        stored = spark.read.schema(dealt.schema).parquet(f"{path}/data")
        bounds = stored.groupBy(F.col(_RANGE).alias("range")).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("rows"))
        bounds.coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")
    return spark.read.parquet(f"{path}/bounds")


def of_range(spark: SparkSession, path: str, number: int) -> DataFrame:
    """One range's rows; no other file is opened."""
    return spark.read.parquet(f"{path}/data/{_RANGE}={number}")


def not_done(spark: SparkSession, path: str) -> DataFrame:
    """The bounds of the ranges without a marker, in order."""
    done = load_progress(spark, f"{path}/done").select(F.col("batch").cast("int").alias("range"))
    return spark.read.parquet(f"{path}/bounds").join(done, "range", "left_anti").orderBy("range")


def run(rows: DataFrame, key: str, path: str, n: int, work: Callable[[DataFrame], tuple[int, int]], keep: bool = False) -> int:
    """Do ``work`` (returns what it found, and its errors) on each range that isn't done; the number of ranges done by this call.

    The driver sees the bounds of the ranges that are left. When all is done everything at ``path`` goes, unless it is to be kept;
    ``batches.totals`` sums up the markers at ``path``/done.
    """
    spark, made = rows.sparkSession, 0
    deal(rows, key, path, n)
    clock = lambda: spark.sql("SELECT current_timestamp()::timestamp_ntz").first()[0]
    for left in not_done(spark, path).collect():
        began = clock()
        found, errors = work(of_range(spark, path, left["range"]))
        text = lambda v: None if v is None else str(v)
        note = (left["range"], text(left["first"]), text(left["last"]), left["rows"], found, errors, began, clock())
        save_progress(spark.createDataFrame([note], PROGRESS).coalesce(1), f"{path}/done")
        made += 1
    if not keep:
        clear_progress(spark, path)
    return made
