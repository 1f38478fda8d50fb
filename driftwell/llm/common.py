"""Shared tables and running totals used by several operators."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftwell.session import scratch_folder

#: A word of a text, in the syntax of Java and Python alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _release(spark: SparkSession, path: str) -> None:
    """Removes ``path`` when the driver ends, and shuffle files of plans that are no longer held now."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    time.sleep(0.3)  # listeners still hold the plan that has just ended
    gc.collect()
    spark._jvm.System.gc()


def shared_table(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, so that lost executors cost a reread and not a recompute.

    Shuffle files of finished steps go as soon as their plans are collected; the table goes when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    _release(spark, path)
    read = spark.read.schema(df.schema).parquet(path)
    read.shared_path = path
    return read


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``shared_table`` and ``bucketed_table`` that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        if hasattr(df, "table_name"):
            spark.sql(f"DROP TABLE IF EXISTS {df.table_name}")
        place = spark._jvm.org.apache.hadoop.fs.Path(df.shared_path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def bucketed_table(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like ``shared_table``, but bucketed by ``key``: a join on the key then shuffles the other side only."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    table_name = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table_name)
    _release(spark, path)
    read = spark.table(table_name)
    read.shared_path, read.table_name = path, table_name
    return read


def running_total(df: DataFrame, groups: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Adds ``before`` (sum of ``value`` over earlier rows of the group) and ``position`` (number of earlier rows).

    Rows are range-partitioned by (groups, order), so a group of any size is spread over tasks; only one total per
    group and partition is scanned in order.  ``order`` must tell rows apart, or tied rows must be interchangeable.
    Groups must not be null.
    """
    ranged = df.repartitionByRange(*groups, *order).withColumn("__part", F.spark_partition_id())
    ranged = shared_table(ranged, "ranged")
    totals = ranged.groupBy(*groups, "__part").agg(F.sum(value).alias("__sum"), F.count(F.lit(1)).alias("__rows"))
    earlier = W.partitionBy(*groups, *([] if groups else [F.lit(0)])).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *groups,
        "__part",
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__sum_before"),
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__rows_before"),
    )
    local = W.partitionBy(*groups, "__part").orderBy(*order)
    mine = ranged.withColumns(
        {
            "__sum_here": F.coalesce(F.sum(value).over(local.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "__rows_here": F.row_number().over(local) - 1,
        }
    )
    return (
        mine.join(offsets, [*groups, "__part"])
        .withColumn("before", F.col("__sum_before") + F.col("__sum_here"))
        .withColumn("position", F.col("__rows_before") + F.col("__rows_here"))
        .drop("__part", "__sum_before", "__rows_before", "__sum_here", "__rows_here")
    )
