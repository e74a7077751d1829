"""Places of rows in groups of any size: no group is sorted, or held, in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors reach; unset, a temporary one in local mode alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: it names the folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/doculith-tables"


def placed(rows: DataFrame, group: str, *order: Column, name: str = "place") -> DataFrame:
    """`rows` with their place, 1, 2, ..., by `order` in each value of `group`; null is a group as well.

    The rows are sorted by ranges of (group, order), of which a group may fill many, and written once, so that a place
    never changes. A row's place is that in its range plus the counts of the group in the ranges before; of these
    counts there is at most one a range and group. Rows that are equal in `order` are placed as they come.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    folder = f"{shared_folder(spark)}/places-{uuid.uuid4().hex}"
    ranged.withColumns({"_piece": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).write.parquet(folder)
    kept = spark.read.parquet(folder)
    counts = kept.groupBy(group, "_piece").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select(F.col(group).alias("_g"), F.col("_piece").alias("_p"), (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    joined = kept.join(shifts, (F.col("_p") == F.col("_piece")) & F.col("_g").eqNullSafe(F.col(group)))
    return joined.withColumn(name, F.col("_at") + F.col("_shift")).drop("_piece", "_at", "_g", "_p", "_shift")
