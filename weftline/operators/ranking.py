"""Global order without one task: row numbers and running sums over range partitions.

Rows are sorted by range over all tasks and written once; what each range holds is
summed, and a range adds the sums of those before it to its own running values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import checkpoint, parallelism


def _ranged(df: DataFrame, order: list[str], weight: Column) -> tuple[DataFrame, DataFrame]:
    ranged = df.repartitionByRange(parallelism(df.sparkSession), *order).withColumn("_part", F.spark_partition_id())
    ranged = checkpoint(ranged)
    sums = ranged.groupBy("_part").agg(F.sum(weight).alias("_w"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition, whatever the data
    return ranged, sums.select("_part", F.coalesce(F.sum("_w").over(ahead), F.lit(0)).alias("_before"))


def dense_ids(df: DataFrame, order: list[str], name: str = "id", first: int = 1) -> DataFrame:
    """Numbers the rows first, first + 1, ... in the order of some columns that tell all rows apart."""
    ranged, before = _ranged(df, order, F.lit(1))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(before), "_part").select(*df.columns, (inside + F.col("_before") + (first - 1)).cast("bigint").alias(name))


def running_total(df: DataFrame, order: list[str], weight: str, name: str = "upto") -> DataFrame:
    """Sum of ``weight`` of all rows up to each, over the whole table."""
    ranged, before = _ranged(df, order, F.col(weight))
    inside = F.sum(weight).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(F.broadcast(before), "_part").select(*df.columns, (inside + F.col("_before")).alias(name))
