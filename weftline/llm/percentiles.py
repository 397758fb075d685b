"""Percentiles of very large numeric columns by cumulative frequencies in SQL.

A column is reduced to counts per group and value. These tables are exact, merge
by adding counts, and are all that has to be kept of a file or a day. Ranks are
found by sorting the counts by range over all tasks, running sums within each
range, and the sum of the ranges before it, so no group is gathered in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import checkpoint, parallelism


def frequency_table(df: DataFrame, group: Column, value: Column, relative_error: float = 0.0, above_zero: bool = True) -> DataFrame:
    """``grp, val, n``: how often each finite value, or each above 0, occurs in each group.

    With ``relative_error`` 0 the table is exact. Otherwise sizes are rounded to
    powers of ``(1 + e) / (1 - e)`` under their sign, and 0 stays, so a percentile
    differs from the exact one by at most that share of it, and the table has at most
    some thousand rows a group however many values there are. Null groups and null,
    NaN and infinite values are left out; with ``above_zero`` zero and negative ones too.
    """
    value = value.cast("double")
    kept = df.select(group.alias("grp"), value.alias("val")).filter(
        F.col("grp").isNotNull() & F.col("val").isNotNull() & ~F.isnan("val") & (F.abs("val") != float("inf"))
    )
    if above_zero:
        kept = kept.filter(F.col("val") > 0)
    if relative_error:
        step = math.log((1 + relative_error) / (1 - relative_error))
        power = F.ceil(F.log(F.abs("val")) / step - F.lit(1e-12))
        kept = kept.withColumn("val", F.when(F.col("val") == 0, 0.0).otherwise(F.signum("val") * F.exp(power * step) * F.lit(1 - relative_error)))
    return kept.groupBy("grp", "val").agg(F.count(F.lit(1)).alias("n"))


def merge_frequencies(*tables: DataFrame) -> DataFrame:
    """One table from those of several files or days."""
    union = tables[0].select("grp", "val", "n")
    for other in tables[1:]:
        union = union.unionByName(other.select("grp", "val", "n"))
    return union.groupBy("grp", "val").agg(F.sum("n").alias("n"))


def percentiles(freq: DataFrame, probs: Sequence[str] = ("0.5", "0.95")) -> DataFrame:
    """Nearest-rank percentiles per group, ``grp, n_values`` and ``p50`` for "0.5".

    The value of a share is the smallest with at least that share of the values not
    above it; shares are exact decimals. ``freq`` is a table of counts with each group
    and value once. An empty table gives no rows.
    """
    spark = freq.sparkSession
    ranged = freq.select("grp", "val", "n").repartitionByRange(parallelism(spark), "grp", "val")
    # written once, as a range computed again could be cut elsewhere
    ranged = checkpoint(ranged.withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("grp", "part").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "grp", "part",
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("grp")).alias("n_values"),
    )
    inside = Window.partitionBy("grp", "part").orderBy("val").rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.withColumn("upto", F.sum("n").over(inside)).join(offsets, ["grp", "part"])
    running = running.withColumn("upto", F.col("upto") + F.col("before"))
    picks = []
    for p in probs:
        share = Decimal(str(p))
        top = 10 ** max(0, -share.as_tuple().exponent)
        reached = F.col("upto").cast("decimal(28,0)") * top >= F.col("n_values").cast("decimal(28,0)") * int(share * top)
        picks.append(F.min(F.when(reached, F.col("val"))).alias(percent_name(p)))
    return running.groupBy("grp").agg(F.first("n_values").alias("n_values"), *picks)


def percent_name(prob: str) -> str:
    """Column name of a share: "0.5" is p50, "0.995" is p99_5."""
    return "p" + format((Decimal(str(prob)) * 100).normalize(), "f").replace(".", "_")


def wide_groups(df: DataFrame, times: int = 40) -> DataFrame:
    """Groups of :func:`percentiles` whose 95th percentile is at least ``times`` their median."""
    return df.filter(F.col("p95") >= F.col("p50") * times)
