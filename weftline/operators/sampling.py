"""Deterministic sampling and quotas: every draw depends on a seed and the keys of a row alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalars import key_uniform


def top_and_explore(df: DataFrame, group: list[str], weight: str, key: str, limit: int, top_share: float = 0.7, seed: int = 42) -> DataFrame:
    """Of each group the heaviest rows up to ``top_share`` of ``limit``, and others drawn up to ``limit``."""
    top = int(limit * top_share)
    heavy = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(weight), key))
    ranked = df.withColumn("_h", heavy)
    drawn = F.row_number().over(Window.partitionBy(*group).orderBy((F.col("_h") <= top).desc(), key_uniform(seed, F.col(key)), key))
    return ranked.withColumn("_d", drawn).filter(F.col("_d") <= limit).withColumn("chosen_by", F.when(F.col("_h") <= top, "weight").otherwise("draw")).drop("_h", "_d")


def weighted_draw(df: DataFrame, group: list[str], weight: str, key: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows of each group without replacement, the chance following the weight."""
    u = F.greatest(key_uniform(seed, F.col(key)), F.lit(1e-12))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(-F.log(u) / F.col(weight), key))
    return df.filter(F.col(weight) > 0).withColumn("_r", rank).filter(F.col("_r") <= size).drop("_r")


def quota_sample(df: DataFrame, family: str, key: str, total: int, seed: int = 42) -> DataFrame:
    """``total`` rows split over the families by size, largest remainders first."""
    sizes = df.groupBy(family).agg(F.count(F.lit(1)).alias("n"))
    exact = F.col("n") * F.lit(total) / F.sum("n").over(Window.partitionBy())
    shares = sizes.withColumn("_e", exact).withColumn("_q", F.floor("_e"))
    by_rest = Window.orderBy((F.col("_e") - F.col("_q")).desc(), family)  # one row for each family
    left = F.lit(total) - F.sum("_q").over(Window.partitionBy())
    quota = shares.select(family, F.least(F.col("n"), F.col("_q") + (F.row_number().over(by_rest) <= left).cast("bigint")).alias("_quota"))
    rank = F.row_number().over(Window.partitionBy(family).orderBy(key_uniform(seed, F.col(key)), key))
    return df.join(quota, family).withColumn("_r", rank).filter(F.col("_r") <= F.col("_quota")).drop("_r", "_quota")


def capped(df: DataFrame, group: list[str], order: list, cap: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_r", rank).filter(F.col("_r") <= cap).drop("_r")


def share_band(df: DataFrame, flag: Column, order: list, low: float, high: float) -> DataFrame:
    """Rows with the flagged ones held within a band of the result.

    Too many flagged rows lose the last ones in order, too few lose unflagged ones.
    """
    marked = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    counted = marked.agg(F.count_if(F.col("_f")).alias("nf"), F.count_if(~F.col("_f")).alias("nu"))
    most = F.floor(F.col("nu") * high / (1 - high))
    others = F.when(F.lit(low) > 0, F.floor(F.col("nf") * (1 - low) / low)).otherwise(F.col("nu"))
    most_flagged, most_others = counted.select(F.least("nf", most)).scalar(), counted.select(F.least("nu", others)).scalar()
    rank = F.row_number().over(Window.partitionBy("_f").orderBy(*order))
    return marked.withColumn("_r", rank).filter(F.col("_r") <= F.when(F.col("_f"), most_flagged).otherwise(most_others)).drop("_f", "_r")


def first_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in order, unlike dropDuplicates always the same."""
    return capped(df, keys, order, 1)
