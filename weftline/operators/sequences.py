"""Operators on ordered rows of a group: ranks, predecessors, running and decayed values, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalars import jaccard


def numbered(df: DataFrame, group: list[str], order: list, name: str = "nth", first: int = 0) -> DataFrame:
    """Position of each row in its group, from ``first``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) + (first - 1))


def predecessor(df: DataFrame, group: list[str], order: list, value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lag(value).over(Window.partitionBy(*group).orderBy(*order)))


def set_drift(df: DataFrame, group: str, order: str, members: str) -> DataFrame:
    """``group, order, score``: Jaccard of each set with the one before it in its group.

    An empty set gives no row but is the one before the next.
    """
    before = F.lag(members).over(Window.partitionBy(group).orderBy(order))
    pairs = df.select(group, order, members, before.alias("_before")).filter(F.col("_before").isNotNull() & (F.size(members) > 0))
    return pairs.select(group, order, jaccard(F.col("_before"), F.col(members)).alias("score"))


def calibrated_rank(df: DataFrame, group: list[str], order: list, low: float, high: float, name: str) -> DataFrame:
    """Places evenly between ``low`` and ``high`` by rank; a single row gets the middle."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    spread = F.lit(low) + rank / F.greatest(n - 1, F.lit(1)) * (high - low)
    return df.withColumn(name, F.when(n == 1, F.lit((low + high) / 2)).otherwise(spread))


def top_rows(df: DataFrame, group: list[str], order: list, keep: int, name: str = "rank") -> DataFrame:
    """First ``keep`` rows of each group; Spark drops the others before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(name, rank).filter(F.col(name) <= keep)


def running_sum(df: DataFrame, group: list[str], order: list, value: str, name: str) -> DataFrame:
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(value).over(upto))


def weekly(df: DataFrame, group: str, day: str, date: str, values: list[str]) -> DataFrame:
    """Sums of days in weeks counted from day 1, with the date of the first day of each."""
    week = (F.floor((F.col(day) - 1) / 7) + 1).cast("int")
    return df.groupBy(group, week.alias("week_no")).agg(F.min_by(date, day).alias("week_start"), *[F.sum(v).alias(v) for v in values])


def renormalized_share(df: DataFrame, group: list[str], order: list, value: str, keep: int, name: str = "share") -> DataFrame:
    """Percent of each of the first ``keep`` rows of a group among these."""
    kept = top_rows(df, group, order, keep, "_r").drop("_r")
    total = F.sum(value).over(Window.partitionBy(*group))
    return kept.withColumn(name, F.when(total != 0, F.col(value) * 100.0 / total).otherwise(0.0))


def decayed_load(df: DataFrame, group: list[str], at: str, decay: float, horizon: int, last: int = 48) -> DataFrame:
    """Per row the sum of ``decay ** age`` over the ``last`` rows of its group up to it, none older than ``horizon``.

    Rows at the same place are taken in any order; each counts the ones before it.
    """
    recent = Window.partitionBy(*group).orderBy(at).rowsBetween(-(last - 1), Window.currentRow)
    ages = F.transform(F.collect_list(at).over(recent), lambda x: F.col(at) - x)
    fresh = F.filter(ages, lambda a: a <= horizon)
    return df.withColumn("load", F.aggregate(fresh, F.lit(0.0), lambda s, a: s + F.pow(F.lit(decay), a)))


def decayed_mean(df: DataFrame, group: list[str], at: list, value: str, decay: float, last: int, low: float, high: float) -> DataFrame:
    """Mean of the ``last`` values up to each row, the newest weighing most, clipped to a range."""
    recent = Window.partitionBy(*group).orderBy(*at).rowsBetween(-(last - 1), Window.currentRow)
    values = F.reverse(F.collect_list(value).over(recent))
    weighed = F.transform(values, lambda x, i: F.struct((x * F.pow(F.lit(decay), i)).alias("v"), F.pow(F.lit(decay), i).alias("w")))
    total = lambda field: F.aggregate(weighed, F.lit(0.0), lambda s, x: s + x[field])
    mean = F.try_divide(total("v"), total("w"))
    return df.withColumn("momentum", F.greatest(F.lit(low), F.least(F.lit(high), mean)))


def smoothed(df: DataFrame, group: str, order: str, signal: str, keep: float, start: float = 0.0) -> DataFrame:
    """State after each row of ``state = keep * state + signal``, in the order of a group.

    Null signals count 0. A group's rows meet in one array; groups are short series
    such as years. Returns ``group, order, state``.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(signal).cast("double"), F.lit(0.0)).alias("s"))))
    step = lambda acc, x: F.struct((acc["state"] * keep + x["s"]).alias("state"), F.concat(acc["out"], F.array(F.struct(x["o"].alias("o"), (acc["state"] * keep + x["s"]).alias("v")))).alias("out"))
    kind = df.schema[order].dataType.simpleString()
    empty = F.struct(F.lit(start).cast("double").alias("state"), F.array().cast(f"array<struct<o:{kind},v:double>>").alias("out"))
    folded = df.groupBy(group).agg(rows.alias("r")).select(group, F.aggregate("r", empty, step)["out"].alias("out"))
    return folded.select(group, F.explode("out").alias("x")).select(group, F.col("x.o").alias(order), F.col("x.v").alias("state"))


def spaced_years(df: DataFrame, group: str, order: str, year: str, gap: int) -> DataFrame:
    """``group, order, year, spaced``: each year at least ``gap`` after the spaced year before it.

    The n-th spaced year is ``n * gap`` more than the most any year up to it exceeds its own ``n * gap``.
    """
    inside = Window.partitionBy(group).orderBy(order, year)
    moved = F.row_number().over(inside) * gap
    df = df.select(group, order, F.col(year).cast("int").alias(year), moved.alias("_m"))
    most = F.max(F.col(year) - F.col("_m")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return df.select(group, order, year, (most + F.col("_m")).alias("spaced"))


def strongest_with_validity(df: DataFrame, keys: list[str], seq: str, weight: str, low: str, high: str) -> DataFrame:
    """One row per key: what a pass in the order of ``seq`` would keep.

    A heavier duplicate replaces the kept row with its own interval; one of equal or
    less weight cuts the kept interval down to what both share. So the first of the
    heaviest stays, cut by all that follow it. Null ends are open, and a null weight is
    less than any other.
    """
    of_key = Window.partitionBy(*keys)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(float("-inf")))
    marked = df.select(*keys, F.col(seq).alias("_q"), w.alias("_w"), F.col(low).cast("int").alias(low), F.col(high).cast("int").alias(high))
    marked = marked.withColumn("_most", F.max("_w").over(of_key))
    marked = marked.withColumn("_first", F.min(F.when(F.col("_w") == F.col("_most"), F.col("_q"))).over(of_key))
    kept = marked.filter(F.col("_q") >= F.col("_first")).groupBy(*keys)
    most = F.max("_most")
    return kept.agg(F.when(most > float("-inf"), most).alias(weight), F.max(low).alias(low), F.min(high).alias(high))
