"""Statistics over groups and whole columns, by mergeable counts wherever rows would be ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ranking import dense_ids, running_total


def value_shares(df: DataFrame, *keys: str) -> DataFrame:
    """``n`` and ``share`` of each value, nulls as a value of their own."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*keys, "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def max_share(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean over the groups of the share of their most frequent value, ``mean_max_share``."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(group).agg((F.max("n") / F.sum("n")).alias("s"))
    return top.agg(F.avg("s").alias("mean_max_share"))


def cramers_v(df: DataFrame, left: str, right: str) -> DataFrame:
    """Association of two categories, ``cramers_v``, from counts in long form; rows with a null are left out.

    0 where one side has a single value.
    """
    cells = df.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(left, right).agg(F.count(F.lit(1)).alias("o"))
    rows, cols = cells.groupBy(left).agg(F.sum("o").alias("r")), cells.groupBy(right).agg(F.sum("o").alias("c"))
    joined = cells.join(rows, left).join(cols, right)
    total = joined.agg(
        F.sum(F.col("o").cast("double") * F.col("o") / (F.col("r").cast("double") * F.col("c"))).alias("q"),
        F.sum("o").alias("n"), F.countDistinct(left).alias("k1"), F.countDistinct(right).alias("k2"),
    )
    least = F.greatest(F.lit(1), F.least(F.col("k1"), F.col("k2")) - 1)
    return total.select(F.sqrt(F.greatest(F.lit(0.0), F.col("q") - 1) / least).alias("cramers_v"))


def gini(df: DataFrame, value: str) -> DataFrame:
    """Inequality of a column of numbers, ``gini``; 0 for a total of 0, null for no rows.

    The sorted rows are replaced by counts per value, so equal values take no room.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_total(counts, ["x"], "n")
    # the ranks of n equal values that end at upto sum to n * (2 * upto - n + 1) / 2
    rank_sum = F.col("n") * (2 * F.col("upto") - F.col("n") + 1) / 2.0
    s = ranked.agg(F.sum(rank_sum * F.col("x")).alias("ix"), F.sum(F.col("x") * F.col("n")).alias("sx"), F.sum("n").alias("n"))
    n, sx = F.col("n"), F.col("sx")
    return s.select(F.when(sx == 0, 0.0).otherwise((2 * F.col("ix") - (n + 1) * sx) / (n * sx)).alias("gini"))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """``value`` and the average rank of its equals over the table."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_total(counts, [value], "n")
    return ranked.select(value, (F.col("upto") - (F.col("n") - 1) / 2.0).alias(name))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation, ``spearman``, with average ranks of ties; rows with a null are left out."""
    kept = df.select(x, y).dropna()
    ranked = kept.join(average_ranks(kept, x, "_rx"), x).join(average_ranks(kept, y, "_ry"), y)
    return ranked.agg(F.corr("_rx", "_ry").alias("spearman"))


def zipf_fit(df: DataFrame, key: str) -> DataFrame:
    """Slope and fit of log frequency over log rank, ``slope, r2``."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("f"))
    each = dense_ids(counts.withColumn("down", -F.col("f")), ["down", key], "rank")
    lx, ly = F.log(F.col("rank").cast("double")), F.log(F.col("f").cast("double"))
    return each.agg(F.regr_slope(ly, lx).alias("slope"), F.regr_r2(ly, lx).alias("r2"))


def top_share(df: DataFrame, value: str, percent: int = 1) -> DataFrame:
    """Share of the total that the greatest ``percent`` of rows hold, at least one row, ``top_share``."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("n")).withColumn("down", -F.col("x"))
    ranked = running_total(counts, ["down"], "n")
    total = counts.agg(F.sum("n")).scalar()
    wanted = F.greatest(F.lit(1), F.floor(total * percent / 100))
    taken = F.greatest(F.lit(0), F.least(F.col("n"), wanted - (F.col("upto") - F.col("n"))))
    return ranked.select("x", "n", taken.alias("_t")).agg((F.sum(F.col("_t") * F.col("x")) / F.sum(F.col("n") * F.col("x"))).alias("top_share"))


def deviation_from_target(df: DataFrame, key: str, targets: dict[str, float]) -> DataFrame:
    """Mean absolute difference of the shares of some values from their targets, ``mad``."""
    spark = df.sparkSession
    want = F.broadcast(spark.createDataFrame(list(targets.items()), f"{key} string, target double"))
    joined = want.join(value_shares(df.filter(F.col(key).isNotNull()), key), key, "left")
    return joined.agg(F.avg(F.abs(F.coalesce("share", F.lit(0.0)) - F.col("target"))).alias("mad"))


def index_percentile(values: Column, percent: int) -> Column:
    """Of a sorted array the element at ``int(n * p / 100)``, the last at most."""
    at = F.least(F.floor(F.size(values) * percent / 100), F.size(values) - 1).cast("int")
    return F.when(F.size(values) > 0, values[at])


def conditional_lift(df: DataFrame, has_a: Column, has_b: Column) -> DataFrame:
    """``p_a, p_b, p_b_given_a, lift`` of two properties of rows; null where nothing can be told."""
    n, a, b, ab = F.count(F.lit(1)), F.count_if(has_a), F.count_if(has_b), F.count_if(has_a & has_b)
    given = F.try_divide(ab.cast("double"), a)
    return df.agg(
        F.try_divide(a.cast("double"), n).alias("p_a"), F.try_divide(b.cast("double"), n).alias("p_b"),
        given.alias("p_b_given_a"), F.try_divide(given, F.try_divide(b.cast("double"), n)).alias("lift"),
    )


def duplicate_signature_rate(df: DataFrame, group: str, member: str) -> DataFrame:
    """Share of groups whose set of members some other group has too, ``dup_rate``."""
    sets = df.groupBy(group).agg(F.array_sort(F.collect_set(member)).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    return sets.agg(F.try_divide(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).cast("double"), F.sum("n")).alias("dup_rate"))


def column_profile(df: DataFrame, columns: list[str], long: int = 255) -> DataFrame:
    """Per column of text: rows, nulls, empty, longer than ``long``, distinct values, and rows beyond them."""
    parts = []
    for c in columns:
        text = F.col(c).cast("string")
        parts += [
            F.count_if(text.isNull()).alias(f"{c}_1"), F.count_if(F.trim(text) == "").alias(f"{c}_2"),
            F.count_if(F.length(text) > long).alias(f"{c}_3"), F.countDistinct(text).alias(f"{c}_4"),
        ]
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *parts)
    structs = [
        F.struct(
            F.lit(c).alias("column_name"), F.col("n_rows"), F.col(f"{c}_1").alias("n_null"), F.col(f"{c}_2").alias("n_empty"),
            F.col(f"{c}_3").alias("n_long"), F.col(f"{c}_4").alias("n_distinct"),
            (F.col("n_rows") - F.col(f"{c}_1") - F.col(f"{c}_4")).alias("n_repeated"),
        )
        for c in columns
    ]
    return one.select(F.inline(F.array(*structs)))
