"""Rows made from rows: splits with fixed sums, chains of intervals, crosses, nested series, links back, and calibrated weights.

All draws come from the seed and the row's key, so the same rows come out however the table
is divided. Everything is a column expression; nothing is kept between rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.scalars import key_uniform
from weftline.operators.ranking import dense_ids


def _drawn(seed: int, key: str, *what: Column | str) -> Column:
    return key_uniform(seed, F.col(key), *[F.lit(w) if isinstance(w, str) else w for w in what])


def weekly(df: DataFrame, key: str, total: str, least: int = 4, most: int = 12, keep: float = 0.6, seed: int = 42) -> DataFrame:
    """``key, week, amount``: a total spread over a drawn number of weeks, each ``keep`` of the one before.

    Amounts are whole numbers and sum to the rounded total; the first week takes the rest.
    Totals that are null, not finite or not above 0 give no rows.
    """
    amount = F.col(total).cast("double")
    kept = df.filter(amount.isNotNull() & ~F.isnan(amount) & (amount < float("inf")) & (amount > 0))
    n = (F.lit(least) + F.floor(_drawn(seed, key, "weeks") * (most - least + 1))).cast("int")
    whole = F.round(amount).cast("bigint")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.pow(F.lit(keep), k))
    shares = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    later = F.transform(parts, lambda x, i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.floor(whole * x / shares)))
    rest = whole - F.aggregate(later, F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = F.transform(later, lambda x, i: F.struct((i + 1).alias("week"), F.when(i == 0, rest).otherwise(x).alias("amount")))
    return kept.select(key, F.inline(rows))


def crossed(df: DataFrame, key: str, total: str, dims: dict[str, list[str]], seed: int = 42) -> DataFrame:
    """``key``, a column for each of two short lists, and ``n``: a count split over their cells by drawn shares, with its sum kept.

    The first cell takes what rounding leaves. Null and negative counts give no rows.
    """
    (a, of_a), (b, of_b) = dims.items()
    cells = [(x, y) for x in of_a for y in of_b]
    draws = F.array(*[0.1 + _drawn(seed, key, f"{x}/{y}") for x, y in cells])
    summed = F.aggregate(draws, F.lit(0.0), lambda s, x: s + x)
    later = F.transform(draws, lambda x, i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.floor(F.col(total) * x / summed)))
    rest = F.col(total).cast("bigint") - F.aggregate(later, F.lit(0).cast("bigint"), lambda s, x: s + x)
    names = F.array(*[F.struct(F.lit(x).alias(a), F.lit(y).alias(b)) for x, y in cells])
    rows = F.transform(later, lambda x, i: F.struct(F.get(names, i)[a].alias(a), F.get(names, i)[b].alias(b), F.when(i == 0, rest).otherwise(x).alias("n")))
    return df.filter(F.col(total) >= 0).select(key, F.inline(rows))


def phases(df: DataFrame, key: str, end: str, lengths: dict[str, tuple[int, int]], seed: int = 42) -> DataFrame:
    """``key, phase, starts_on, ends_on``: intervals that follow each other without a gap and end on a date, with drawn lengths in days."""
    names = list(lengths)
    days = {p: (F.lit(a) + F.floor(_drawn(seed, key, p) * (b - a + 1))).cast("int") for p, (a, b) in lengths.items()}
    last = F.col(end).cast("string").try_cast("date")
    rows = []
    for i, p in enumerate(names):
        behind = sum((days[q] for q in names[i + 1 :]), F.lit(0))
        rows.append(F.struct(F.lit(p).alias("phase"), F.date_sub(last, (behind + days[p]).cast("int")).alias("starts_on"), F.date_sub(last, behind.cast("int")).alias("ends_on")))
    return df.filter(last.isNotNull()).select(key, F.inline(F.array(*rows)))


def series(df: DataFrame, key: str, seasons: int = 4, episodes: int = 8, seed: int = 42) -> DataFrame:
    """``key, season, episode``: up to so many seasons, and in each up to so many episodes, nested."""
    n = F.lit(1) + F.floor(_drawn(seed, key, "seasons") * seasons).cast("int")
    outer = df.select(key, F.explode(F.sequence(F.lit(1), n)).alias("season"))
    m = F.lit(1) + F.floor(_drawn(seed, key, F.col("season")) * episodes).cast("int")
    return outer.select(key, "season", F.explode(F.sequence(F.lit(1), m)).alias("episode"))


def links_back(df: DataFrame, key: str, order: list[str], share: float = 0.3, seed: int = 42) -> DataFrame:
    """``key, earlier``: for a drawn share of rows one row before it in order, late ones being likelier.

    Rows are numbered over range partitions, and a row looks its partner up by number.
    """
    numbered = dense_ids(df.select(*dict.fromkeys([key, *order])), order, "_n")
    back = F.floor((F.col("_n") - 1) * F.sqrt(_drawn(seed, key, "which"))) + 1
    drawn = numbered.filter((F.col("_n") > 1) & (_drawn(seed, key, "linked") < share)).select(key, back.cast("bigint").alias("_m"))
    return drawn.join(numbered.select(F.col("_n").alias("_m"), F.col(key).alias("earlier")), "_m").select(key, "earlier")


def ratings(df: DataFrame, key: str, count: str, users: int, seed: int = 42) -> DataFrame:
    """``key, user_id, stars``: so many ratings of each row, low user ids in far more of them than high ones."""
    one = df.filter(F.col(count) > 0).select(key, F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))).alias("_i"))
    user = F.floor(F.pow(_drawn(seed, key, F.col("_i"), "user"), F.lit(3)) * users) + 1
    stars = F.floor(_drawn(seed, key, F.col("_i"), "stars") * 10) + 1
    return one.select(key, user.cast("bigint").alias("user_id"), stars.cast("int").alias("stars")).dropDuplicates([key, "user_id", "stars"])


def calibrated(df: DataFrame, weight: str, target: float, steps: int = 40, tolerance: float = 1e-3) -> tuple[DataFrame, float]:
    """The table with ``calibrated``, the weight to a power under which its Gini index meets the target, and that power.

    Bisection between powers 0 and 16; each step is one pass. Weights not above 0 count 0. ValueError if no
    power in that range does, as for equal weights.
    """
    from weftline.operators.statistics import gini

    base = F.when(F.col(weight) > 0, F.col(weight)).otherwise(0.0)
    low, high = 0.0, 16.0
    for _ in range(steps):
        middle = (low + high) / 2
        # values beside the greatest, so that powers stay in range
        found = gini(df.select(F.pow(base, F.lit(middle)).alias("v")), "v").first()[0]
        if found is None or abs(found - target) <= tolerance:
            return df.withColumn("calibrated", F.pow(base, F.lit(middle))), middle
        low, high = (middle, high) if found < target else (low, middle)
    raise ValueError(f"no power of {weight} gives a Gini index of {target}")
