"""Per-key results where a few keys hold most of the rows: exact per-key counts
and quantiles by distributed selection over mergeable histograms.

The rows are first reduced to counts per key and value, which merge anywhere and
spread a hot key over all tasks. Keys with up to ``hot_records`` records resolve
at that finest resolution. For the others a histogram of ``bins`` counts per key
and sought rank is refined round by round: the bin that holds the rank becomes
the next range, until it holds one value. The open ranges are a table like any
other, so there may be any number of hot keys. A hot key's values are never
gathered; a round moves at most ``bins`` counts per hot key and rank from each task.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import broadcast_if_small, checkpoint

BINS = 256
HOT_RECORDS = 10_000
#: Ranges whose ends are so far apart are cut by size, not by width, so that few rounds do.
FAR = float(1 << 20)


def nearest_rank(n: Column, prob: str | float | Decimal) -> Column:
    """Rank of a quantile among ``n`` ordered values, exact in decimals, 1 at least."""
    share = Decimal(str(prob))
    top = 10 ** max(0, -share.as_tuple().exponent)
    scaled = n.cast("decimal(38,0)") * F.lit(int(share * top)).cast("decimal(10,0)")
    rank = F.ceil(scaled / F.lit(top).cast("decimal(10,0)")).cast("bigint")
    return F.greatest(rank, F.lit(1).cast("bigint"))


def keyed_histogram(df: DataFrame, key: Column, value: Column, record: Column) -> DataFrame:
    """``key, value, n``: records per key and value, each record once per key.

    Values that are null, NaN or infinite count under a null value. If a record
    comes more than once under a key, its least value counts.
    """
    value = value.cast("double")
    finite = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    once = df.select(record.alias("record"), key.alias("key"), finite.alias("value")).groupBy("record", "key").agg(F.min("value").alias("value"))
    return once.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def key_totals(hist: DataFrame) -> DataFrame:
    """``key, n_records, n_values, lo, hi`` of each key that isn't null."""
    return hist.filter("key IS NOT NULL").groupBy("key").agg(
        F.sum("n").alias("n_records"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("n_values"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
    )


def keyed_quantiles(hist: DataFrame, probs: Sequence[str] = ("0.5", "0.95"), hot_records: int = HOT_RECORDS, bins: int = BINS, only: DataFrame | None = None) -> DataFrame:
    """Per key its records, its finite values and exact nearest-rank quantiles.

    ``hist`` is a table of ``key, value, n`` as by :func:`keyed_histogram`, or the
    union of several (from other files or days). Returns ``key, n_records, n_values``
    and one column per quantile, ``q0_5`` for "0.5"; null where a key has no finite
    value. Null keys give no row. An empty table gives no rows. ``only`` names the
    keys asked for, as a short list in a column ``key``.
    """
    hist = hist.select("key", "value", "n").filter("key IS NOT NULL")
    if only is not None:
        hist = hist.join(F.broadcast(only.select("key").distinct()), "key", "left_semi")
    # written once, in the shared folder, as each round reads it
    hist = checkpoint(hist.groupBy("key", "value").agg(F.sum("n").alias("n")))
    stats = key_totals(hist)
    hot = checkpoint(stats.filter(F.col("n_values") > hot_records))
    n_hot = hot.count()
    names = {p: "q" + str(p).replace(".", "_") for p in probs}
    values = hist.filter("value IS NOT NULL")
    cold_values = values.join(broadcast_if_small(hot.select("key"), n_hot), "key", "left_anti") if n_hot else values
    # a cold key has at most hot_records values
    by_value = Window.partitionBy("key").orderBy("value")
    upto = by_value.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = cold_values.select("key", "value", F.sum("n").over(upto).alias("cum"), F.sum("n").over(Window.partitionBy("key")).alias("all"))
    picked = ranked.groupBy("key").agg(
        *[F.min(F.when(F.col("cum") >= nearest_rank(F.col("all"), p), F.col("value"))).alias(names[p]) for p in probs]
    )
    if n_hot:
        found = _refine(values, hot, n_hot, probs, bins)
        wide = found.groupBy("key").agg(*[F.max(F.when(F.col("prob") == str(p), F.col("lo"))).alias(names[p]) for p in probs])
        picked = picked.unionByName(wide)
    return stats.join(picked, "key", "left").select("key", "n_records", "n_values", *names.values())


def _refine(values: DataFrame, hot: DataFrame, n_hot: int, probs: Sequence[str], bins: int) -> DataFrame:
    """``key, prob, lo``: the exact quantiles of the hot keys."""
    ranks = F.array(*[F.struct(F.lit(str(p)).alias("prob"), nearest_rank(F.col("n_values"), p).alias("rank")) for p in probs])
    open_ = hot.select("key", "lo", "hi", F.inline(ranks))
    # only hot keys' counts are read in the rounds
    held = values.join(broadcast_if_small(hot.select("key"), n_hot), "key", "left_semi")
    done = open_.filter("lo = hi").select("key", "prob", "lo")
    open_ = open_.filter("lo < hi")
    lo, hi, value = F.col("lo"), F.col("hi"), F.col("value")
    # halves, so that the width of the range can't overflow
    by_width = F.try_divide(value / 2 - lo / 2, hi / 2 - lo / 2)
    # of the root, which can't overflow
    size = lambda x: F.signum(x) * F.log1p(F.sqrt(F.abs(x)) * F.lit(1e6))
    by_size = F.try_divide(size(value) - size(lo), size(hi) - size(lo))
    # no quotient, as a range may begin or end at 0
    far = F.greatest(F.abs(lo), F.abs(hi)) > F.least(F.abs(lo), F.abs(hi)) * FAR
    share = F.coalesce(F.when(far, by_size), by_width, F.lit(0.0))
    # the ends come into different bins even where the range has no width to divide by, so that each round narrows it
    place = F.when(value == hi, F.lit(bins - 1)).otherwise(F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(share * bins))))
    before = Window.partitionBy("key", "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    while n := open_.count():
        ranges = open_.select("key", "lo", "hi").distinct()
        counts = (
            held.join(broadcast_if_small(ranges, n), "key")
            .filter(value.between(lo, hi))
            .groupBy("key", "lo", "hi", place.alias("bin"))
            .agg(F.sum("n").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
            .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        )
        narrowed = open_.join(counts, ["key", "lo", "hi"]).filter((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("n")))
        narrowed = checkpoint(narrowed.select("key", "prob", (F.col("rank") - F.col("before")).alias("rank"), F.col("least").alias("lo"), F.col("most").alias("hi")))
        done = done.unionByName(narrowed.filter("lo = hi").select("key", "prob", "lo"))
        open_ = narrowed.filter("lo < hi")
    return done


def heavy_keys(quantiles: DataFrame, total_records: int, share: str = "0.02") -> DataFrame:
    """The keys of :func:`keyed_quantiles` or :func:`key_totals` that hold at least ``share`` of all records."""
    part = Decimal(share)
    top = 10 ** max(0, -part.as_tuple().exponent)
    return quantiles.filter(F.col("n_records") * top >= F.lit(int(total_records * int(part * top))))
