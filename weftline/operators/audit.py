"""Audits: expectations as rows, verdicts by bands, and comparison of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expectations(df: DataFrame, checks: dict[str, tuple[str, Column, float, float]]) -> DataFrame:
    """``category, name, status, n_bad, share`` of rows that break each expectation, in one pass.

    ``checks`` maps a name to its category, the condition of a bad row, and the shares
    up to which it passes or warns. A null condition is not bad.
    """
    items = list(checks.items())
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(bad).alias(f"_{i}") for i, (_, (_, bad, _, _)) in enumerate(items)])
    rows = []
    for i, (name, (category, _, ok, warn)) in enumerate(items):
        share = F.coalesce(F.try_divide(F.col(f"_{i}").cast("double"), F.col("_n")), F.lit(0.0))
        status = F.when(share <= ok, "PASS").when(share <= warn, "WARN").otherwise("FAIL")
        rows.append(F.struct(F.lit(category).alias("category"), F.lit(name).alias("name"), status.alias("status"), F.col(f"_{i}").alias("n_bad"), share.alias("share")))
    return one.select(F.inline(F.array(*rows)))


def gate(metrics: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """``metric, value, low, high, passed`` of ``metric, value`` held against bands; a missing metric doesn't pass."""
    spark = metrics.sparkSession
    want = F.broadcast(spark.createDataFrame([(m, *b) for m, b in bands.items()], "metric string, low double, high double"))
    return want.join(metrics, "metric", "left").select("metric", "value", "low", "high", F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(False)).alias("passed"))


def compared(baseline: DataFrame, variant: DataFrame) -> DataFrame:
    """``metric, baseline, variant, delta`` of two tables of ``metric, value``."""
    b, v = baseline.select("metric", F.col("value").alias("baseline")), variant.select("metric", F.col("value").alias("variant"))
    return b.join(v, "metric", "full").select("metric", "baseline", "variant", (F.col("variant") - F.col("baseline")).alias("delta"))


def verdicts(checks: DataFrame, section: str, passed: str) -> DataFrame:
    """``section, checks, n_passed, verdict``: GOOD if all pass, FAIR if at least half do, else POOR."""
    got = checks.groupBy(section).agg(F.count(F.lit(1)).alias("checks"), F.count_if(passed).alias("n_passed"))
    word = F.when(F.col("n_passed") == F.col("checks"), "GOOD").when(F.col("n_passed") * 2 >= F.col("checks"), "FAIR").otherwise("POOR")
    return got.withColumn("verdict", word)
