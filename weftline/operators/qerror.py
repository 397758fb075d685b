"""Estimated against actual rows of a query's operators, and reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def q_error(estimated: Column, actual: Column, floor: float = 0.5) -> Column:
    """``max(e / a, a / e)`` with both held to at least ``floor``; with a floor of 0 infinite for a zero."""
    e, a = F.greatest(estimated.cast("double"), F.lit(floor)), F.greatest(actual.cast("double"), F.lit(floor))
    both = F.greatest(F.try_divide(e, a), F.try_divide(a, e))
    return F.when(estimated.isNull() | actual.isNull(), None).when((e == 0) | (a == 0), F.lit(float("inf"))).otherwise(both)


def bias(estimated: Column, actual: Column, floor: float = 0.5) -> Column:
    return F.log2(F.greatest(estimated.cast("double"), F.lit(floor)) / F.greatest(actual.cast("double"), F.lit(floor)))


#: Bounds of the bands of a report.
BANDS = ((100.0, "MASSIVE"), (50.0, "STRONG"), (5.0, "REAL"))


def verdict(q: Column) -> Column:
    out = F.lit("mild")
    for least, name in reversed(BANDS):
        out = F.when(q >= least, name).otherwise(out)
    return out


def analyzed(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Saves tables and collects statistics of all columns, without which there are no estimates of rows."""
    for name, df in tables.items():
        df.write.mode("overwrite").saveAsTable(name)
        spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")


def plan_nodes(spark: SparkSession, sql: str) -> DataFrame:
    """``nth, depth, node, estimated, actual``, from the root down, of a query's joins, filters and scans in the optimized plan.

    Each node's rows are counted by running its subplan, so this is for diagnosis on a
    sample of data, not for the queries themselves.
    """
    before = spark.conf.get("spark.sql.cbo.enabled")
    spark.conf.set("spark.sql.cbo.enabled", "true")
    jvm = spark._jvm
    plan = spark.sql(sql)._jdf.queryExecution().optimizedPlan()
    rows: list[tuple] = []

    def walk(node, depth: int) -> None:
        name = node.nodeName()
        if name in ("Join", "Filter", "Relation", "LogicalRelation", "Aggregate"):
            stats = node.stats().rowCount()
            counted = jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, node).count()
            rows.append((len(rows), depth, name, int(str(stats.get())) if stats.isDefined() else None, counted))
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i), depth + 1)

    try:
        walk(plan, 0)
    finally:
        spark.conf.set("spark.sql.cbo.enabled", before)
    return spark.createDataFrame(rows, "nth int, depth int, node string, estimated long, actual long")


def below_aggregate(nodes: DataFrame) -> DataFrame:
    """The first node under the topmost aggregate of :func:`plan_nodes`, whose rows a count hides; none without an aggregate."""
    top = nodes.filter("node = 'Aggregate'").agg(F.min("nth").alias("_top"))
    under = nodes.join(F.broadcast(top), F.col("nth") > F.col("_top")).filter("node <> 'Aggregate'")
    return under.orderBy("nth").limit(1).drop("_top")


def real_nodes(nodes: DataFrame) -> DataFrame:
    """Joins and filters that have an estimate and gave rows, with ``q`` and ``verdict``; others tell nothing about estimates."""
    real = nodes.filter("node IN ('Join', 'Filter') AND estimated IS NOT NULL AND actual > 0")
    q = q_error(F.col("estimated"), F.col("actual"))
    return real.withColumn("q", q).withColumn("verdict", verdict(q))


def summary(results: DataFrame, group: str | None = None) -> DataFrame:
    """Number, median, 75th and 90th by index, mean, greatest q-error and mean bias, of ``q, bias``."""
    from weftline.operators.statistics import index_percentile

    values = F.array_sort(F.collect_list("q"))  # a row for each query of a benchmark
    aggs = [
        F.count("q").alias("n"), index_percentile(values, 50).alias("median"), index_percentile(values, 75).alias("p75"),
        index_percentile(values, 90).alias("p90"), F.avg("q").alias("mean"), F.max("q").alias("most"), F.avg("bias").alias("mean_bias"), F.stddev("bias").alias("std_bias"),
    ]
    return results.groupBy(*([group] if group else [])).agg(*aggs)


def count_form(sql: str) -> str:
    """A query's count of result rows, for its true number of rows."""
    return f"SELECT count(*) AS n FROM ({sql.strip().rstrip(';')}) AS q"


def scale_structure(results: DataFrame, rows: str, q: str) -> DataFrame:
    """``bucket, n, mean_q, q_by_root, log_correlation`` by the decade of the true rows; rows and errors are above 0.

    A correlation near 0 and an error by root that falls say that errors come from structure, not from size.
    """
    got = results.filter((F.col(rows) > 0) & (F.col(q) > 0))
    return got.groupBy(F.floor(F.log10(rows)).cast("int").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(q), 6).alias("mean_q"), F.round(F.avg(F.col(q) / F.sqrt(rows)), 6).alias("q_by_root"),
        F.round(F.corr(F.log(rows), F.log(q)), 6).alias("log_correlation"),
    )
