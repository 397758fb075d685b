"""Overlapping and gapped intervals: continuous periods and the gaps between
them by a sweep over boundary events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import clean_label

#: The last year of a version whose end is open.
OPEN_YEAR = 9999
#: Edge types without direction.
UNDIRECTED = (
    "friendship", "rivalry", "collaboration", "chemistry", "clique",
    "former_collaborator", "co_production", "market_rival", "subsidiary",
)


def sweep_periods(boundaries: DataFrame, keys: list[str]) -> DataFrame:
    """Continuous periods and gaps of integer intervals by a sweep line.

    ``boundaries`` has the key columns, ``_at`` (a position), ``_delta`` (+1 where an
    interval starts, -1 behind its end) and ``_starts`` (intervals that start there);
    rows of one key and position are summed first, which also takes the weight off
    hot keys, as a key then has one row per position; positions have to be few for a
    key (years, days), as one task sweeps over them. Returns the keys, ``span_kind``
    ("merged" for each period, "gap" between two), ``at_from``, ``at_to`` and
    ``n_intervals`` (null for gaps). Touching intervals form one period. Null keys
    are keys like others; rows with a null position are left out.
    """
    events = (
        boundaries.filter("_at IS NOT NULL")
        .groupBy(*keys, "_at")
        .agg(F.sum("_delta").alias("_delta"), F.sum("_starts").alias("_starts"))
    )
    order = Window.partitionBy(*keys).orderBy("_at")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    active = events.select(*keys, "_at", F.sum("_delta").over(upto).alias("_active"), F.sum("_starts").over(upto).alias("_seen"))
    marked = active.select(
        *keys, "_at", "_active", "_seen",
        F.coalesce(F.lag("_active").over(order), F.lit(0)).alias("_was"),
        F.max(F.when(F.col("_active") == 0, F.col("_at"))).over(before).alias("_closed"),
        F.coalesce(F.max(F.when(F.col("_active") == 0, F.col("_seen"))).over(before), F.lit(0)).alias("_seen_before"),
    )
    opened = marked.withColumn("_open", F.max(F.when(F.col("_was") == 0, F.col("_at"))).over(upto))
    closing = opened.filter((F.col("_active") == 0) & (F.col("_was") > 0))
    span = lambda kind, a, b, n: F.struct(F.lit(kind).alias("span_kind"), a.alias("at_from"), b.alias("at_to"), n.cast("bigint").alias("n_intervals"))
    period = span("merged", F.col("_open"), F.col("_at") - 1, F.col("_seen") - F.col("_seen_before"))
    gap = span("gap", F.col("_closed"), F.col("_open") - 1, F.lit(None))
    spans = F.when(F.col("_closed").isNull(), F.array(period)).otherwise(F.array(period, gap))
    return closing.select(*keys, F.explode(spans).alias("_span")).select(*keys, "_span.*")


def edge_periods(edges: DataFrame) -> DataFrame:
    """Periods and gaps of each edge, ``src_id, dst_id, edge_type, span_kind, year_from, year_to, n_versions``.

    A version (distinct ``row_id``) covers the whole years in which it is active; a
    null ``valid_from``, reversed bounds or a retired one-year version cover none, and
    a null ``valid_to`` reaches to 9999. Types without direction take the smaller id
    first. Versions with a null end or type belong to no edge and are left out; a null
    ``row_id`` is a version of its own for each distinct content.
    """
    kind = clean_label(F.col("edge_type"))
    retired = F.coalesce(F.col("_scd2_retired"), F.lit(False)).cast("int")
    last = F.coalesce(F.col("valid_to") - retired, F.lit(OPEN_YEAR))
    versions = edges.filter(
        F.col("src_id").isNotNull()
        & F.col("dst_id").isNotNull()
        & F.col("edge_type").isNotNull()
        & F.col("valid_from").isNotNull()
        & (last >= F.col("valid_from"))
    ).select("row_id", kind.alias("edge_type"), "src_id", "dst_id", F.col("valid_from").alias("first"), last.alias("last"))
    swap = F.col("edge_type").isin(*UNDIRECTED) & (F.col("src_id") > F.col("dst_id"))
    versions = versions.select(
        "row_id", "edge_type",
        F.when(swap, F.col("dst_id")).otherwise(F.col("src_id")).alias("src_id"),
        F.when(swap, F.col("src_id")).otherwise(F.col("dst_id")).alias("dst_id"),
        "first", "last",
    ).distinct()
    bound = lambda at, delta, starts: F.struct(at.alias("_at"), F.lit(delta).alias("_delta"), F.lit(starts).alias("_starts"))
    boundaries = versions.select(
        "src_id", "dst_id", "edge_type", F.explode(F.array(bound(F.col("first"), 1, 1), bound(F.col("last") + 1, -1, 0))).alias("_b")
    ).select("src_id", "dst_id", "edge_type", "_b.*")
    spans = sweep_periods(boundaries, ["src_id", "dst_id", "edge_type"])
    return spans.withColumnsRenamed({"at_from": "year_from", "at_to": "year_to", "n_intervals": "n_versions"})
