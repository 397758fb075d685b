"""Attributes as known at event time: events joined with the version that was
valid for the event's period and already known at the event's moment.

Entities are hash-partitioned into buckets. In each bucket an embedded DuckDB
builds, per entity and period, the chain of current-state versions ordered by
the moment they became known, resolves ties before the join, and runs one
``ASOF LEFT JOIN``. The rows of an entity with more than ``hot_rows`` rows, or
with a longer chain than ``chain_rows``, are sorted by period and time and cut into
units of equal size, wherever they lie; a unit starts with the state carried over
from those before it, so a hot entity spreads over many buckets with the same result.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import broadcast_if_small, checkpoint, clean_label, parallelism

#: Rows of one bucket, both sides together.
BUCKET_ROWS = 150_000
#: Entities with more rows than this, or more pairs of a period and a version, are cut into units of the rows' order.
HOT_ROWS = 50_000
CHAIN_ROWS = 1_000_000

_SQL = """
WITH ev AS (
  SELECT _event, _entity, _period, min(_at) AS _at FROM events GROUP BY ALL
), ve AS (
  SELECT _version, _entity, _first, _last, _from, min(_known) AS _known FROM versions GROUP BY ALL
), asked AS (
  SELECT DISTINCT _entity, _period FROM ev
), chain AS (
  SELECT a._entity, a._period, v._known, v._from, v._version
  FROM asked a JOIN ve v ON v._entity = a._entity AND a._period BETWEEN v._first AND v._last
), settled AS (
  SELECT * FROM chain
  QUALIFY row_number() OVER (PARTITION BY _entity, _period, _known ORDER BY _from DESC, _version DESC) = 1
), state AS (
  SELECT * FROM settled
  QUALIFY _from >= max(_from) OVER (PARTITION BY _entity, _period ORDER BY _known
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT e._event, s._version, s._known
FROM ev e ASOF LEFT JOIN state s
  ON e._entity = s._entity AND e._period = s._period AND e._at >= s._known
"""


@dataclass(frozen=True)
class AsofSpec:
    """Sizes of the work units; results don't depend on them."""

    bucket_rows: int = BUCKET_ROWS
    hot_rows: int = HOT_ROWS
    chain_rows: int = CHAIN_ROWS


def _bucket_join(events: pa.Table, versions: pa.Table) -> pa.Table:
    import duckdb

    # a bucket is small by its rows and chains, so nothing has to spill to a local folder
    con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
    try:
        con.register("events", events)
        con.register("versions", versions)
        got = con.sql(_SQL).to_arrow_table()
    finally:
        con.close()
    return got.cast(pa.schema([("_event", pa.int64()), ("_version", pa.int64()), ("_known", pa.int64())]))


def _micros(column: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros(column.cast("timestamp"))


def asof_versions(events: DataFrame, versions: DataFrame, spec: AsofSpec = AsofSpec()) -> DataFrame:
    """For each event the version to use, or none.

    ``events`` has ``_event, _entity, _period, _at``; ``versions`` has ``_version,
    _entity, _first, _last`` (periods in which it is active, both ends), ``_from``
    and ``_known``. Of several usable versions the greatest ``_from`` wins, then the
    latest ``_known``, then the greatest ``_version``. Returns ``_event, _version,
    _known``, one row per distinct event.

    Repeated rows count once with their earliest time. Events without entity,
    period or time come out without version; versions with a null in any column or
    without an active period are never used. Empty inputs give no rows, or events
    without version.
    """
    spark = events.sparkSession
    events = events.select("_event", "_entity", "_period", "_at")
    versions = versions.select("_version", "_entity", "_first", "_last", "_from", "_known").dropna().filter("_first <= _last")
    whole = events.filter(F.col("_entity").isNotNull() & F.col("_period").isNotNull() & F.col("_at").isNotNull())
    mark_of = lambda df, events: df.select("_entity", F.lit(events).alias("_e"), (F.col("_period") if events else F.lit(None).cast("int")).alias("_p"))
    counts = (
        mark_of(whole, 1)
        .unionAll(mark_of(versions, 0))
        .groupBy("_entity")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_e").cast("bigint").alias("_events"), (F.max("_p") - F.min("_p") + 1).alias("_span"))
        # a version meets each asked period at most once
        .withColumn("_chain", F.coalesce((F.col("_n") - F.col("_events")) * F.least(F.col("_events"), F.col("_span").cast("bigint")), F.lit(0)))
    )
    is_hot = (F.col("_n") > spec.hot_rows) | (F.col("_chain") > spec.chain_rows)
    hot = counts.filter(is_hot).select("_entity")
    facts = counts.agg(
        F.sum("_n").alias("rows"), F.count_if(is_hot).alias("hot"), F.sum(F.when(~is_hot, F.col("_chain"))).alias("chains"), F.sum(F.when(is_hot, F.col("_n"))).alias("hot_n")
    ).first()
    rows, n_hot = facts["rows"] or 0, facts["hot"]
    # chains count a tenth, as most versions are not active in most periods
    buckets = max(parallelism(spark), -(-rows // spec.bucket_rows), -(-(facts["chains"] or 0) // (10 * spec.bucket_rows)))
    cold_events, cold_versions = whole, versions
    parts: list[tuple[DataFrame, DataFrame]] = []
    if n_hot:
        mark = broadcast_if_small(hot, n_hot)
        cold_events, cold_versions = whole.join(mark, "_entity", "left_anti"), versions.join(mark, "_entity", "left_anti")
        n_units = max(parallelism(spark), -(-(facts["hot_n"] or 0) // spec.bucket_rows))
        parts.append(_hot_units(whole.join(mark, "_entity", "left_semi"), versions.join(mark, "_entity", "left_semi"), n_units, buckets))
    entity_bucket = F.pmod(F.xxhash64("_entity"), F.lit(buckets)).cast("int").alias("_bucket")
    parts.append((cold_events.select("*", entity_bucket), cold_versions.select("*", entity_bucket)))
    left, right = parts[-1]
    for e, v in parts[:-1]:
        left, right = left.unionByName(e), right.unionByName(v)
    joined = (
        left.groupBy("_bucket")
        .cogroup(right.groupBy("_bucket"))
        .applyInArrow(_bucket_join, "_event bigint, _version bigint, _known bigint")
    )
    lacking = events.filter(F.col("_entity").isNull() | F.col("_period").isNull() | F.col("_at").isNull())
    lacking = lacking.select("_event", F.lit(None).cast("bigint").alias("_version"), F.lit(None).cast("bigint").alias("_known")).distinct()
    return joined.unionByName(lacking)


def _hot_units(events: DataFrame, versions: DataFrame, n_units: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Cuts the rows of hot entities, in the order of entity, period and time, into units of equal size.

    The cut may fall anywhere, also between events of one moment, as a unit takes the
    best version of all units before it along. Units are numbered from ``buckets`` on.
    """
    events = events.groupBy("_event", "_entity", "_period").agg(F.min("_at").alias("_at"))
    versions = versions.groupBy("_version", "_entity", "_first", "_last", "_from").agg(F.min("_known").alias("_known"))
    # periods are few by their meaning (years), so an entity's set of them is short however many events it has
    periods = events.groupBy("_entity").agg(F.collect_set("_period").alias("_periods"))
    best = F.max(F.struct("_from", "_known", "_version")).alias("_best")
    # of the versions that became known at one moment only the best can ever be used
    spread = (
        versions.join(periods, "_entity")
        .select("*", F.explode(F.filter("_periods", lambda p: p.between(F.col("_first"), F.col("_last")))).alias("_period"))
        .groupBy("_entity", "_period", F.col("_known").alias("_at"))
        .agg(best)
    )
    none = F.lit(None).cast(spread.schema["_best"].dataType)
    rows = spread.select("_entity", "_period", "_at", F.lit(None).cast("bigint").alias("_event"), "_best").unionByName(
        events.select("_entity", "_period", "_at", "_event", none.alias("_best"))
    )
    # a version comes before the events of its moment: nulls are first
    ordered = rows.repartitionByRange(n_units, "_entity", "_period", "_at", F.col("_event").asc_nulls_first())
    # written once, as a range computed again could be cut elsewhere
    ordered = checkpoint(ordered.withColumn("_unit", F.spark_partition_id()))
    upto = ordered.groupBy("_entity", "_period", "_unit").agg(F.max("_best").alias("_best"))
    before = Window.partitionBy("_entity", "_period").orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    carried = upto.select("_entity", "_period", "_unit", F.max("_best").over(before).alias("_best"))
    states = ordered.select("_entity", "_period", "_unit", "_best").unionByName(carried).filter("_best IS NOT NULL")
    bucket = (F.col("_unit") + buckets).alias("_bucket")
    period = F.col("_period")
    return (
        ordered.filter("_event IS NOT NULL").select("_event", "_entity", "_period", "_at", bucket),
        states.select("_best._version", "_entity", period.alias("_first"), period.alias("_last"), "_best._from", "_best._known", bucket),
    )


def employment_asof(cache: DataFrame, edges: DataFrame, spec: AsofSpec = AsofSpec()) -> DataFrame:
    """Each cache row with the employment version usable in its year and known when it was made.

    Returns ``cache_id, row_id, known_at``; ``row_id`` is null where none is usable.
    Edge versions that are null or reversed in their bounds are never active.
    """
    events = cache.select(
        F.col("cache_id").alias("_event"), F.col("pid").alias("_entity"), F.col("year").alias("_period"), _micros(F.col("built_at")).alias("_at")
    )
    retired = F.coalesce(F.col("_scd2_retired"), F.lit(False))
    versions = edges.filter(
        (clean_label(F.col("edge_type")) == "employment")
        & F.col("valid_from").isNotNull()
        & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.col("valid_from")))
    ).select(
        F.col("row_id").alias("_version"),
        F.col("dst_id").alias("_entity"),
        F.col("valid_from").alias("_first"),
        F.when(F.col("valid_to").isNull(), F.lit(2_147_483_647))
        .otherwise(F.col("valid_to") - retired.cast("int"))
        .alias("_last"),
        F.col("valid_from").alias("_from"),
        _micros(F.col("recorded_at")).alias("_known"),
    )
    got = asof_versions(events, versions, spec)
    return got.select(F.col("_event").alias("cache_id"), F.col("_version").alias("row_id"), F.timestamp_micros("_known").alias("known_at"))
