"""Queries that write and read back, run as streams, or audit whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import audit
from weftline.plans import reshaping
from weftline.plans.relational import _VERSIONS, versions
from weftline.session import scratch, table
from weftline.sources import loaders, writers
from weftline.streaming import flows

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- streams, run until the input there is has been read


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")  # as a pattern, a table may be a file or a folder


def _finished(df: DataFrame, mode: str) -> DataFrame:
    """The result after the last micro-batch, written by each and read back."""
    spark = df.sparkSession
    out = scratch(spark, "stream")
    run = (
        df.writeStream.outputMode(mode)
        .foreachBatch(lambda part, _: part.write.mode("overwrite").parquet(out))
        .option("checkpointLocation", out + "-state")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(out)


@query(reshaping.ORACLE["tumbling_window"])
def stream_tumbling(spark, d):
    events = flows.event_time(_stream(spark, d, "events"), "ts", "1 hour")
    got = flows.windowed(events, ["event_type"], "1 day", None, F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return _finished(got, "complete").withColumn("total", F.round("total", 4))


@query(reshaping.ORACLE["session_window"])
def stream_sessions(spark, d):
    events = flows.event_time(_stream(spark, d, "events"), "ts", "1 hour")
    return _finished(flows.sessions(events, ["user_id"], "6 hours", F.count(F.lit(1)).alias("n")), "complete")


@query("""SELECT event_type, round(list_reduce(list_prepend(0.0::DOUBLE, list(value::DOUBLE ORDER BY ts, value)), lambda a, x: 0.72 * a + x), 6) AS state FROM events WHERE event_type IS NOT NULL GROUP BY 1""")
def stream_state(spark, d):
    """A state carried over the events of each type, here in one micro-batch."""
    events = flows.event_time(_stream(spark, d, "events").filter("event_type IS NOT NULL"), "ts", "1 hour")
    return _finished(flows.smoothed_state(events, "event_type", "value", 0.72), "update").withColumn("state", F.round("state", 6))


@query("SELECT coalesce(valid_from, 0) AS event_year, count(*) AS n, count(DISTINCT row_id) AS n_rows FROM edges GROUP BY 1")
def stream_log_by_year(spark, d):
    """Edges streamed into a log laid out by year, read back."""
    out = scratch(spark, "log")
    edges = _stream(spark, d, "edges").withColumn("event_year", F.coalesce("valid_from", F.lit(0)))
    flows.append_by_year(edges.select("row_id", "event_year"), out, out + "-state").awaitTermination()
    return spark.read.parquet(out).groupBy("event_year").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("n_rows"))


# ---- written and read back


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def arrow_round_trip(spark, d):
    out = scratch(spark, "arrow")
    from weftline.sources.arrow_ipc import ArrowSource

    spark.dataSource.register(ArrowSource)
    table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate").write.format("arrow_ipc").mode("append").save(out)
    return loaders.read_arrow(spark, out)


@query("SELECT DISTINCT company_id, nullif(name, '') AS name, country, nullif(specialty_genres, '') AS specialty_genres, founded_year FROM company")
def csv_round_trip(spark, d):
    """A table written as CSV for bulk loads; empty text comes back as null."""
    out = scratch(spark, "csv")
    writers.write_table(table(spark, d, "company").select("company_id", "name", "country", "specialty_genres", "founded_year").distinct(), out, kind="csv")
    back = loaders.read_bulk_csv(spark, out, "company_id long, name string, country string, specialty_genres string, founded_year int")
    return back.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("name", "specialty_genres")})


@query("SELECT DISTINCT company_id, name, founded_year FROM company")
def json_round_trip(spark, d):
    out = scratch(spark, "json") + ".json"
    writers.write_json_batch(table(spark, d, "company").select("company_id", "name", "founded_year").distinct(), out)
    return loaders.read_json_batch(spark, out, "company_id long, name string, founded_year int")


@query(f"SELECT kind, count(*) AS n, min(vf) AS first FROM ({_VERSIONS}) GROUP BY 1")
def compiled_edges(spark, d):
    """Distinct versions compiled once and loaded the second time."""
    out = scratch(spark, "compiled")
    for _ in range(2):
        edges = writers.load_or_compile(spark, out, "v1", lambda: versions(spark, d))
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("vf").alias("first"))


# ---- audits: the same expressions in both engines

_AUDIT = {
    "identity": ("movie_context", {"rows": "count(*)", "films": "count(DISTINCT mid)", "no_id": "sum(CASE WHEN mid IS NULL OR mid <= 0 THEN 1 ELSE 0 END)"}),
    "titles": ("movie_context", {"null": "sum(CASE WHEN title IS NULL THEN 1 ELSE 0 END)", "blank": "sum(CASE WHEN trim(title) = '' THEN 1 ELSE 0 END)", "longest": "max(length(title))", "distinct": "count(DISTINCT title)"}),
    "years": ("movie_context", {"first": "min(concept.year)", "last": "max(concept.year)", "null": "sum(CASE WHEN concept.year IS NULL THEN 1 ELSE 0 END)"}),
    "money": ("movie_context", {"no_fin": "sum(CASE WHEN fin IS NULL THEN 1 ELSE 0 END)", "not_positive": "sum(CASE WHEN fin.budget_usd <= 0 THEN 1 ELSE 0 END)"}),
    "ratings": ("movie_context", {"least": "min(fin.rating)", "most": "max(fin.rating)", "no_votes": "sum(CASE WHEN fin.num_votes IS NULL THEN 1 ELSE 0 END)"}),
    "directors": ("movie_context", {"unknown": "sum(CASE WHEN director_id IS NULL OR director_id <= 0 THEN 1 ELSE 0 END)", "distinct": "count(DISTINCT director_id)"}),
    "people": ("person", {"rows": "count(*)", "people": "count(DISTINCT person_id)", "deleted": "count(deleted_at)", "no_name": "sum(CASE WHEN name IS NULL THEN 1 ELSE 0 END)"}),
    "careers": ("person", {"reversed": "sum(CASE WHEN retirement_year < debut_year THEN 1 ELSE 0 END)", "first": "min(debut_year)", "genders": "count(DISTINCT gender)"}),
    "companies": ("company", {"rows": "count(*)", "companies": "count(DISTINCT company_id)", "oldest": "min(founded_year)"}),
    "casts": ("cast_ensemble", {"rows": "count(*)", "films": "count(DISTINCT title_id)", "no_list": "sum(CASE WHEN cast_ids IS NULL THEN 1 ELSE 0 END)"}),
    "edges": ("edges", {"rows": "count(*)", "versions": "count(DISTINCT row_id)", "reversed": "sum(CASE WHEN valid_to < valid_from THEN 1 ELSE 0 END)", "loops": "sum(CASE WHEN src_id = dst_id THEN 1 ELSE 0 END)", "no_type": "sum(CASE WHEN edge_type IS NULL THEN 1 ELSE 0 END)"}),
    "cache": ("cast_year_cache", {"rows": "count(*)", "keys": "count(DISTINCT cache_id)", "no_person": "sum(CASE WHEN pid IS NULL THEN 1 ELSE 0 END)", "first": "min(year)", "last": "max(year)"}),
    "documents": ("documents", {"rows": "count(*)", "null": "sum(CASE WHEN text IS NULL THEN 1 ELSE 0 END)", "no_lang": "sum(CASE WHEN lang IS NULL THEN 1 ELSE 0 END)", "longest": "max(n_chars)"}),
}


def _measured(metrics: dict) -> str:
    """One pass over each table for all its metrics, in SQL."""
    by_table: dict = {}
    for section, (name, of) in metrics.items():
        by_table.setdefault(name, []).extend((section, m, e) for m, e in of.items())
    parts = []
    for name, items in by_table.items():
        rows = ", ".join(f"{{'section': '{s}', 'metric': '{m}', 'value': CAST({e} AS DOUBLE)}}" for s, m, e in items)
        parts.append(f"SELECT x.section, x.metric, x.value FROM (SELECT unnest([{rows}]) AS x FROM {name})")
    return " UNION ALL ".join(parts)


def _metrics(spark: SparkSession, d: str, metrics: dict) -> DataFrame:
    """``section, metric, value``, from one aggregate a table."""
    out = None
    by_table: dict = {}
    for section, (name, of) in metrics.items():
        by_table.setdefault(name, []).extend((section, m, e) for m, e in of.items())
    for name, items in by_table.items():
        one = table(spark, d, name).agg(*[F.expr(e).cast("double").alias(f"_{i}") for i, (_, _, e) in enumerate(items)])
        rows = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.col(f"_{i}").alias("value")) for i, (s, m, _) in enumerate(items)])
        one = one.select(F.inline(rows))
        out = one if out is None else out.unionByName(one)
    return out


@query(_measured(_AUDIT))
def data_audit(spark, d):
    """Thirteen sections of an audit, one pass a table."""
    return _metrics(spark, d, _AUDIT)


#: Shares and correlations that a sound table keeps within bounds.
_GATE = {
    "films": ("movie_context", {"without_money": "avg(CASE WHEN fin IS NULL THEN 1e0 ELSE 0e0 END)", "votes_and_rating": "corr(fin.num_votes, fin.rating)", "mean_runtime": "avg(fin.runtime_minutes)"}),
    "people": ("person", {"repeated": "1e0 - count(DISTINCT person_id) / CAST(count(*) AS DOUBLE)", "mean_weight": "avg(pop_weight)"}),
    "edges": ("edges", {"reversed": "avg(CASE WHEN valid_to < valid_from THEN 1e0 ELSE 0e0 END)", "without_weight": "avg(CASE WHEN weight IS NULL THEN 1e0 ELSE 0e0 END)", "open": "avg(CASE WHEN valid_to IS NULL THEN 1e0 ELSE 0e0 END)"}),
}
_BANDS = {
    "films/without_money": (0.0, 0.2), "films/votes_and_rating": (0.1, 0.9), "films/mean_runtime": (60.0, 200.0), "people/repeated": (0.0, 0.05), "people/mean_weight": (0.0, 1.0),
    "edges/reversed": (0.0, 0.001), "edges/without_weight": (0.0, 0.1), "edges/open": (0.1, 0.9), "edges/missing": (0.0, 1.0),
}
_BAND_ROWS = ", ".join(f"('{m}', {a}, {b})" for m, (a, b) in _BANDS.items())
_GATED = f"""WITH m AS (SELECT section || '/' || metric AS metric, value FROM ({_measured(_GATE)})), b(metric, low, high) AS (VALUES {_BAND_ROWS}),
g AS (SELECT b.metric, round(value, 6) AS value, low::DOUBLE AS low, high::DOUBLE AS high, coalesce(value BETWEEN low AND high, false) AS passed FROM b LEFT JOIN m ON m.metric = b.metric)"""


@query(_GATED + " SELECT * FROM g")
def realism_gate(spark, d):
    """Metrics held against bands; one that is missing doesn't pass."""
    metrics = _metrics(spark, d, _GATE).select(F.concat_ws("/", "section", "metric").alias("metric"), "value")
    return audit.gate(metrics, _BANDS).withColumn("value", F.round("value", 6))


@query(_GATED + """ SELECT split_part(metric, '/', 1) AS section, count(*) AS checks, count_if(passed) AS n_passed,
CASE WHEN count_if(passed) = count(*) THEN 'GOOD' WHEN count_if(passed) * 2 >= count(*) THEN 'FAIR' ELSE 'POOR' END AS verdict FROM g GROUP BY 1""")
def verification(spark, d):
    """Checks passed and a verdict for each section."""
    gated = realism_gate(spark, d)
    return audit.verdicts(gated.withColumn("section", F.substring_index("metric", "/", 1)), "section", "passed")
