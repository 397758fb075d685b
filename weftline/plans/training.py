"""The queries p1 to p4 over the film tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.asof import AsofSpec, employment_asof
from weftline.operators.intervals import edge_periods
from weftline.operators.references import broken_references, film_parents, film_references
from weftline.operators.skew import HOT_RECORDS, heavy_keys, key_totals, keyed_histogram, keyed_quantiles
from weftline.session import checkpoint, table

_MONTH = "yyyy-MM"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_events(spark, d).filter("row_id IS NOT NULL").select("cache_id", "row_id")


def p1_events(spark: SparkSession, d: str) -> DataFrame:
    return employment_asof(table(spark, d, "cast_year_cache"), table(spark, d, "edges"))


def p1_hot_events(spark: SparkSession, d: str) -> DataFrame:
    """As p1_events, with so low limits that most people of small tables are cut into units."""
    spec = AsofSpec(bucket_rows=20_000, hot_rows=8, chain_rows=30)
    return employment_asof(table(spark, d, "cast_year_cache"), table(spark, d, "edges"), spec)


def _edge_histogram(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Counts per company and weight, and the records."""
    edges = table(spark, d, "edges")
    return keyed_histogram(edges, F.col("src_id"), F.col("weight"), F.col("row_id")), edges.select("row_id")


def _cast_histogram(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cast = table(spark, d, "cast_ensemble")
    people = cast.select("title_id", "year", F.explode(F.filter("cast_ids", lambda x: x > 0)).alias("person"))
    return keyed_histogram(people, F.col("person"), F.col("year"), F.col("title_id")), cast.select("title_id")


def p2_heavy(spark: SparkSession, d: str, hot_records: int = HOT_RECORDS) -> DataFrame:
    """The keys with at least 2 % of the records, with exact quantiles of their values.

    Counts come first; values of other keys than these few (50 at most a table) aren't sought.
    """
    found = []
    for name, made in (("edges", _edge_histogram), ("cast_ensemble", _cast_histogram)):
        hist, records = made(spark, d)
        hist = checkpoint(hist)
        heavy = checkpoint(heavy_keys(key_totals(hist), records.distinct().count()).select("key"))
        found.append(keyed_quantiles(hist, hot_records=hot_records, only=heavy).withColumn("table_name", F.lit(name)))
    both = found[0].unionByName(found[1])
    return both.select("table_name", F.col("key").alias("key_id"), "n_records", "n_values", "q0_5", "q0_95")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_heavy(spark, d).select("table_name", "key_id")


def p2_edge_weights(spark: SparkSession, d: str) -> DataFrame:
    return keyed_quantiles(_edge_histogram(spark, d)[0]).withColumnRenamed("key", "src_id")


def p2_cast_years(spark: SparkSession, d: str) -> DataFrame:
    return keyed_quantiles(_cast_histogram(spark, d)[0]).withColumnRenamed("key", "person_id")


def p2_edge_weights_refined(spark: SparkSession, d: str) -> DataFrame:
    """As p2_edge_weights, with so low a limit that keys of small tables are refined too."""
    return keyed_quantiles(_edge_histogram(spark, d)[0], hot_records=100, bins=16).withColumnRenamed("key", "src_id")


def p2_cast_years_refined(spark: SparkSession, d: str) -> DataFrame:
    return keyed_quantiles(_cast_histogram(spark, d)[0], hot_records=100, bins=16).withColumnRenamed("key", "person_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    spans = edge_periods(table(spark, d, "edges"))
    kept = spans.filter((F.col("span_kind") == "gap") | (F.col("n_versions") >= 2))
    return kept.select("src_id", "dst_id", "edge_type", "span_kind", "year_from", "year_to")


def p3_periods(spark: SparkSession, d: str) -> DataFrame:
    return edge_periods(table(spark, d, "edges"))


def _broken(spark: SparkSession, d: str, **limits: int) -> DataFrame:
    refs = film_references(table(spark, d, "edges"), table(spark, d, "movie_context"))
    parents = film_parents(table(spark, d, "person"), table(spark, d, "company"))
    return broken_references(refs, parents, **limits).withColumn("ref_month", F.date_format("at", _MONTH))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _broken(spark, d).select("table_name", "ref_field", "row_key", "ref_state", "ref_month")


def p4_found_split(spark: SparkSession, d: str) -> DataFrame:
    """As p4_found, with a filter too small for the parents and limits that split the list of suspicious keys."""
    found = _broken(spark, d, max_bits=4096, broadcast_rows=10, hot_references=50)
    return found.select("table_name", "ref_field", "row_key", "ref_state", "ref_month")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return _broken(spark, d).groupBy("table_name", "ref_field", "ref_state", "ref_month").agg(F.count(F.lit(1)).alias("n_refs"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_events, p1_hot_events, p2_found, p2_heavy, p2_edge_weights, p2_cast_years, p2_edge_weights_refined, p2_cast_years_refined, p3_found, p3_periods, p4_found, p4_found_split, p4_report)
}

_P1 = """
WITH v AS (
  SELECT row_id, any_value(dst_id) AS pid, any_value(valid_from) AS vf, any_value(valid_to) AS vt,
         coalesce(any_value(_scd2_retired), false) AS retired, min(recorded_at) AS known
  FROM edges WHERE lower(trim(edge_type)) = 'employment' GROUP BY row_id
), e AS (
  SELECT cache_id, any_value(year) AS year, any_value(pid) AS pid, min(built_at) AS built FROM cast_year_cache GROUP BY cache_id
), best AS (
  SELECT e.cache_id, v.row_id, v.known,
         row_number() OVER (PARTITION BY e.cache_id ORDER BY v.vf DESC, v.known DESC, v.row_id DESC) AS rn
  FROM e JOIN v ON v.pid = e.pid AND v.vf <= e.year AND (v.vt IS NULL OR v.vt >= v.vf)
   AND (v.vt IS NULL OR e.year < v.vt OR (e.year = v.vt AND NOT v.retired)) AND v.known <= e.built
)
"""
_EDGE_HIST = """
WITH r AS (SELECT row_id, src_id AS k, min(CASE WHEN isfinite(weight) THEN weight::DOUBLE END) AS v FROM edges GROUP BY 1, 2)
"""
_CAST_HIST = """
WITH r AS (SELECT DISTINCT title_id, person AS k, year::DOUBLE AS v
           FROM (SELECT title_id, year, unnest(cast_ids) AS person FROM cast_ensemble) WHERE person > 0)
"""
_QUANTILES = """
SELECT k AS {key}, count(*) AS n_records, count(v) AS n_values,
       min(CASE WHEN rn * 100 >= 50 * nv THEN v END) AS q0_5, min(CASE WHEN rn * 100 >= 95 * nv THEN v END) AS q0_95
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v NULLS LAST) AS rn, count(v) OVER (PARTITION BY k) AS nv FROM r)
GROUP BY k
"""
_P3 = """
WITH v AS (
  SELECT DISTINCT row_id, t AS edge_type,
         CASE WHEN undirected THEN least(src_id, dst_id) ELSE src_id END AS src_id,
         CASE WHEN undirected THEN greatest(src_id, dst_id) ELSE dst_id END AS dst_id, f, l
  FROM (SELECT *, lower(trim(edge_type)) AS t, lower(trim(edge_type)) IN ('friendship', 'rivalry', 'collaboration',
          'chemistry', 'clique', 'former_collaborator', 'co_production', 'market_rival', 'subsidiary') AS undirected,
          valid_from AS f, CASE WHEN valid_to IS NULL THEN 9999 WHEN _scd2_retired THEN valid_to - 1 ELSE valid_to END AS l
        FROM edges) WHERE f <= l
), m AS (
  SELECT *, max(l) OVER (PARTITION BY src_id, dst_id, edge_type ORDER BY f, l, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v
), g AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR f > reach + 1 THEN 1 ELSE 0 END)
            OVER (PARTITION BY src_id, dst_id, edge_type ORDER BY f, l, row_id ROWS UNBOUNDED PRECEDING) AS island FROM m
), p AS (
  SELECT src_id, dst_id, edge_type, island, min(f) AS year_from, max(l) AS year_to, count(*) AS n FROM g GROUP BY ALL
), s AS (
  SELECT src_id, dst_id, edge_type, 'merged' AS span_kind, year_from, year_to, n AS n_versions FROM p
  UNION ALL
  SELECT * FROM (
    SELECT src_id, dst_id, edge_type, 'gap' AS span_kind,
           lag(year_to) OVER (PARTITION BY src_id, dst_id, edge_type ORDER BY island) + 1 AS year_from, year_from - 1 AS year_to,
           CAST(NULL AS BIGINT) AS n_versions FROM p) WHERE year_from IS NOT NULL
)
"""
_P4 = """
WITH par AS (
  SELECT 'person' AS kind, person_id AS id, min(recorded_at) AS rec, min(deleted_at) AS del FROM person GROUP BY 2
  UNION ALL
  SELECT 'company', company_id, min(recorded_at), min(deleted_at) FROM company GROUP BY 2
), e AS (
  SELECT row_id, src_id, dst_id, lower(trim(edge_type)) AS t, min(recorded_at) AS seen FROM edges GROUP BY 1, 2, 3, 4
), refs AS (
  SELECT 'edges' AS table_name, 'src_id' AS ref_field, row_id AS row_key, src_id AS id, seen,
         CASE WHEN t IN ('brand_fit', 'employment', 'blacklist', 'exclusive_deal', 'co_production', 'market_rival', 'subsidiary')
              THEN 'company' ELSE 'person' END AS kind FROM e
  UNION ALL
  SELECT 'edges', 'dst_id', row_id, dst_id, seen,
         CASE WHEN t IN ('co_production', 'market_rival', 'subsidiary') THEN 'company' ELSE 'person' END FROM e
  UNION ALL
  SELECT 'movie_context', 'director_id', mid, director_id, min(recorded_at), 'person' FROM movie_context WHERE director_id > 0 GROUP BY 3, 4
), bad AS (
  SELECT table_name, ref_field, row_key, unnest(list_filter([
           CASE WHEN par.id IS NULL THEN 'missing' END, CASE WHEN rec > seen THEN 'late' END, CASE WHEN del <= seen THEN 'deleted' END
         ], lambda x: x IS NOT NULL)) AS ref_state, strftime(seen, '%Y-%m') AS ref_month
  FROM refs LEFT JOIN par USING (kind, id) WHERE refs.id IS NOT NULL
)
"""
_HEAVY = """
SELECT 'edges' AS table_name, src_id AS key_id FROM edges WHERE src_id IS NOT NULL GROUP BY src_id
HAVING count(DISTINCT row_id) * 50 >= (SELECT count(DISTINCT row_id) FROM edges)
UNION ALL
SELECT 'cast_ensemble', person FROM (SELECT title_id, unnest(cast_ids) AS person FROM cast_ensemble) WHERE person > 0 GROUP BY person
HAVING count(DISTINCT title_id) * 50 >= (SELECT count(DISTINCT title_id) FROM cast_ensemble)
"""
ORACLE = {
    "p1_found": _P1 + "SELECT cache_id, row_id FROM best WHERE rn = 1",
    "p1_events": _P1 + "SELECT e.cache_id, b.row_id, b.known AS known_at FROM e LEFT JOIN best b ON b.cache_id = e.cache_id AND b.rn = 1",
    "p1_hot_events": _P1 + "SELECT e.cache_id, b.row_id, b.known AS known_at FROM e LEFT JOIN best b ON b.cache_id = e.cache_id AND b.rn = 1",
    "p2_found": _HEAVY,
    "p2_edge_weights": _EDGE_HIST + _QUANTILES.format(key="src_id"),
    "p2_cast_years": _CAST_HIST + _QUANTILES.format(key="person_id"),
    "p2_edge_weights_refined": _EDGE_HIST + _QUANTILES.format(key="src_id"),
    "p2_cast_years_refined": _CAST_HIST + _QUANTILES.format(key="person_id"),
    "p2_heavy": _EDGE_HIST + f", e AS ({_QUANTILES.format(key='key_id')}), s AS (" + _CAST_HIST.strip().removeprefix("WITH r AS (").removesuffix(")") + f"), c AS ({_QUANTILES.format(key='key_id').replace('FROM r)', 'FROM s)')})"
    """ SELECT 'edges' AS table_name, * FROM e WHERE key_id IS NOT NULL AND n_records * 50 >= (SELECT count(DISTINCT row_id) FROM edges)
    UNION ALL SELECT 'cast_ensemble', * FROM c WHERE n_records * 50 >= (SELECT count(DISTINCT title_id) FROM cast_ensemble)""",
    "p3_found": _P3 + "SELECT src_id, dst_id, edge_type, span_kind, year_from, year_to FROM s WHERE span_kind = 'gap' OR n_versions >= 2",
    "p3_periods": _P3 + "SELECT * FROM s",
    "p4_found": _P4 + "SELECT * FROM bad",
    "p4_found_split": _P4 + "SELECT * FROM bad",
    "p4_report": _P4 + "SELECT table_name, ref_field, ref_state, ref_month, count(*) AS n_refs FROM bad GROUP BY ALL",
}
