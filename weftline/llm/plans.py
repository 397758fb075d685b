"""The queries p5 to p9 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import cooccurrence, leakage, packing, percentiles, sentences
from weftline.session import clean_label, table


def _box_office(spark: SparkSession, d: str) -> DataFrame:
    movies = table(spark, d, "movie_context")
    once = movies.select("mid", clean_label(F.col("concept.genre")).alias("g"), F.col("fin.box_office_usd").alias("v")).distinct()
    return percentiles.frequency_table(once, F.col("g"), F.col("v"))


def _popularity(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "cast_year_cache").select("cache_id", "year", "pop_weight").distinct()
    return percentiles.frequency_table(once, F.col("year").cast("string"), F.col("pop_weight"))


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """Both tables' groups in one frequency table, so that one sort serves both."""
    tag = lambda name, f: f.withColumn("grp", F.concat(F.lit(name + "/"), "grp"))
    return percentiles.merge_frequencies(tag("movie_context", _box_office(spark, d)), tag("cast_year_cache", _popularity(spark, d)))


def _untag(df: DataFrame, *columns: str) -> DataFrame:
    name, key = F.expr("substring(grp, 1, instr(grp, '/') - 1)"), F.expr("substring(grp, instr(grp, '/') + 1)")
    return df.select(name.alias("table_name"), key.alias("group_key"), *columns)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _untag(percentiles.wide_groups(percentiles.percentiles(_tagged(spark, d))))


_SHARES = ("0.05", "0.25", "0.5", "0.75", "0.95", "0.99")
#: The numbers in movie_context.fin.
_FIN = (
    "budget_usd", "box_office_usd", "rating", "runtime_minutes", "num_votes", "award_campaign_strength", "market_factor",
    "performance_ratio", "market_regime_score", "company_momentum", "director_momentum", "genre_heat", "slate_pressure",
)


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Of ``p5_found``'s two columns above 0, as in its SQL; :func:`p5_fields` has all numbers."""
    return _untag(percentiles.percentiles(_tagged(spark, d), _SHARES), "n_values", *map(percentiles.percent_name, _SHARES))


def p5_fields(spark: SparkSession, d: str) -> DataFrame:
    """All finite values of every number of a film by genre, and of the cast's weight by year."""
    label = lambda *parts: F.concat_ws("/", *parts)
    genre = clean_label(F.col("concept.genre")).alias("g")
    once = table(spark, d, "movie_context").select("mid", genre, *[F.col(f"fin.{f}").cast("double").alias(f) for f in _FIN]).distinct()
    films = once.filter("g IS NOT NULL").unpivot(["g"], list(_FIN), "field", "v")
    people = table(spark, d, "cast_year_cache").filter("year IS NOT NULL").select("cache_id", "year", "pop_weight").distinct()
    freq = percentiles.merge_frequencies(
        percentiles.frequency_table(films, label(F.lit("movie_context"), "field", "g"), F.col("v"), above_zero=False),
        percentiles.frequency_table(people, label(F.lit("cast_year_cache/pop_weight"), F.col("year").cast("string")), F.col("pop_weight"), above_zero=False),
    )
    parts = F.split("grp", "/", 3)
    got = percentiles.percentiles(freq, _SHARES)
    return got.select(parts[0].alias("table_name"), parts[1].alias("field"), parts[2].alias("group_key"), "n_values", *map(percentiles.percent_name, _SHARES))


def _pairs(spark: SparkSession, d: str, min_count: int) -> tuple[DataFrame, int]:
    counted = cooccurrence.pair_counts(table(spark, d, "cast_ensemble"), F.col("title_id"), F.col("cast_ids"), min_count)
    return cooccurrence.with_significance(counted), counted.records


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    # fewer than 5 common records are never a strong pair, so those stay in their task
    return cooccurrence.strong_pairs(*_pairs(spark, d, 5)).select(F.col("a").alias("person_a"), F.col("b").alias("person_b"))


def _measures(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("person_a"), F.col("b").alias("person_b"), "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr"))


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that shares a film, with both measures."""
    return _measures(_pairs(spark, d, 1)[0])


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "containers").select(F.col("container_kind").alias("kind"), F.col("capacity_tokens").alias("capacity"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = packing.token_sizes(table(spark, d, "documents"), "doc_id", "text")
    placed = packing.fill_containers(sizes, _kinds(spark, d))
    return placed.withColumnsRenamed({"kind": "container_kind", "container": "container_id", "key": "doc_id"})


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    sizes = packing.token_sizes(table(spark, d, "documents"), "doc_id", "text")
    kinds = _kinds(spark, d)
    fill = packing.container_fill(packing.fill_containers(sizes, kinds), kinds)
    return fill.withColumnsRenamed({"kind": "container_kind", "container": "container_id"})


def p7_validity(spark: SparkSession, d: str) -> DataFrame:
    """Documents placed and faults of each kind: containers too full, documents not whole, and those cut without need."""
    sizes = packing.token_sizes(table(spark, d, "documents"), "doc_id", "text")
    return packing.validity(packing.fill_containers(sizes, _kinds(spark, d)), sizes, _kinds(spark, d)).withColumnRenamed("kind", "container_kind")


def _leak_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return docs, table(spark, d, "eval_items").select(F.col("item_id").alias("item"), "lang", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(*_leak_inputs(spark, d)).withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def p8_templates(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_templates(*_leak_inputs(spark, d)).withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return sentences.sentences(docs).withColumnRenamed("doc", "doc_id")


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return sentences.sentence_texts(docs).withColumnRenamed("doc", "doc_id")


def p9_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per document the filled characters in its sentences, and sentences that begin before the last one ends."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return sentences.coverage(docs).withColumnRenamed("doc", "doc_id")


QUERIES = {f.__name__: f for f in (p5_found, p5_percentiles, p5_fields, p6_found, p6_pairs, p7_containers, p7_fill, p7_validity, p8_found, p8_templates, p9_found, p9_sentences, p9_coverage)}

_P5 = """
WITH v AS (
  SELECT 'movie_context' AS table_name, g AS group_key, v FROM (
    SELECT DISTINCT mid, lower(trim(concept.genre)) AS g, fin.box_office_usd AS v FROM movie_context)
  UNION ALL
  SELECT 'cast_year_cache', CAST(year AS VARCHAR), pop_weight FROM (SELECT DISTINCT cache_id, year, pop_weight FROM cast_year_cache)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY table_name, group_key ORDER BY v) AS rn, count(*) OVER (PARTITION BY table_name, group_key) AS n
  FROM v WHERE v > 0 AND isfinite(v) AND group_key IS NOT NULL
), p AS (
  SELECT table_name, group_key, any_value(n) AS n_values,
         min(CASE WHEN rn * 100 >= 5 * n THEN v END) AS p5, min(CASE WHEN rn * 100 >= 25 * n THEN v END) AS p25,
         min(CASE WHEN rn * 100 >= 50 * n THEN v END) AS p50, min(CASE WHEN rn * 100 >= 75 * n THEN v END) AS p75,
         min(CASE WHEN rn * 100 >= 95 * n THEN v END) AS p95, min(CASE WHEN rn * 100 >= 99 * n THEN v END) AS p99
  FROM r GROUP BY ALL
)
"""
_P5_FIELDS = (
    "WITH m AS (SELECT DISTINCT mid, lower(trim(concept.genre)) AS g, fin FROM movie_context), v AS (\n"
    + "".join(f"  SELECT 'movie_context' AS table_name, '{f}' AS field, g AS group_key, fin.{f}::DOUBLE AS v FROM m UNION ALL\n" for f in _FIN)
    + """  SELECT 'cast_year_cache', 'pop_weight', CAST(year AS VARCHAR), pop_weight FROM (SELECT DISTINCT cache_id, year, pop_weight FROM cast_year_cache)
), r AS (
  SELECT * REPLACE (CASE WHEN v = 0 THEN 0 ELSE v END AS v), row_number() OVER (PARTITION BY table_name, field, group_key ORDER BY v) AS rn, count(*) OVER (PARTITION BY table_name, field, group_key) AS n
  FROM v WHERE isfinite(v) AND group_key IS NOT NULL
)
SELECT table_name, field, group_key, any_value(n) AS n_values,
       min(CASE WHEN rn * 100 >= 5 * n THEN v END) AS p5, min(CASE WHEN rn * 100 >= 25 * n THEN v END) AS p25,
       min(CASE WHEN rn * 100 >= 50 * n THEN v END) AS p50, min(CASE WHEN rn * 100 >= 75 * n THEN v END) AS p75,
       min(CASE WHEN rn * 100 >= 95 * n THEN v END) AS p95, min(CASE WHEN rn * 100 >= 99 * n THEN v END) AS p99
FROM r GROUP BY ALL
"""
)
_P6 = """
WITH r AS (
  SELECT DISTINCT title_id, person FROM (SELECT title_id, unnest(cast_ids) AS person FROM cast_ensemble) WHERE person > 0
), n AS (SELECT count(DISTINCT title_id) AS n FROM r), s AS (SELECT person, count(*) AS n FROM r GROUP BY person),
x AS (
  SELECT a.person AS person_a, b.person AS person_b, count(*) AS n_ab
  FROM r a JOIN r b ON a.title_id = b.title_id AND a.person < b.person GROUP BY ALL HAVING count(*) >= 5
), k AS (
  SELECT x.*, sa.n AS n_a, sb.n AS n_b, n.n AS n FROM x JOIN s sa ON sa.person = person_a JOIN s sb ON sb.person = person_b CROSS JOIN n
)
"""
_TERM = "CASE WHEN {k} > 0 THEN ({k}) * ln(({k}) * n::DOUBLE / (({r})::DOUBLE * ({c}))) ELSE 0 END"
_LLR = "2 * (" + " + ".join(
    _TERM.format(k=k, r=r, c=c)
    for k, r, c in (
        ("n_ab", "n_a", "n_b"), ("n_a - n_ab", "n_a", "n - n_b"),
        ("n_b - n_ab", "n - n_a", "n_b"), ("n - n_a - n_b + n_ab", "n - n_a", "n - n_b"),
    )
) + ")"
#: Full-width signs to plain ones, and what else of the tables DuckDB doesn't decompose.
_WIDE, _PLAIN = "".join(map(chr, range(0xFF10, 0xFF5B))) + "ำ", "".join(map(chr, range(0x30, 0x7B))).replace("'", " ") + "า"
_P8 = f"""
WITH letters AS (
  SELECT 'd' AS side, doc_id AS id, 0 AS k, text FROM documents UNION ALL
  SELECT 'i', item_id, CASE WHEN lang IN ('zh', 'ja') THEN 24 ELSE 60 END, text FROM eval_items
), s AS (
  SELECT side, id, k, regexp_replace(strip_accents(lower(translate(replace(replace(text, '№', 'no'), 'ß', 'ss'), '{_WIDE}', '{_PLAIN}'))), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS s FROM letters WHERE text IS NOT NULL
), w AS (
  SELECT DISTINCT id AS item_id, substr(s, p, k) AS x FROM s, unnest(range(1, length(s) - k + 2)) AS r(p) WHERE side = 'i'
), v AS (
  SELECT id AS doc_id, substr(s, p, n) AS x FROM s, (VALUES (24), (60)) AS l(n), unnest(range(1, length(s) - n + 2)) AS r(p) WHERE side = 'd'
)
"""
_BLANKS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
ORACLE = {
    "p5_found": _P5 + "SELECT table_name, group_key FROM p WHERE p95 >= 40 * p50",
    "p5_percentiles": _P5 + "SELECT * FROM p",
    "p5_fields": _P5_FIELDS,
    "p7_validity": f"SELECT container_kind, capacity_tokens AS capacity, (SELECT count(*) FROM documents WHERE regexp_matches(text, '[^{_BLANKS}]')) AS n_docs, 0 AS n_too_full, 0 AS n_not_whole, 0 AS n_cut FROM containers",
    "p9_coverage": f"SELECT doc_id, length(regexp_replace(text, '[{_BLANKS}]', '', 'g')) AS n_filled, 0 AS n_overlaps FROM documents WHERE regexp_matches(text, '[^{_BLANKS}]')",
    "p8_found": _P8 + "SELECT DISTINCT doc_id, item_id FROM v JOIN w USING (x)",
    "p6_found": _P6 + "SELECT person_a, person_b FROM k WHERE n_ab * n >= 8 * n_a * n_b",
    "p6_pairs": _P6.replace(" HAVING count(*) >= 5", "") + f"SELECT person_a, person_b, n_ab, n_a, n_b, round(n_ab * n / (n_a::DOUBLE * n_b), 6) AS lift, round({_LLR}, 4) AS llr FROM k",
}
