"""Queries for reshaping, audits, streaming and plan analysis, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators import audit, qerror, reshape
from weftline.operators.overlaps import common_members
from weftline.plans.relational import _CASTS, casts
from weftline.session import clean_label, table
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


@query("""WITH m AS (SELECT DISTINCT mid, fin, concept FROM movie_context), a AS (
 SELECT mid, 1 AS info_type_id, CAST(fin.runtime_minutes AS VARCHAR) AS info FROM m UNION ALL SELECT mid, 3, trim(concept.genre) FROM m UNION ALL
 SELECT mid, 5, trim(fin.certification) FROM m UNION ALL SELECT mid, 8, trim(concept.country) FROM m)
SELECT mid, info_type_id, info FROM a WHERE info IS NOT NULL AND info <> '' AND lower(info) <> 'nan'""")
def movie_attributes(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "movie_context").select("mid", "fin", "concept").distinct()
    return reshape.to_attributes(m, "mid", {1: F.col("fin.runtime_minutes"), 3: F.col("concept.genre"), 5: F.col("fin.certification"), 8: F.col("concept.country")})


@query(f"""WITH c AS (SELECT title_id, string_agg(CAST(person AS VARCHAR), '; ' ORDER BY person) AS people FROM ({_CASTS}) GROUP BY 1),
m AS (SELECT DISTINCT mid, title, lower(trim(concept.genre)) AS genre FROM movie_context) SELECT mid, title, genre, coalesce(people, '') AS people FROM m LEFT JOIN c ON c.title_id = m.mid""")
def flat_table(spark, d):
    m = table(spark, d, "movie_context").select("mid", "title", clean_label(F.col("concept.genre")).alias("genre")).distinct()
    people = reshape.joined_text(casts(spark, d).withColumn("t", F.col("person").cast("string")), "title_id", "t", ["person"], "people")
    return reshape.flat(m, "mid", [people.withColumnRenamed("title_id", "mid")])


_BILLED = """SELECT title_id AS film, year, person, row_number() OVER (PARTITION BY title_id ORDER BY person) AS nth FROM (%s)""" % _CASTS


@query(f"""WITH b AS (SELECT * FROM ({_BILLED}) WHERE nth <= 20) SELECT x.person AS a, y.person AS b, count(*) AS n, min(x.year) AS first_year, max(x.year) AS last_year
FROM b x JOIN b y ON x.film = y.film AND x.person < y.person GROUP BY ALL HAVING count(*) >= 2""")
def collaborations(spark, d):
    credits = casts(spark, d).select(F.col("title_id").alias("film"), "person", F.col("person").alias("nth"), "year")
    return reshape.collaborations(credits)


@query(f"""WITH c AS ({_CASTS}) SELECT x.title_id AS source, y.title_id AS target, count(*) AS n_shared FROM c x JOIN c y ON x.person = y.person AND x.title_id <> y.title_id
WHERE x.year < 1975 AND y.year >= 2020 GROUP BY ALL HAVING count(*) >= 2""")
def shared_links(spark, d):
    """Films before 1975 and from 2020 on with people in common, as in its SQL; :func:`film_links` takes all films."""
    c = casts(spark, d).select(F.col("title_id").alias("id"), F.col("person").alias("member"), "year")
    return reshape.shared_links(c.filter("year < 1975"), c.filter("year >= 2020"))


@query(f"""WITH c AS (SELECT DISTINCT title_id, person FROM ({_CASTS})) SELECT x.title_id AS source, y.title_id AS target, count(*) AS n_shared
FROM c x JOIN c y ON x.person = y.person AND x.title_id < y.title_id GROUP BY ALL HAVING count(*) >= 2""")
def film_links(spark, d):
    """All films with people in common, each pair once."""
    c = casts(spark, d).select(F.col("title_id").alias("id"), F.col("person").alias("member"))
    return common_members(c, least=2).toDF("source", "target", "n_shared")


@query(f"""WITH k AS (SELECT title_id, any_value(year) AS year, list_sort(list_distinct(list(person)))[1:8] AS h FROM ({_CASTS}) GROUP BY 1),
u AS (SELECT title_id, year, unnest(h) AS p FROM k) SELECT x.year, x.p AS a, y.p AS b, count(*) AS n FROM u x JOIN u y ON x.title_id = y.title_id AND x.p < y.p GROUP BY ALL""")
def yearly_context(spark, d):
    people = casts(spark, d).groupBy("title_id").agg(F.first("year").alias("year"), F.array_sort(F.collect_set("person")).alias("people"))
    return reshape.yearly_context(people)


@query(f"""WITH y AS (SELECT person AS id, min(year) AS f, max(year) AS l FROM ({_CASTS}) GROUP BY 1), p AS (SELECT person_id AS id, min(debut_year) AS born FROM person GROUP BY 1)
SELECT p.id, CASE WHEN f IS NULL THEN born ELSE greatest(l - 90, least(born, f - 5)) END AS born FROM p LEFT JOIN y ON y.id = p.id""")
def clamp_birth_years(spark, d):
    people = table(spark, d, "person").groupBy(F.col("person_id").alias("id")).agg(F.min("debut_year").alias("born"))
    return reshape.clamped_years(people, casts(spark, d).select(F.col("person").alias("id"), "year"), "born").select("id", "born")


@query("""SELECT 'bounds' AS category, 'reversed' AS name, CASE WHEN avg((coalesce(valid_from > valid_to, false))::INT) <= 0.001 THEN 'PASS' WHEN avg((coalesce(valid_from > valid_to, false))::INT) <= 0.05 THEN 'WARN' ELSE 'FAIL' END AS status,
 count_if(valid_from > valid_to) AS n_bad, round(count_if(valid_from > valid_to)::DOUBLE / count(*), 8) AS share FROM edges UNION ALL
SELECT 'ids', 'loop', CASE WHEN count_if(src_id = dst_id) = 0 THEN 'PASS' WHEN count_if(src_id = dst_id) <= 0.01 * count(*) THEN 'WARN' ELSE 'FAIL' END, count_if(src_id = dst_id), round(count_if(src_id = dst_id)::DOUBLE / count(*), 8) FROM edges UNION ALL
SELECT 'weight', 'range', CASE WHEN count_if(weight < 0 OR weight > 1) = 0 THEN 'PASS' WHEN count_if(weight < 0 OR weight > 1) <= 0.01 * count(*) THEN 'WARN' ELSE 'FAIL' END, count_if(weight < 0 OR weight > 1), round(count_if(weight < 0 OR weight > 1)::DOUBLE / count(*), 8) FROM edges""")
def audit_edges(spark, d):
    w = F.col("weight")
    checks = {
        "reversed": ("bounds", F.col("valid_from") > F.col("valid_to"), 0.001, 0.05),
        "loop": ("ids", F.col("src_id") == F.col("dst_id"), 0.0, 0.01),
        "range": ("weight", (w < 0) | (w > 1), 0.0, 0.01),
    }
    return audit.expectations(table(spark, d, "edges"), checks).withColumn("share", F.round("share", 8))


_METRIC = """SELECT 'films' AS metric, count(*)::DOUBLE AS value FROM {t} UNION ALL SELECT 'mean_size', round(avg(len(cast_ids)), 6) FROM {t}"""


@query(f"""WITH a AS ({_METRIC.format(t="(SELECT * FROM cast_ensemble WHERE year < 2000)")}), b AS ({_METRIC.format(t="(SELECT * FROM cast_ensemble WHERE year >= 2000)")})
SELECT metric, a.value AS baseline, b.value AS variant, b.value - a.value AS delta FROM a FULL JOIN b USING (metric)""")
def run_comparison(spark, d):
    """Two parts of a table compared as two runs would be."""

    def metrics(df):
        one = df.agg(F.count(F.lit(1)).cast("double").alias("films"), F.round(F.avg(F.size("cast_ids")), 6).alias("mean_size"))
        return one.unpivot([], ["films", "mean_size"], "metric", "value")

    cast = table(spark, d, "cast_ensemble").withColumn("cast_ids", F.when(F.col("cast_ids").isNotNull(), F.col("cast_ids")))
    return audit.compared(metrics(cast.filter("year < 2000")), metrics(cast.filter("year >= 2000")))


# ---- time windows; the same functions run on streams


@query("""SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_window(spark, d):
    events = flows.event_time(table(spark, d, "events"), "ts", "1 hour")
    return flows.windowed(events, ["event_type"], "1 day", None, F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).withColumn("total", F.round("total", 4))


@query("""WITH o AS (SELECT *, unnest([0, 1]) AS k FROM events), w AS (SELECT event_type, value, time_bucket(INTERVAL 12 HOUR, ts) - k * INTERVAL 12 HOUR AS s FROM o)
SELECT event_type, s AS window_start, s + INTERVAL 1 DAY AS window_end, count(*) AS n FROM w GROUP BY ALL""")
def sliding_window(spark, d):
    events = flows.event_time(table(spark, d, "events"), "ts", "1 hour")
    return flows.windowed(events, ["event_type"], "1 day", "12 hours", F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def session_window(spark, d):
    events = flows.event_time(table(spark, d, "events"), "ts", "1 hour")
    return flows.sessions(events, ["user_id"], "6 hours", F.count(F.lit(1)).alias("n"))


# ---- plan analysis


@query("""WITH r AS (SELECT p_partkey, p_size AS e, count(l_orderkey) AS a FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL),
q AS (SELECT greatest(greatest(e, 0.5) / greatest(a, 0.5), greatest(a, 0.5) / greatest(e, 0.5))::DOUBLE AS q FROM r WHERE e > 0 AND a > 0)
SELECT CASE WHEN q >= 100 THEN 'MASSIVE' WHEN q >= 50 THEN 'STRONG' WHEN q >= 5 THEN 'REAL' ELSE 'mild' END AS verdict, count(*) AS n, round(max(q), 6) AS most FROM q GROUP BY 1""")
def qerror_bands(spark, d):
    """Errors of a simple estimate (the size of a part) of the lines of a part, in bands."""
    lines = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("a"))
    part = table(spark, d, "part").filter("p_size > 0")
    q = part.join(lines, F.col("p_partkey") == F.col("l_partkey")).select(qerror.q_error(F.col("p_size"), F.col("a")).alias("q"))
    return q.groupBy(qerror.verdict(F.col("q")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("q"), 6).alias("most"))


@query("""SELECT upper(substr(md5(o_orderkey::VARCHAR), 1, 6)) AS code, count(*) AS n FROM orders GROUP BY 1""")
def stable_codes(spark, d):
    return table(spark, d, "orders").groupBy(F.upper(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 6)).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT person_id, CASE WHEN lower(trim(gender)) IN ('f', 'female', 'woman') THEN 2 ELSE 1 END AS role_id, count(*) AS n FROM person GROUP BY ALL""")
def gender_roles(spark, d):
    return table(spark, d, "person").groupBy("person_id", S.role_of_gender(F.col("gender")).alias("role_id")).agg(F.count(F.lit(1)).alias("n"))
