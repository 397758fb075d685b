"""Queries that make rows from rows, and exposure in the years, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import producers, reshape
from weftline.plans.export import _FILMS, _U, films
from weftline.plans.relational import _CASTS, casts

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _u(*what: str) -> str:
    return _U.format(k=" || '|' || ".join(["'42'", "mid", *what]))


_GROSS = "SELECT mid, min(fin.box_office_usd) AS v FROM movie_context GROUP BY 1"


@query(f"""WITH n AS (SELECT mid, round(v)::BIGINT AS w, (4 + floor({_u("'weeks'")} * 9))::INT AS n FROM ({_GROSS}) WHERE v > 0 AND isfinite(v)),
p AS (SELECT *, list_transform(range(0, n), lambda k: pow(0.6, k)) AS p FROM n), l AS (SELECT mid, w, list_transform(p, lambda x, i: CASE WHEN i = 1 THEN 0 ELSE floor(w * x / list_reduce(p, lambda a, b: a + b))::BIGINT END) AS l FROM p)
SELECT mid, k AS week, CASE WHEN k = 1 THEN w - list_sum(l)::BIGINT ELSE l[k] END AS amount FROM l, unnest(range(1, len(l) + 1)) AS r(k)""")
def weekly_gross(spark, d):
    from weftline.session import table

    gross = table(spark, d, "movie_context").groupBy("mid").agg(F.min("fin.box_office_usd").alias("v"))
    return producers.weekly(gross, "mid", "v")


_AGES, _SEXES = ["under 18", "18-29", "30-44", "45+"], ["f", "m"]
_CELLS = [f"{a}/{s}" for a in _AGES for s in _SEXES]


@query(f"""WITH f AS (SELECT mid, votes AS w, [{", ".join(f"(0.1 + {_u(repr(c))})::DOUBLE" for c in _CELLS)}] AS p FROM ({_FILMS}) WHERE votes >= 0),
l AS (SELECT mid, w, list_transform(p, lambda x, i: CASE WHEN i = 1 THEN 0 ELSE floor(w * x / list_reduce(p, lambda a, b: a + b))::BIGINT END) AS l FROM f)
SELECT mid, split_part(([{", ".join(map(repr, _CELLS))}])[k], '/', 1) AS age, split_part(([{", ".join(map(repr, _CELLS))}])[k], '/', 2) AS sex, CASE WHEN k = 1 THEN w - list_sum(l)::BIGINT ELSE l[k] END AS n FROM l, unnest(range(1, 9)) AS r(k)""")
def ratings_breakdown(spark, d):
    return producers.crossed(films(spark, d), "mid", "votes", {"age": _AGES, "sex": _SEXES})


@query(f"""WITH f AS (SELECT mid, released::DATE AS e, (90 + floor({_u("'development'")} * 271))::INT AS a, (30 + floor({_u("'shooting'")} * 91))::INT AS b, (60 + floor({_u("'editing'")} * 121))::INT AS c FROM ({_FILMS}) WHERE released IS NOT NULL)
SELECT mid, phase, strftime(starts_on, '%Y-%m-%d') AS starts_on, strftime(ends_on, '%Y-%m-%d') AS ends_on FROM (
SELECT mid, 'development' AS phase, e - (a + b + c) AS starts_on, e - (b + c) AS ends_on FROM f UNION ALL SELECT mid, 'shooting', e - (b + c), e - c FROM f UNION ALL SELECT mid, 'editing', e - c, e FROM f)""")
def production_timeline(spark, d):
    got = producers.phases(films(spark, d), "mid", "released", {"development": (90, 360), "shooting": (30, 120), "editing": (60, 180)})
    return got.withColumns({c: F.col(c).cast("string") for c in ("starts_on", "ends_on")})


@query(f"""WITH s AS (SELECT mid, unnest(range(1, 2 + floor({_u("'seasons'")} * 4)::INT)) AS season FROM (SELECT DISTINCT mid FROM movie_context))
SELECT mid, season, unnest(range(1, 2 + floor({_u("season")} * 8)::INT)) AS episode FROM s""")
def series_episodes(spark, d):
    return producers.series(films(spark, d), "mid")


@query(f"""WITH n AS (SELECT mid, row_number() OVER (ORDER BY year NULLS FIRST, mid) AS n FROM ({_FILMS})),
l AS (SELECT mid, floor((n - 1) * sqrt({_u("'which'")}))::BIGINT + 1 AS m FROM n WHERE n > 1 AND {_u("'linked'")} < 0.3) SELECT l.mid, n.mid AS earlier FROM l JOIN n ON n.n = l.m""")
def movie_links(spark, d):
    """Links from films to earlier ones."""
    return producers.links_back(films(spark, d), "mid", ["year", "mid"])


@query(f"""WITH f AS (SELECT mid, unnest(range(1, 2 + ln(1 + coalesce(votes, 0))::INT)) AS i FROM ({_FILMS}))
SELECT DISTINCT mid, floor(pow({_u("i", "'user'")}, 3) * 5000)::BIGINT + 1 AS user_id, floor({_u("i", "'stars'")} * 10)::INT + 1 AS stars FROM f""")
def user_ratings(spark, d):
    f = films(spark, d).select("mid", (1 + F.round(F.log1p(F.coalesce("votes", F.lit(0))))).alias("n"))
    return producers.ratings(f, "mid", "n", 5000)


@query(f"""WITH k AS (SELECT title_id, any_value(year) AS year, list_sort(list_distinct(list(person)))[1:5] AS h FROM ({_CASTS}) GROUP BY 1),
u AS (SELECT title_id, year, unnest(h) AS p FROM k) SELECT u.year, f.director AS a, u.p AS b, count(*) AS n FROM u JOIN ({_FILMS}) f ON f.mid = u.title_id WHERE f.director > 0 AND f.director <> u.p GROUP BY ALL""")
def director_exposure(spark, d):
    """Directors and the first five of each cast, by year."""
    people = casts(spark, d).groupBy(F.col("title_id").alias("mid")).agg(F.first("year").alias("year"), F.array_sort(F.collect_set("person")).alias("people"))
    return reshape.exposure(people, films(spark, d).filter("director > 0").select("mid", F.col("director").alias("other")), "mid", 5)
