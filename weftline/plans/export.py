"""Queries for exported tables, ranks by risk, and readings of the graph, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators import export, graph, reshape
from weftline.operators.references import COMPANY_TO_COMPANY
from weftline.plans.relational import _CASTS, _VERSIONS, casts, versions
from weftline.session import clean_label, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_FILMS = "SELECT mid, min(concept.year) AS year, min(title) AS title, min(trim(concept.country)) AS country, min(concept.production_tier) AS tier, min(lower(trim(concept.genre))) AS genre, min(fin.rating) AS rating, min(fin.num_votes) AS votes, min(fin.budget_usd) AS budget, min(fin.performance_ratio) AS ratio, min(director_id) AS director, min(base_release_date) AS released FROM movie_context GROUP BY mid"
_PEOPLE = "SELECT person_id AS id, min(name) AS name, min(gender) AS gender, min(nationality) AS nationality, min(style_tags) AS tags, min(career_stage) AS stage, min(debut_year) AS debut, max(pop_weight) AS pop FROM person GROUP BY 1"


def films(spark: SparkSession, d: str) -> DataFrame:
    """Each film once, the least of every attribute."""
    m = table(spark, d, "movie_context")
    of = {
        "year": "concept.year", "title": "title", "country": "trim(concept.country)", "tier": "concept.production_tier", "genre": "lower(trim(concept.genre))", "rating": "fin.rating",
        "votes": "fin.num_votes", "budget": "fin.budget_usd", "ratio": "fin.performance_ratio", "director": "director_id", "released": "base_release_date",
    }
    return m.groupBy("mid").agg(*[F.min(F.expr(e)).alias(n) for n, e in of.items()])


def people(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "person")
    of = {"name": "name", "gender": "gender", "nationality": "nationality", "tags": "style_tags", "stage": "career_stage", "debut": "debut_year"}
    return p.groupBy(F.col("person_id").alias("id")).agg(*[F.min(c).alias(n) for n, c in of.items()], F.max("pop_weight").alias("pop"))


# ---- exported tables


@query(f"""WITH p AS ({_PEOPLE}), a AS (SELECT title_id AS movie_id, person AS person_id, row_number() OVER (PARTITION BY title_id ORDER BY person) AS nr_order FROM (SELECT DISTINCT title_id, person FROM ({_CASTS}))),
u AS (SELECT 1 AS part, movie_id, person_id, CASE WHEN lower(trim(p.gender)) IN ('f', 'female', 'woman') THEN 2 ELSE 1 END AS role_id, nr_order FROM a LEFT JOIN p ON p.id = person_id
UNION ALL SELECT 2, mid, director, 8, 1 FROM ({_FILMS}) WHERE director > 0)
SELECT movie_id, person_id, role_id, nr_order, NULL::VARCHAR AS note, row_number() OVER (ORDER BY part, movie_id, nr_order, person_id) AS id FROM u""")
def cast_info(spark, d):
    """Credits of actors and directors under one numbering."""
    from weftline.operators.sequences import numbered

    acted = numbered(casts(spark, d).select(F.col("title_id").alias("movie_id"), F.col("person").alias("person_id")).distinct(), ["movie_id"], ["person_id"])
    actors = acted.withColumn("nr_order", F.col("nth") + 1).join(people(spark, d).select(F.col("id").alias("person_id"), "gender"), "person_id", "left")
    directors = films(spark, d).filter("director > 0").select(F.col("mid").alias("movie_id"), F.col("director").alias("person_id"))
    return export.credits(actors, directors)


@query(f"""SELECT mid, 16 AS info_type_id, coalesce(country, 'USA') || ':' || strftime(released::DATE, '%-d %B %Y') AS info,
CASE WHEN u < 0.05 THEN '(internet)' WHEN u < 0.10 THEN '(limited)' WHEN u < 0.14 THEN '(premiere)' END AS note
FROM (SELECT *, ((mid * 2654435761) & 65535) / 65535.0::DOUBLE AS u FROM ({_FILMS})) WHERE released IS NOT NULL""")
def release_info(spark, d):
    return export.release_rows(films(spark, d), "mid", F.col("country"), F.col("released"), F.lit(None).cast("string"))


@query(f"""WITH f AS ({_FILMS}), e AS (SELECT * FROM f WHERE rating IS NOT NULL AND coalesce(votes, 0) >= (SELECT quantile_cont(coalesce(votes, 0), 0.1) FROM f WHERE rating IS NOT NULL))
SELECT mid AS movie_id, 101 AS info_type_id, printf('%.1f', rating) AS info FROM f WHERE rating IS NOT NULL UNION ALL SELECT mid, 100, votes::VARCHAR FROM f WHERE votes IS NOT NULL
UNION ALL SELECT * FROM (SELECT mid, 112, row_number() OVER (ORDER BY rating DESC, coalesce(votes, 0) DESC, mid)::VARCHAR AS r FROM e) WHERE r::INT <= 250
UNION ALL SELECT * FROM (SELECT mid, 113, row_number() OVER (ORDER BY rating, coalesce(votes, 0), mid)::VARCHAR AS r FROM e) WHERE r::INT <= 10""")
def rating_info(spark, d):
    """Votes, ratings, the first 250 and the last 10 as attribute rows."""
    return export.rating_rows(films(spark, d).select(F.col("mid").alias("movie_id"), "rating", "votes"))


@query(f"""WITH p AS ({_PEOPLE}), a AS (SELECT id, 201 AS info_type_id, trim(nationality) AS info FROM p UNION ALL SELECT id, 203, trim(stage) FROM p UNION ALL SELECT id, 21, CAST(debut - 20 AS VARCHAR) FROM p)
SELECT id, info_type_id, info FROM a WHERE info <> '' AND lower(info) <> 'nan'""")
def person_info(spark, d):
    return reshape.to_attributes(people(spark, d), "id", {export.NATIONALITY: F.col("nationality"), export.CAREER: F.col("stage"), export.BIRTH: F.col("debut") - 20})


_U = "CAST('0x' || substr(md5({k}), 1, 12) AS BIGINT) / pow(16, 12)"


@query(f"""WITH p AS (SELECT id, name, string_split(replace(trim(regexp_replace(name, '\\s+', ' ', 'g')), '-', ' '), ' ') AS w FROM ({_PEOPLE}) WHERE name IS NOT NULL AND trim(name) <> '' AND {_U.format(k="'42|' || person_id || '|who'").replace('person_id', 'id')} < 0.12),
f AS (SELECT id, name, unnest(CASE WHEN len(w) = 1 THEN [w[1] || ' ' || w[1]] ELSE [left(w[1], 1) || '. ' || w[-1], w[-1] || ', ' || w[1], w[1] || ' ' || left(w[-1], 1)] END) AS v FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5('42|' || id || '|' || v), v) AS k FROM f)
SELECT id AS person_id, v AS name, md5(v) AS md5sum FROM r WHERE v <> name AND k <= CASE WHEN {_U.format(k="'42|' || id || '|many'")} < 0.72 THEN 1 ELSE 2 END""")
def aka_name(spark, d):
    return export.name_variants(people(spark, d).select(F.col("id").alias("person_id"), "name"))


@query(f"""WITH f AS ({_FILMS}), c AS (SELECT title_id, count(DISTINCT person) AS n FROM ({_CASTS}) GROUP BY 1),
s AS (SELECT mid, coalesce(n, 0) AS a, (director > 0)::INT AS b, tier FROM f LEFT JOIN c ON title_id = mid),
t AS (SELECT mid, coalesce(b, 0) AS b, least(0.9, greatest(0.08, 0.12 + 0.22 * (ln(1 + a) * 0.25 + ln(1 + coalesce(b, 0)) * 0.18 + CASE tier WHEN 'Epic' THEN 0.55 WHEN 'A' THEN 0.4 WHEN 'Mid' THEN 0.25 WHEN 'Indie' THEN 0.15 WHEN 'Micro' THEN 0.05 ELSE 0.2 END)))::DOUBLE AS p FROM s)
SELECT mid AS movie_id, 1 AS subject_id, CASE WHEN {_U.format(k="'42|' || mid || '|cast'")} < p THEN 4 ELSE 3 END AS status_id FROM t
UNION ALL SELECT mid, 2, CASE WHEN {_U.format(k="'42|' || mid || '|crew'")} < least(0.85, greatest(0.05, p - 0.08)) THEN 4 ELSE 3 END FROM t WHERE b > 0 OR {_U.format(k="'42|' || mid || '|any'")} < 0.42""")
def complete_cast(spark, d):
    n = casts(spark, d).groupBy(F.col("title_id").alias("mid")).agg(F.countDistinct("person").alias("n_cast"))
    f = films(spark, d).join(n, "mid", "left").select(F.col("mid").alias("movie_id"), "tier", "n_cast", (F.col("director") > 0).cast("int").alias("n_crew"))
    return export.completeness(f)


@query(f"""WITH f AS ({_FILMS}), c AS (SELECT title_id, count(DISTINCT person) AS n FROM ({_CASTS}) GROUP BY 1),
g AS (SELECT genre, quantile_disc(CASE WHEN isfinite(ratio) THEN ratio END, 0.5) AS med FROM f WHERE genre IS NOT NULL GROUP BY 1),
s AS (SELECT mid, f.year, round(CASE WHEN coalesce(n, 0) < 4 OR n > 12 THEN 0.7 ELSE 0 END + CASE WHEN budget >= 45000000 THEN 1.0 ELSE 0 END + CASE WHEN isfinite(ratio) AND abs(ratio - med) >= 2.2 THEN 0.9 ELSE 0 END
+ CASE WHEN rating >= 7.7 THEN 0.5 ELSE 0 END + CASE WHEN coalesce(director, 0) <= 0 THEN 1.2 ELSE 0 END, 6) AS risk FROM f LEFT JOIN c ON title_id = mid LEFT JOIN g ON g.genre = f.genre)
SELECT mid, year, risk, row_number() OVER (ORDER BY risk DESC, year NULLS FIRST, mid) AS place FROM s""")
def risk_ranking(spark, d):
    """All films by the sum of what is odd about them, the riskiest first."""
    f = films(spark, d)
    finite = F.when(~F.isnan("ratio") & (F.abs("ratio") != float("inf")), F.col("ratio"))
    medians = f.filter("genre IS NOT NULL").withColumn("_r", finite)
    # nearest rank over counts per value
    from weftline.operators.skew import keyed_histogram, keyed_quantiles

    medians = keyed_quantiles(keyed_histogram(medians, F.col("genre"), F.col("_r"), F.col("mid")), ("0.5",)).select(F.col("key").alias("genre"), F.col("q0_5").alias("med"))
    n = casts(spark, d).groupBy(F.col("title_id").alias("mid")).agg(F.countDistinct("person").alias("n"))
    joined = f.join(n, "mid", "left").join(F.broadcast(medians), "genre", "left")  # one row a genre
    flags = {
        "cast": ((F.coalesce("n", F.lit(0)) < 4) | (F.col("n") > 12), 0.7),
        "budget": (F.col("budget") >= 45_000_000, 1.0),
        "ratio": (F.abs(finite - F.col("med")) >= 2.2, 0.9),
        "rating": (F.col("rating") >= 7.7, 0.5),
        "director": (F.coalesce("director", F.lit(0)) <= 0, 1.2),
    }
    return export.ranked_by_risk(joined.select("mid", "year", "n", "budget", "ratio", "med", "rating", "director"), flags, ["year", "mid"]).select("mid", "year", "risk", "place")


# ---- readings of the graph and of events

_ACTIVE_1950 = "vf <= 1950 AND (vt IS NULL OR CASE WHEN retired THEN 1950 < vt ELSE 1950 <= vt END)"


@query(f"""WITH v AS (SELECT * FROM ({_VERSIONS}) WHERE kind IS NOT NULL), a AS (SELECT *, coalesce({_ACTIVE_1950}, false) AS active FROM v), n AS (SELECT kind, bool_or(active) AS any_active FROM a GROUP BY 1)
SELECT row_id, a.kind, active FROM a JOIN n ON n.kind = a.kind WHERE active OR NOT any_active""")
def active_or_all(spark, d):
    """Versions of each kind that are active in a year, or all of a kind without any."""
    v = versions(spark, d).filter("kind IS NOT NULL")
    return graph.active_or_all(v, 1950, ["kind"], "never").select("row_id", "kind", "active")


@query("""WITH m AS (SELECT max(ts) AS last FROM events), r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events, m WHERE ts > last - INTERVAL 48 HOUR)
SELECT user_id, event_id, ts FROM r WHERE k <= 5""")
def recent_events(spark, d):
    """The last five events of each user within the last 48 hours of the table."""
    events = table(spark, d, "events")
    return graph.recent(events, "user_id", "ts", "event_id", 48, 5).select("user_id", "event_id", "ts")


@query(f"""WITH v AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ({_VERSIONS}) WHERE kind IN ('co_production', 'market_rival', 'subsidiary') AND src <> dst)
SELECT a, b FROM v WHERE {_U.format(k="'42|' || a || '|' || b")} < 0.3""")
def company_pairs(spark, d):
    """Pairs of companies with an edge, three of ten drawn by their ids."""
    v = versions(spark, d).filter(F.col("kind").isin(*COMPANY_TO_COMPANY) & (F.col("src") != F.col("dst")))
    pairs = v.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return pairs.filter(S.key_uniform(42, F.col("a"), F.col("b")) < 0.3)


_BUCKETS = {"positive": ("friendship", "collaboration", "chemistry", "mentorship", "clique"), "negative": ("rivalry", "avoid", "blacklist"), "work": ("employment", "brand_fit", "exclusive_deal")}


@query("WITH v AS (SELECT DISTINCT src, dst, CASE " + " ".join(f"WHEN kind IN {k!r} THEN '{b}'" for b, k in _BUCKETS.items()) + f""" END AS bucket FROM ({_VERSIONS})),
u AS (SELECT src AS v, dst AS w, bucket FROM v UNION SELECT dst, src, bucket FROM v) SELECT v, bucket, count(*) AS n, min(w) AS least, max(w) AS most FROM u WHERE bucket IS NOT NULL AND v IS NOT NULL AND w IS NOT NULL GROUP BY ALL""")
def affinity_buckets(spark, d):
    """Others of each vertex by the bucket of the edge's kind."""
    return graph.bucketed(versions(spark, d), _BUCKETS)


_TAGS = "list_distinct(list_filter(list_transform(string_split({p}.tags, ';'), lambda x: trim(x)), lambda x: x <> ''))"
_JACCARD = "CASE WHEN a.tags IS NULL OR b.tags IS NULL THEN NULL WHEN len(list_distinct({a} || {b})) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / len(list_distinct({a} || {b}))::DOUBLE END".format(a=_TAGS.format(p="a"), b=_TAGS.format(p="b"))


@query(f"""WITH e AS (SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM ({_VERSIONS}) WHERE kind = 'chemistry' AND src <> dst), p AS ({_PEOPLE}), c AS (SELECT DISTINCT title_id, person FROM ({_CASTS})),
n AS (SELECT person, count(*) AS n FROM c GROUP BY 1), k AS (SELECT x, y, count(*) AS n_films FROM e JOIN c s ON s.person = x JOIN c t ON t.person = y AND t.title_id = s.title_id GROUP BY ALL)
SELECT e.x, e.y, abs(a.debut - b.debut) AS debut_gap, round({_JACCARD}, 6) AS tags, coalesce(a.nationality = b.nationality, false) AS same_nation, round(abs(a.pop - b.pop), 6) AS pop_gap,
coalesce(n_films, 0) AS n_films, coalesce(na.n, 0) AS films_a, coalesce(nb.n, 0) AS films_b
FROM e JOIN p a ON a.id = e.x JOIN p b ON b.id = e.y LEFT JOIN k ON k.x = e.x AND k.y = e.y LEFT JOIN n na ON na.person = e.x LEFT JOIN n nb ON nb.person = e.y""")
def pair_metrics(spark, d):
    """What two people with chemistry have in common, for each pair with both records."""
    v = versions(spark, d).filter("kind = 'chemistry' AND src <> dst")
    pairs = v.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    films_of = casts(spark, d).select("title_id", "person").distinct()
    return graph.pair_metrics(pairs, people(spark, d), films_of)


@query(f"""WITH v AS (SELECT * FROM ({_VERSIONS}) WHERE kind = 'employment' AND src <> dst), c AS (SELECT company_id AS id, min(specialty_genres) AS tags FROM company GROUP BY 1), p AS ({_PEOPLE}),
e AS (SELECT DISTINCT src, dst FROM v) SELECT src, dst, round({_JACCARD}, 6) AS likeness, CASE WHEN coalesce({_JACCARD}, 0) > 0.25 THEN 1.8 ELSE 1.0 END AS factor FROM e JOIN c a ON a.id = src JOIN p b ON b.id = dst""")
def company_affinity(spark, d):
    """How far a company's fields meet a person's style, and the factor that follows."""
    e = versions(spark, d).filter("kind = 'employment' AND src <> dst").select("src", "dst").distinct()
    c = table(spark, d, "company").groupBy(F.col("company_id").alias("src")).agg(F.min("specialty_genres").alias("_a"))
    p = people(spark, d).select(F.col("id").alias("dst"), F.col("tags").alias("_b"))
    like = S.jaccard(F.array_distinct(S.split_list(F.col("_a"))), F.array_distinct(S.split_list(F.col("_b"))))
    joined = e.join(c, "src").join(p, "dst").withColumn("likeness", F.round(like, 6))
    return joined.select("src", "dst", "likeness", F.when(F.coalesce(like, F.lit(0.0)) > 0.25, 1.8).otherwise(1.0).alias("factor"))


@query(f"""WITH v AS (SELECT *, vt IS NOT NULL AND vt < 1990 AS dead FROM ({_VERSIONS}) WHERE kind IS NOT NULL), s AS (SELECT kind, count(*) AS n, count_if(dead) AS n_dead FROM v GROUP BY 1)
SELECT v.kind, count(*) AS kept, any_value(n) AS n, any_value(n_dead) AS n_dead FROM v JOIN s ON s.kind = v.kind WHERE NOT (dead AND (n >= 100000 OR n_dead >= 0.3 * n)) GROUP BY v.kind""")
def compaction(spark, d):
    """Versions left after the kinds with many rows, or three in ten dead, were rewritten without the dead."""
    v = versions(spark, d).filter("kind IS NOT NULL")
    kept = graph.compacted(v, ["kind"], F.coalesce(F.col("vt") < 1990, F.lit(False)))
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("kept"), F.first("_n").alias("n"), F.first("_dead").alias("n_dead"))


@query("""WITH r AS (SELECT p_partkey, p_size AS e, count(l_orderkey) AS a FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL),
q AS (SELECT a, e, greatest(greatest(e, 0.5) / greatest(a, 0.5), greatest(a, 0.5) / greatest(e, 0.5))::DOUBLE AS q FROM r WHERE a > 0)
SELECT floor(log10(a))::INT AS bucket, count(*) AS n, round(avg(q), 6) AS mean_q, round(avg(q / sqrt(a)), 6) AS q_by_root, round(corr(ln(a), ln(q)), 6) AS log_correlation FROM q GROUP BY 1""")
def scale_structure(spark, d):
    """Whether errors of an estimate grow with the rows or stay: means by size, error by root of rows, log-log correlation."""
    from weftline.operators import qerror

    lines = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("a"))
    part = table(spark, d, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"))
    return qerror.scale_structure(part.select("a", qerror.q_error(F.col("p_size"), F.col("a")).alias("q")), "a", "q")


@query(f"""WITH p AS ({_PEOPLE}) SELECT id, coalesce(nullif(trim(stage), ''), nullif(trim(nationality), ''), 'unknown') AS label FROM p""")
def alias_fallback(spark, d):
    """The first of several columns that is there and filled, under one name."""
    return reshape.first_column(people(spark, d).drop("gender"), "label", ["role", "gender", "stage", "nationality"], "unknown").select("id", "label")


@query("""WITH r AS (SELECT mid, row_number() OVER (ORDER BY mid, title NULLS FIRST) AS k, row_number() OVER (PARTITION BY mid ORDER BY title NULLS FIRST) AS again, title FROM (SELECT DISTINCT mid, title FROM movie_context)),
x AS (SELECT *, mid > 0 AND mid % 7 <> 0 AND again = 1 AS good FROM r), t AS (SELECT coalesce(max(mid), 0) AS top FROM x WHERE good)
SELECT mid, title, CASE WHEN good THEN mid ELSE top + row_number() OVER (PARTITION BY good ORDER BY mid, title NULLS FIRST) END AS id FROM x, t""")
def synthetic_ids(spark, d):
    """Films whose id is missing (here: divisible by 7) or used before get one above all others."""
    m = table(spark, d, "movie_context").select("mid", "title").distinct()
    m = m.withColumn("own", F.when(F.col("mid") % 7 != 0, F.col("mid")))
    return reshape.with_ids(m, "own", ["mid", "title"]).select("mid", "title", F.col("own").alias("id"))
