"""Join benchmarks as SQL text over views of the tables, and a runner for any such text.

The catalogue has the shapes of a join benchmark on the film tables: stars, several
attributes of one hub, fan-out through a hub, graph joins under validity, paths,
wedges and triangles. The same text runs here and in DuckDB.
"""

from __future__ import annotations

import glob
import os
import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators import joins
from weftline.operators.qerror import count_form
from weftline.session import table

TABLES = ("person", "company", "edges", "cast_year_cache", "movie_context", "cast_ensemble", "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Views that both engines read in the same way.
_SHAPES = """film AS (SELECT mid, min(title) AS title, min(concept.year) AS year, min(lower(trim(concept.genre))) AS genre, min(concept.country) AS country,
 min(concept.production_tier) AS tier, min(director_id) AS director, min(fin.runtime_minutes) AS runtime, min(fin.certification) AS certificate FROM movie_context GROUP BY mid),
who AS (SELECT person_id AS id, min(name) AS name, min(lower(trim(gender))) AS gender, min(nationality) AS nationality FROM person GROUP BY person_id),
house AS (SELECT company_id AS id, min(name) AS name, min(country) AS country, min(tier) AS tier FROM company GROUP BY company_id),
link AS (SELECT row_id, min(src_id) AS src, min(dst_id) AS dst, min(lower(trim(edge_type))) AS kind, min(valid_from) AS vf, min(valid_to) AS vt, min(weight) AS w FROM edges GROUP BY row_id),
part_in AS (SELECT DISTINCT title_id AS mid, person FROM ({unnested}) WHERE person > 0)"""
_UNNEST = {
    "spark": "SELECT title_id, explode(cast_ids) AS person FROM cast_ensemble",
    "duckdb": "SELECT title_id, unnest(cast_ids) AS person FROM cast_ensemble",
}
#: name: (relations, text)
CATALOG = {
    "cat_star_3": "SELECT min(f.title) AS title, min(w.name) AS name FROM film f, part_in p, who w WHERE f.mid = p.mid AND p.person = w.id AND w.gender = 'female' AND f.year > 2005",
    "cat_star_4": "SELECT min(f.title) AS title, min(d.name) AS director, count(*) AS n FROM film f, who d, part_in p, who w WHERE f.director = d.id AND p.mid = f.mid AND p.person = w.id AND f.genre IN ('drama', 'comedy') AND w.nationality = 'American'",
    "cat_director_cast": "SELECT count(*) AS n, min(f.title) AS title FROM film f, part_in p WHERE f.mid = p.mid AND f.director = p.person",
    "cat_two_people": "SELECT min(a.name) AS one, min(b.name) AS other, count(*) AS n FROM part_in p, part_in q, who a, who b, film f WHERE p.mid = q.mid AND p.person < q.person AND p.person = a.id AND q.person = b.id AND f.mid = p.mid AND f.year BETWEEN 1990 AND 1995 AND a.gender <> b.gender",
    "cat_like": "SELECT count(*) AS n, min(title) AS title FROM film WHERE title LIKE 'The %' OR title LIKE '%Harbour%'",
    "cat_text_compare": "SELECT min(certificate) AS least, max(country) AS most, count(*) AS n FROM film WHERE CAST(runtime AS STRING) < '99' AND certificate IS NOT NULL AND NOT (country LIKE 'U%')",
    "cat_employed_cast": "SELECT h.name AS house, count(*) AS n, count(DISTINCT p.person) AS people FROM link e, part_in p, film f, house h WHERE e.kind = 'employment' AND e.dst = p.person AND p.mid = f.mid AND e.src = h.id AND e.vf <= f.year AND e.vt >= f.year GROUP BY h.name",
    "cat_friends_together": "SELECT count(*) AS n, min(f.title) AS title FROM link e, part_in p, part_in q, film f WHERE e.kind = 'friendship' AND e.src = p.person AND e.dst = q.person AND p.mid = q.mid AND f.mid = p.mid AND e.vf <= f.year AND e.vt >= f.year",
    "cat_rivals_together": "SELECT f.genre AS genre, count(*) AS n FROM link e, part_in p, part_in q, film f WHERE e.kind = 'rivalry' AND e.src = p.person AND e.dst = q.person AND p.mid = q.mid AND f.mid = p.mid AND e.w > 0.5 GROUP BY f.genre",
    "cat_friend_then_rival": "SELECT count(*) AS n, min(r.vf - f.vf) AS least_years FROM link f, link r WHERE f.kind = 'friendship' AND r.kind = 'rivalry' AND f.src = r.src AND f.dst = r.dst AND r.vf > f.vf",
    "cat_mentor_chain": "SELECT count(*) AS n, min(a.name) AS first FROM link e, link g, who a WHERE e.kind = 'mentorship' AND g.kind = 'mentorship' AND e.dst = g.src AND e.src = a.id AND e.src <> g.dst",
    "cat_mixed_path": "SELECT count(*) AS n FROM link e, link g WHERE e.kind = 'employment' AND g.kind = 'friendship' AND e.dst = g.src AND e.vf <= 2010 AND e.vt >= 2010 AND g.vf <= 2010 AND g.vt >= 2010",
    "cat_triangle": "SELECT count(*) AS n FROM link a, link b, link c WHERE a.kind = 'chemistry' AND b.kind = 'chemistry' AND c.kind = 'chemistry' AND a.dst = b.src AND b.dst = c.dst AND a.src = c.src AND a.src < a.dst AND b.src < b.dst",
    "cat_gap_same_person": "SELECT count(*) AS n FROM part_in p, part_in q, film f, film g WHERE p.person = q.person AND p.mid = f.mid AND q.mid = g.mid AND g.year - f.year > 35",
    "cat_group_limit": "SELECT genre, count(*) AS n FROM film WHERE genre IS NOT NULL GROUP BY genre ORDER BY n DESC, genre LIMIT 5",
    "cat_nested_average": "SELECT round(avg(n), 6) AS mean, max(n) AS most FROM (SELECT mid, count(*) AS n FROM part_in GROUP BY mid) x",
    "cat_scalar_ratio": "SELECT round(count(*) / CAST((SELECT count(*) FROM film) AS DOUBLE), 8) AS share FROM film WHERE genre = 'drama'",
    "cat_not_exists": "SELECT count(*) AS n FROM film f WHERE NOT EXISTS (SELECT 1 FROM part_in p WHERE p.mid = f.mid)",
    "cat_blacklisted_cast": "SELECT count(*) AS n FROM link b, part_in p, film f WHERE b.kind = 'blacklist' AND b.dst = p.person AND p.mid = f.mid AND b.vf <= f.year AND (b.vt IS NULL OR b.vt >= f.year)",
    "cat_market_chain": "SELECT h.tier AS tier, count(*) AS n FROM link a, link b, house h WHERE a.kind = 'market_rival' AND b.kind = 'subsidiary' AND a.dst = b.src AND h.id = a.src GROUP BY h.tier",
}

_ACTIVE = "e.vf <= f.year AND (e.vt IS NULL OR e.vt >= f.year)"
#: Two of a film's people with an edge of a kind that was valid in the film's year.
CATALOG |= {
    f"cat_together_{kind}": f"SELECT count(*) AS n, min(f.title) AS title, max(f.year) AS latest FROM link e, part_in p, part_in q, film f WHERE e.kind = '{kind}' AND e.src = p.person AND e.dst = q.person AND p.mid = q.mid AND f.mid = p.mid AND {_ACTIVE}"
    for kind in ("mentorship", "chemistry", "collaboration", "clique", "former_collaborator")
}
#: From one person over two edges to another.
CATALOG |= {
    f"cat_path_{one}_{two}": f"SELECT count(*) AS n, min(a.src) AS least, max(b.dst) AS most FROM link a, link b WHERE a.kind = '{one}' AND b.kind = '{two}' AND a.dst = b.src AND a.src <> b.dst AND a.vf <= b.vf"
    for one, two in (("mentorship", "chemistry"), ("chemistry", "rivalry"), ("clique", "mentorship"), ("mentorship", "rivalry"))
}
#: One pair with edges of two kinds at one time.
CATALOG |= {
    f"cat_both_{one}_{two}": f"SELECT count(*) AS n, min(a.vf) AS first, max(b.vf) AS last FROM link a, link b WHERE a.kind = '{one}' AND b.kind = '{two}' AND a.src = b.src AND a.dst = b.dst AND a.vf <= coalesce(b.vt, 9999) AND b.vf <= coalesce(a.vt, 9999)"
    for one, two in (("collaboration", "rivalry"), ("friendship", "chemistry"), ("clique", "collaboration"), ("brand_fit", "employment"))
}
#: Triangles of edges of given kinds.
CATALOG |= {
    f"cat_triangle_{one}_{two}": f"SELECT count(*) AS n FROM link a, link b, link c WHERE a.kind = '{one}' AND b.kind = '{one}' AND c.kind = '{two}' AND a.dst = b.src AND a.src = c.src AND b.dst = c.dst"
    for one, two in (("clique", "clique"), ("chemistry", "rivalry"), ("mentorship", "chemistry"))
}
CATALOG |= {
    "cat_hierarchy": "SELECT p.name AS parent, count(*) AS children, min(c.name) AS first FROM link e, house p, house c WHERE e.kind = 'subsidiary' AND e.src = p.id AND e.dst = c.id GROUP BY p.name",
    "cat_hierarchy_two": "SELECT g.name AS top, p.name AS middle, c.name AS child FROM link e, link h, house g, house p, house c WHERE e.kind = 'subsidiary' AND h.kind = 'subsidiary' AND e.dst = h.src AND g.id = e.src AND p.id = e.dst AND c.id = h.dst AND e.src <> h.dst AND e.src <> e.dst AND h.src <> h.dst",
    "cat_link_both_ends": "SELECT a.name AS one, b.name AS other, e.vf AS since FROM link e, house a, house b WHERE e.kind = 'market_rival' AND e.src = a.id AND e.dst = b.id AND a.tier <> b.tier",
    "cat_mentor_names": "SELECT a.name AS mentor, b.name AS pupil, e.vf AS since FROM link e, who a, who b WHERE e.kind = 'mentorship' AND a.id = e.src AND b.id = e.dst AND a.nationality = b.nationality",
    "cat_job_change": "SELECT count(*) AS n, min(b.vf - a.vt) AS least, max(b.vf - a.vt) AS most FROM link a, link b WHERE a.kind = 'employment' AND b.kind = 'employment' AND a.dst = b.dst AND a.src <> b.src AND b.vf > a.vt",
    "cat_job_overlap": "SELECT a.src AS one, count(*) AS n FROM link a, link b WHERE a.kind = 'employment' AND b.kind = 'exclusive_deal' AND a.dst = b.dst AND a.src <> b.src AND a.vf <= coalesce(b.vt, 9999) AND b.vf <= coalesce(a.vt, 9999) GROUP BY a.src",
    "cat_deal_then_blacklist": "SELECT count(*) AS n, min(b.vf - a.vf) AS least FROM link a, link b WHERE a.kind = 'exclusive_deal' AND b.kind = 'blacklist' AND a.src = b.src AND a.dst = b.dst AND b.vf >= a.vf",
    "cat_houses_of_cast": "SELECT h.country AS country, f.genre AS genre, count(DISTINCT p.person) AS people FROM link e, house h, part_in p, film f WHERE e.kind = 'employment' AND e.src = h.id AND e.dst = p.person AND p.mid = f.mid AND e.vf <= f.year AND e.vt >= f.year GROUP BY h.country, f.genre",
    "cat_director_employed": "SELECT h.tier AS tier, count(*) AS n FROM film f, link e, house h WHERE e.kind = 'employment' AND e.dst = f.director AND e.src = h.id AND e.vf <= f.year AND (e.vt IS NULL OR e.vt >= f.year) GROUP BY h.tier",
    "cat_director_befriends_cast": "SELECT count(*) AS n, count(DISTINCT f.mid) AS films FROM film f, part_in p, link e WHERE e.kind = 'friendship' AND p.mid = f.mid AND ((e.src = f.director AND e.dst = p.person) OR (e.dst = f.director AND e.src = p.person))",
    "cat_rival_of_director": "SELECT f.country AS country, count(*) AS n FROM film f, part_in p, link e WHERE e.kind = 'rivalry' AND p.mid = f.mid AND e.src = f.director AND e.dst = p.person GROUP BY f.country",
    "cat_star_5": "SELECT min(f.title) AS title, min(w.name) AS name, min(d.name) AS director, count(*) AS n FROM film f, part_in p, who w, who d WHERE f.mid = p.mid AND p.person = w.id AND f.director = d.id AND f.runtime > 120 AND w.gender <> d.gender AND f.country IN ('US', 'GB', 'FR')",
    "cat_star_decades": "SELECT floor(f.year / 10) * 10 AS decade, w.gender AS gender, count(*) AS n FROM film f, part_in p, who w WHERE f.mid = p.mid AND p.person = w.id GROUP BY floor(f.year / 10) * 10, w.gender",
    "cat_star_tier": "SELECT f.tier AS tier, w.nationality AS nationality, count(DISTINCT f.mid) AS films, min(w.name) AS name FROM film f, part_in p, who w WHERE f.mid = p.mid AND p.person = w.id AND f.tier IN ('Epic', 'A') GROUP BY f.tier, w.nationality HAVING count(*) > 20",
    "cat_two_films_one_year": "SELECT count(*) AS n FROM part_in p, part_in q, film f, film g WHERE p.person = q.person AND p.mid = f.mid AND q.mid = g.mid AND f.year = g.year AND f.genre = 'horror' AND g.genre = 'comedy'",
    "cat_same_director_cast": "SELECT count(*) AS n, min(f.title) AS title FROM film f, film g, part_in p, part_in q WHERE f.director = g.director AND f.director > 0 AND f.mid < g.mid AND p.mid = f.mid AND q.mid = g.mid AND p.person = q.person",
    "cat_certificates": "SELECT certificate, count(*) AS n, round(avg(runtime), 6) AS mean, min(runtime) AS least, max(runtime) AS most FROM film WHERE certificate IS NOT NULL GROUP BY certificate",
    "cat_kinds_by_decade": "SELECT kind, floor(vf / 10) * 10 AS decade, count(*) AS n FROM link WHERE vf IS NOT NULL GROUP BY kind, floor(vf / 10) * 10",
    "cat_spans": "SELECT kind, count(*) AS n, min(vt - vf) AS least, max(vt - vf) AS most, round(avg(vt - vf), 6) AS mean FROM link WHERE vf <= vt GROUP BY kind",
    "cat_in_list": "SELECT count(*) AS n, min(name) AS name FROM who WHERE id IN (SELECT director FROM film WHERE year > 2015) AND id NOT IN (SELECT person FROM part_in)",
    "cat_except": "SELECT count(*) AS n FROM (SELECT src FROM link WHERE kind = 'friendship' EXCEPT SELECT src FROM link WHERE kind = 'rivalry') x",
    "cat_intersect": "SELECT count(*) AS n FROM (SELECT dst FROM link WHERE kind = 'employment' INTERSECT SELECT dst FROM link WHERE kind = 'blacklist') x",
    "cat_exists_two": "SELECT count(*) AS n FROM who x WHERE EXISTS (SELECT 1 FROM link e WHERE e.src = x.id AND e.kind = 'mentorship') AND EXISTS (SELECT 1 FROM part_in p WHERE p.person = x.id)",
    "cat_left_missing": "SELECT count(*) AS n, count(w.id) AS known FROM link e LEFT JOIN who w ON w.id = e.dst WHERE e.kind = 'friendship'",
    "cat_full_outer": "SELECT count(*) AS n, count(a.director) AS directors, count(b.person) AS actors FROM (SELECT DISTINCT director FROM film WHERE director > 0) a FULL JOIN (SELECT DISTINCT person FROM part_in) b ON a.director = b.person",
    "cat_top_people": "SELECT w.name AS name, p.n AS n FROM (SELECT person, count(*) AS n FROM part_in GROUP BY person) p, who w WHERE p.person = w.id AND w.name IS NOT NULL ORDER BY p.n DESC, w.name, w.id LIMIT 25",
    "cat_window_share": "SELECT genre, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 8) AS share FROM (SELECT genre, count(*) AS n FROM film WHERE genre IS NOT NULL GROUP BY genre) x",
    "cat_rollup": "SELECT tier, genre, count(*) AS n FROM film WHERE tier IS NOT NULL AND genre IS NOT NULL GROUP BY ROLLUP (tier, genre)",
    "cat_case_sum": "SELECT year, sum(CASE WHEN genre = 'drama' THEN 1 ELSE 0 END) AS drama, sum(CASE WHEN runtime >= 120 THEN 1 ELSE 0 END) AS long FROM film WHERE year IS NOT NULL GROUP BY year",
    "cat_three_hops": "SELECT count(*) AS n FROM link a, link b, link c WHERE a.kind = 'mentorship' AND b.kind = 'mentorship' AND c.kind = 'chemistry' AND a.dst = b.src AND b.dst = c.src AND a.src <> b.dst",
    "cat_orders_lines": "SELECT o_orderpriority AS priority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_quantity < 24 GROUP BY o_orderpriority",
}


def register(spark: SparkSession, folder: str) -> None:
    """Views of all tables of a folder."""
    for name in TABLES:
        table(spark, folder, name).createOrReplaceTempView(name)


def _text(name: str, engine: str) -> str:
    text = CATALOG[name] if engine == "spark" else CATALOG[name].replace("AS STRING", "AS VARCHAR")
    return f"WITH {_SHAPES.format(unnested=_UNNEST[engine])} {text}"


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        register(spark, d)
        return spark.sql(_text(name, "spark"))

    run.__name__ = name
    return run


def _view(spark: SparkSession, d: str, text: str) -> DataFrame:
    """A text over the views of the catalogue."""
    register(spark, d)
    return spark.sql(f"WITH {_SHAPES.format(unnested=_UNNEST['spark'])} {text}")


def _linked_casts(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """``year, title, genre`` of a film and ``vf, vt, w`` of an edge of a kind, for each edge between two of the film's people.

    As in the texts' joins, an edge counts with every version, and one to itself counts too.
    """
    link = _view(spark, d, f"SELECT src, dst, vf, vt, w FROM link WHERE kind = '{kind}'")
    cast = _view(spark, d, "SELECT mid, collect_set(person) AS people FROM part_in GROUP BY mid")
    film = _view(spark, d, "SELECT mid, year, title, genre FROM film")
    return joins.together(cast.join(film, "mid"), "people", link).join(link, ["src", "dst"])


def cat_friends_together(spark: SparkSession, d: str) -> DataFrame:
    met = _linked_casts(spark, d, "friendship").filter("vf <= year AND vt >= year")
    return met.agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("title"))


def _cat_together(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        met = _linked_casts(spark, d, kind).filter("vf <= year AND (vt IS NULL OR vt >= year)")
        return met.agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("title"), F.max("year").alias("latest"))

    run.__name__ = f"cat_together_{kind}"
    return run


def cat_rivals_together(spark: SparkSession, d: str) -> DataFrame:
    return _linked_casts(spark, d, "rivalry").filter("w > 0.5").groupBy("genre").agg(F.count(F.lit(1)).alias("n"))


def cat_director_befriends_cast(spark: SparkSession, d: str) -> DataFrame:
    """The edge's ends and the two people are compared in order, so that one equi join does for either direction."""
    ends = "least({0}, {1}) AS src, greatest({0}, {1}) AS dst"
    link = _view(spark, d, f"SELECT {ends.format('src', 'dst')}, count(*) AS n FROM link WHERE kind = 'friendship' AND src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2")
    met = _view(spark, d, f"SELECT f.mid, {ends.format('f.director', 'p.person')} FROM film f, part_in p WHERE f.mid = p.mid AND f.director IS NOT NULL")
    return met.join(link, ["src", "dst"]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.countDistinct("mid").alias("films"))


def cat_gap_same_person(spark: SparkSession, d: str) -> DataFrame:
    """A person's films are counted by year, and each year's times those of the years long before; no two films are paired."""
    per = _view(spark, d, "SELECT p.person, CAST(f.year AS BIGINT) AS year, count(*) AS n FROM part_in p, film f WHERE p.mid = f.mid AND f.year IS NOT NULL GROUP BY 1, 2")
    before = Window.partitionBy("person").orderBy("year").rangeBetween(Window.unboundedPreceding, -36)
    return per.select((F.col("n") * F.sum("n").over(before)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


#: Texts that Spark plans by way of too many rows; their results are the same.
PLANNED = {f.__name__: f for f in (cat_friends_together, *map(_cat_together, ("chemistry", "former_collaborator", "clique", "mentorship", "collaboration")), cat_rivals_together, cat_director_befriends_cast, cat_gap_same_person)}

QUERIES = {name: _query(name) for name in CATALOG} | PLANNED
ORACLE = {name: _text(name, "duckdb") for name in CATALOG}


def natural_order(path: str) -> list:
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", os.path.basename(path))]


def run_texts(spark: SparkSession, texts: dict[str, str], seconds: int = 600) -> DataFrame:
    """Runs queries one after the other: ``query, status, n_rows, wall_ms, error``.

    A query that takes longer than ``seconds`` is cancelled; errors don't stop the others.
    """
    import threading

    rows = []
    context = spark.sparkContext
    for name, text in texts.items():
        tag = f"weftline-{name}"
        context.addJobTag(tag)
        timer = threading.Timer(seconds, context.cancelJobsWithTag, [tag])
        timer.start()
        began = time.time()
        try:
            n = spark.sql(count_form(text)).first()["n"]
            rows.append((name, "OK" if n else "EMPTY", n, (time.time() - began) * 1000, None))
        except Exception as e:  # noqa: BLE001
            rows.append((name, "ERROR", None, (time.time() - began) * 1000, str(e)[:500]))
        finally:
            timer.cancel()
            context.removeJobTag(tag)
    return spark.createDataFrame(rows, "query string, status string, n_rows long, wall_ms double, error string")


def run_folder(spark: SparkSession, folder: str, seconds: int = 600) -> DataFrame:
    """Runs the ``*.sql`` files of a folder in natural order."""
    texts = {}
    for path in sorted(glob.glob(os.path.join(folder, "*.sql")), key=natural_order):
        with open(path) as f:
            texts[os.path.basename(path)[:-4]] = f.read()
    return run_texts(spark, texts, seconds)


def adapted(text: str, changes: list[tuple[str, str]]) -> str:
    """A text with literal replacements made in order."""
    for old, new in changes:
        text = text.replace(old, new)
    return text


def scale_against_structure(small: DataFrame, large: DataFrame) -> DataFrame:
    """Two runs' q-errors by query: ``query, q_small, q_large, growth``; ``growth`` is their ratio."""
    s, l = small.select("query", F.col("q").alias("q_small")), large.select("query", F.col("q").alias("q_large"))
    return s.join(l, "query", "full").withColumn("growth", F.try_divide("q_large", "q_small"))
