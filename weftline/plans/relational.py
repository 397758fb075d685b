"""Queries for scans, filters, joins, aggregates and statistics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators import joins, sampling, statistics
from weftline.session import clean_label, parallelism, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None):
    """Registers a query under its name, with the SQL it must agree with."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


# ---- star and path joins


@query("""SELECT r_name, count(*) AS n_lines, min(p_name) AS first_part, min(s_name) AS first_supplier, max(l_quantity) AS most
FROM lineitem, orders, customer, nation, region, part, supplier
WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey
  AND l_partkey = p_partkey AND l_suppkey = s_suppkey AND p_size BETWEEN 5 AND 25 AND o_orderstatus IN ('F', 'O') AND l_quantity > 10
GROUP BY r_name""")
def job_star_join(spark, d):
    line, orders, cust, nation, region, part, supp = load(spark, d, "lineitem", "orders", "customer", "nation", "region", "part", "supplier")
    joined = (
        line.filter(F.col("l_quantity") > 10)
        .join(orders.filter(F.col("o_orderstatus").isin("F", "O")), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part.filter(F.col("p_size").between(5, 25)), F.col("l_partkey") == F.col("p_partkey"))
        .join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy("r_name").agg(
        F.count(F.lit(1)).alias("n_lines"), F.min("p_name").alias("first_part"), F.min("s_name").alias("first_supplier"), F.max("l_quantity").alias("most")
    )


@query("""SELECT min(o_orderpriority) AS priority, min(p_name) AS part, min(c_name) AS customer
FROM lineitem, orders, customer, part WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_partkey = p_partkey
AND p_brand LIKE '%3' AND c_mktsegment = 'BUILDING' AND NOT (p_type LIKE 'PROMO%')""")
def job_min_projection(spark, d):
    """Minima over a join; of each side only the columns asked for are read, and they meet in plain joins."""
    line, orders, cust, part = load(spark, d, "lineitem", "orders", "customer", "part")
    part = part.filter(F.col("p_brand").like("%3") & ~F.col("p_type").startswith("PROMO"))
    joined = (
        line.select("l_orderkey", "l_partkey")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(cust.filter(F.col("c_mktsegment") == "BUILDING"), F.col("o_custkey") == F.col("c_custkey"))
    )
    return joined.agg(F.min("o_orderpriority").alias("priority"), F.min("p_name").alias("part"), F.min("c_name").alias("customer"))


_EAV = """eav AS (
  SELECT p_partkey AS id, 'brand' AS info_type, p_brand AS info FROM part UNION ALL
  SELECT p_partkey, 'type', p_type FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part)"""


def _eav(spark, d):
    part = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("size")
    )
    return part.unpivot("id", ["brand", "type", "size"], "info_type", "info")


@query(f"WITH {_EAV} SELECT * FROM eav WHERE info IS NOT NULL AND trim(info) <> '' AND lower(trim(info)) <> 'nan'")
def unpivot_eav(spark, d):
    return _eav(spark, d).filter(S.null_if_missing(F.col("info")).isNotNull())


@query(f"""WITH {_EAV} SELECT a.info AS brand, count(*) AS n, min(b.info) AS first_type, count(DISTINCT c.info) AS sizes
FROM eav a JOIN eav b ON a.id = b.id JOIN eav c ON a.id = c.id
WHERE a.info_type = 'brand' AND b.info_type = 'type' AND c.info_type = 'size' AND c.info < '3' GROUP BY a.info""")
def eav_self_join(spark, d):
    e = _eav(spark, d)
    kind = lambda k, name: e.filter(F.col("info_type") == k).select("id", F.col("info").alias(name))
    # sizes stay text: '10' < '3'
    joined = kind("brand", "brand").join(kind("type", "type"), "id").join(kind("size", "size").filter(F.col("size") < "3"), "id")
    return joined.groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.min("type").alias("first_type"), F.countDistinct("size").alias("sizes"))


@query("""SELECT CAST(sum(a.n * b.n * c.n) AS VARCHAR) AS n FROM
(SELECT l_suppkey AS k, count(*)::HUGEINT AS n FROM lineitem GROUP BY 1) a JOIN
(SELECT s_suppkey AS k, count(*) AS n FROM supplier GROUP BY 1) b USING (k) JOIN
(SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) c USING (k)""")
def multi_path_fanout(spark, d):
    line, supp = load(spark, d, "lineitem", "supplier")
    facts = [(line, "l_suppkey", "s_suppkey"), (line.filter("l_returnflag = 'R'"), "l_suppkey", "s_suppkey")]
    return joins.fan_out_count(supp.select("s_suppkey"), facts).select(F.col("n").cast("string").alias("n"))


_VERSIONS = """SELECT row_id, any_value(src_id) AS src, any_value(dst_id) AS dst, lower(trim(any_value(edge_type))) AS kind,
 any_value(valid_from) AS vf, any_value(valid_to) AS vt, coalesce(any_value(_scd2_retired), false) AS retired, any_value(weight) AS w
 FROM edges GROUP BY row_id"""


def versions(spark, d) -> DataFrame:
    """Distinct edge versions with short names."""
    return table(spark, d, "edges").select(
        "row_id", F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), clean_label(F.col("edge_type")).alias("kind"),
        F.col("valid_from").alias("vf"), F.col("valid_to").alias("vt"), F.coalesce("_scd2_retired", F.lit(False)).alias("retired"), F.col("weight").alias("w"),
    ).dropDuplicates(["row_id"])


_CASTS = """SELECT DISTINCT title_id, year, person FROM (
 SELECT title_id, year, unnest(cast_ids) AS person FROM cast_ensemble) WHERE person > 0"""


def casts(spark, d) -> DataFrame:
    """``title_id, year, person``, each person once per film."""
    return (
        table(spark, d, "cast_ensemble")
        .select("title_id", "year", F.explode(F.array_distinct("cast_ids")).alias("person"))
        .filter("person > 0").distinct()
    )


@query(f"""WITH v AS ({_VERSIONS}), c AS ({_CASTS})
SELECT v.kind, count(*) AS n, count(DISTINCT c.title_id) AS films FROM v JOIN c ON v.dst = c.person AND v.vf <= c.year AND v.vt >= c.year GROUP BY v.kind""")
def interval_contains_join(spark, d):
    """Equi join on the person, the validity a condition of the join; null bounds contain nothing."""
    v, c = versions(spark, d), casts(spark, d)
    joined = v.join(c, (v.dst == c.person) & joins.contains(v.vf, v.vt, c.year))
    return joined.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("title_id").alias("films"))


@query(f"""WITH v AS ({_VERSIONS}) SELECT kind, count(*) AS n FROM v WHERE vf <= 2010 AND vt >= 2005 GROUP BY kind""")
def interval_overlap(spark, d):
    v = versions(spark, d)
    return v.filter(joins.overlaps(v.vf, v.vt, F.lit(2005), F.lit(2010))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH v AS (SELECT * FROM ({_VERSIONS}) WHERE vt IS NOT NULL AND vf <= vt), y AS (SELECT DISTINCT year FROM cast_ensemble WHERE year IS NOT NULL)
SELECT y.year, count(*) AS n FROM y JOIN v ON v.vf <= y.year AND v.vt >= y.year GROUP BY y.year""")
def interval_join_by_blocks(spark, d):
    years = table(spark, d, "cast_ensemble").select("year").filter("year IS NOT NULL").distinct()
    return joins.interval_join(years, "year", versions(spark, d).filter("vt IS NOT NULL"), "vf", "vt").groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH c AS ({_CASTS}), m AS (SELECT person, min(year) AS a, max(year) AS b FROM c GROUP BY person)
SELECT person, a AS first_year, b AS last_year FROM m WHERE b - a > 20""")
def year_gap_self_join(spark, d):
    """People with two films more than 20 years apart; the extremes decide, so no self join is needed."""
    span = casts(spark, d).groupBy("person").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return span.filter(F.col("last_year") - F.col("first_year") > 20)


@query(f"""WITH v AS (SELECT DISTINCT src, dst FROM ({_VERSIONS}) WHERE kind = 'mentorship')
SELECT count(*) AS n, count(DISTINCT a.src) AS starts, min(b.dst) AS least_end FROM v a JOIN v b ON a.dst = b.src WHERE a.src <> b.dst""")
def edge_path2(spark, d):
    pairs = versions(spark, d).filter("kind = 'mentorship'").select("src", "dst").distinct()
    return joins.two_paths(pairs).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("starts"), F.min("c").alias("least_end"))


_KIND = "SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM ({v}) WHERE kind = '{k}' AND src <> dst"


@query(f"""WITH f AS ({_KIND.format(v=_VERSIONS, k='friendship')}), r AS ({_KIND.format(v=_VERSIONS, k='rivalry')}),
n AS (SELECT src AS v, dst AS w FROM f UNION ALL SELECT dst, src FROM f)
SELECT r.src, r.dst, count(*) AS n_common FROM r JOIN n a ON a.v = r.src JOIN n b ON b.v = r.dst AND a.w = b.w GROUP BY ALL""")
def edge_wedge(spark, d):
    """Rivals with common friends."""
    v = versions(spark, d)
    return joins.common_neighbours(v.filter("kind = 'rivalry'"), v.filter("kind = 'friendship'"))


@query(f"""WITH f AS ({_KIND.format(v=_VERSIONS, k='friendship')})
SELECT x.src AS a, x.dst AS b, y.dst AS c FROM f x JOIN f y ON x.dst = y.src JOIN f z ON z.src = x.src AND z.dst = y.dst""")
def edge_triangle(spark, d):
    return joins.triangles(versions(spark, d).filter("kind = 'friendship'"))


@query(f"""WITH f AS (SELECT DISTINCT src, dst FROM ({_VERSIONS}) WHERE kind = 'friendship')
SELECT count(*) AS n FROM f x JOIN f y ON x.dst = y.src JOIN f z ON y.dst = z.src AND z.dst = x.src""")
def edge_triangle_cycle(spark, d):
    return joins.directed_cycles(versions(spark, d).filter("kind = 'friendship'")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH f AS ({_KIND.format(v=_VERSIONS, k='friendship')}), c AS (SELECT person, count(*)::HUGEINT AS n FROM ({_CASTS}) GROUP BY person)
SELECT CAST(coalesce(sum(a.n * b.n * e.n), 0) AS VARCHAR) AS n FROM f x JOIN f y ON x.dst = y.src JOIN f z ON z.src = x.src AND z.dst = y.dst
JOIN c a ON a.person = x.src JOIN c b ON b.person = x.dst JOIN c e ON e.person = y.dst""")
def triangle_factorised(spark, d):
    """Triangles times the films of each corner, from counts per corner."""
    films = casts(spark, d)
    corners = joins.triangles(versions(spark, d).filter("kind = 'friendship'"))
    return joins.fan_out_count(corners, [(films, "person", k) for k in ("a", "b", "c")]).select(F.col("n").cast("string").alias("n"))


@query(f"""WITH v AS ({_VERSIONS}) SELECT DISTINCT f.src, f.dst FROM v f JOIN v r ON f.src = r.src AND f.dst = r.dst
WHERE f.kind = 'friendship' AND r.kind = 'rivalry' AND r.vf > f.vf""")
def same_pair_two_types(spark, d):
    v = versions(spark, d)
    first = v.filter("kind = 'friendship'").groupBy("src", "dst").agg(F.min("vf").alias("f"))
    last = v.filter("kind = 'rivalry'").groupBy("src", "dst").agg(F.max("vf").alias("r"))
    return first.join(last, ["src", "dst"]).filter("r > f").select("src", "dst")


@query(f"""SELECT count(*) AS n, round(avg(pop_weight), 6) AS mean_weight FROM person p
WHERE EXISTS (SELECT 1 FROM ({_CASTS}) c WHERE c.person = p.person_id) AND isfinite(pop_weight)""")
def semi_join(spark, d):
    person = table(spark, d, "person").filter(F.col("pop_weight").isNotNull() & ~F.isnan("pop_weight") & (F.abs("pop_weight") != float("inf")))
    kept = person.join(casts(spark, d).select("person"), F.col("person_id") == F.col("person"), "left_semi")
    return kept.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("pop_weight"), 6).alias("mean_weight"))


@query(f"""SELECT DISTINCT person AS key FROM ({_CASTS}) WHERE person NOT IN (SELECT person_id FROM person)""")
def anti_join_orphans(spark, d):
    return joins.orphan_keys(casts(spark, d), "person", table(spark, d, "person"), "person_id")


@query(f"""WITH p AS (SELECT person_id, max_by(name, recorded_at) AS name FROM person WHERE name IS NOT NULL GROUP BY person_id)
SELECT mid, coalesce(p.name, 'unknown') AS director FROM (SELECT DISTINCT mid, director_id FROM movie_context) m LEFT JOIN p ON p.person_id = m.director_id""")
def map_lookup_left(spark, d):
    movies = table(spark, d, "movie_context").select("mid", "director_id").distinct()
    named = table(spark, d, "person").filter("name IS NOT NULL")
    return joins.lookup(movies, "director_id", named, "person_id", "name", "recorded_at", "unknown", "director").select("mid", "director")


@query("""SELECT a, b, score FROM (SELECT x.s_suppkey AS a, y.s_suppkey AS b, round(-abs(x.s_acctbal - y.s_acctbal), 2) AS score,
row_number() OVER (PARTITION BY x.s_suppkey ORDER BY round(-abs(x.s_acctbal - y.s_acctbal), 2) DESC, y.s_suppkey) AS r
FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey <> y.s_suppkey) WHERE r <= 3""")
def block_join_score(spark, d):
    return joins.block_scores(table(spark, d, "supplier"), "s_suppkey", ["s_nationkey"], lambda x, y: F.round(-F.abs(x("s_acctbal") - y("s_acctbal")), 2), 3)


@query("""WITH p AS (SELECT DISTINCT name FROM person WHERE name IS NOT NULL), c AS (SELECT DISTINCT name FROM company WHERE name IS NOT NULL),
m AS (SELECT a.name, b.name AS match, levenshtein(a.name, b.name) AS edits FROM p a JOIN (SELECT DISTINCT src_name AS name FROM edges WHERE src_type = 'person' AND src_name IS NOT NULL) b
ON left(a.name, 3) = left(b.name, 3) WHERE a.name <> b.name AND abs(length(a.name) - length(b.name)) <= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY edits, match) AS k FROM m WHERE edits <= 3)
SELECT name, match, edits FROM r WHERE k = 1""")
def fuzzy_levenshtein(spark, d):
    """For each person's name the nearest other name at the start of an edge among those with the same first three letters.

    :func:`nearest_names` compares with all names.
    """
    left = table(spark, d, "person").select("name").filter("name IS NOT NULL")
    right = table(spark, d, "edges").filter("src_type = 'person' AND src_name IS NOT NULL").select(F.col("src_name").alias("name"))
    l = left.distinct().withColumn("b", F.left("name", F.lit(3)))
    r = right.distinct().withColumn("b", F.left("name", F.lit(3))).withColumnRenamed("name", "match")
    near = l.join(r, "b").filter((F.col("name") != F.col("match")) & (F.abs(F.length("name") - F.length("match")) <= 3))
    near = near.withColumn("edits", F.levenshtein("name", "match", 3)).filter("edits >= 0")
    return near.groupBy("name").agg(F.min(F.struct("edits", "match")).alias("m")).select("name", "m.match", "m.edits")


@query("""WITH p AS (SELECT DISTINCT name FROM person WHERE name IS NOT NULL),
m AS (SELECT a.name, b.name AS match, levenshtein(lower(a.name), lower(b.name)) AS edits FROM p a JOIN (SELECT DISTINCT src_name AS name FROM edges WHERE src_type = 'person' AND src_name IS NOT NULL) b
ON a.name <> b.name AND abs(length(a.name) - length(b.name)) <= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY edits, match) AS k FROM m WHERE edits <= 3)
SELECT name, match, edits FROM r WHERE k = 1""")
def nearest_names(spark, d):
    """For each person's name the nearest other name at the start of an edge, of all within 3 edits whatever they begin with."""
    right = table(spark, d, "edges").filter("src_type = 'person'").select(F.col("src_name").alias("name"))
    return joins.nearest_of_all(table(spark, d, "person"), right)


@query("""SELECT '' AS dropped, count_if(l_quantity > 30 AND l_discount < 0.05 AND l_returnflag = 'R') AS n FROM lineitem UNION ALL
SELECT 'quantity', count_if(l_discount < 0.05 AND l_returnflag = 'R') FROM lineitem UNION ALL
SELECT 'discount', count_if(l_quantity > 30 AND l_returnflag = 'R') FROM lineitem UNION ALL
SELECT 'flag', count_if(l_quantity > 30 AND l_discount < 0.05) FROM lineitem""")
def diagnose_filters(spark, d):
    filters = {"quantity": F.col("l_quantity") > 30, "discount": F.col("l_discount") < 0.05, "flag": F.col("l_returnflag") == "R"}
    return joins.without_one_filter(table(spark, d, "lineitem"), filters)


# ---- aggregates


@query("""SELECT l_returnflag, l_linestatus, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, count(*) AS n FROM lineitem GROUP BY ALL""")
def count_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"), F.count(F.lit(1)).alias("n"))


@query("""SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, CAST(round(avg(n)) AS BIGINT) AS rounded FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)""")
def two_level_agg(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.avg("n")).cast("bigint").alias("rounded"))


@query("""SELECT l_returnflag, round(count(*)::DOUBLE / (SELECT count(*) FROM lineitem), 8) AS share FROM lineitem GROUP BY 1""")
def ratio_scalar_subquery(spark, d):
    shares = statistics.value_shares(table(spark, d, "lineitem"), "l_returnflag")
    return shares.select("l_returnflag", F.round("share", 8).alias("share"))


@query("""SELECT round(avg((l_quantity > 25)::INT), 8) AS p_a, round(avg((l_returnflag = 'R')::INT), 8) AS p_b,
round(sum((l_quantity > 25 AND l_returnflag = 'R')::INT) / nullif(sum((l_quantity > 25)::INT), 0)::DOUBLE, 8) AS p_b_given_a,
round(sum((l_quantity > 25 AND l_returnflag = 'R')::INT) / nullif(sum((l_quantity > 25)::INT), 0)::DOUBLE / nullif(avg((l_returnflag = 'R')::INT), 0), 8) AS lift FROM lineitem""")
def cond_probability_lift(spark, d):
    got = statistics.conditional_lift(table(spark, d, "lineitem"), F.col("l_quantity") > 25, F.col("l_returnflag") == "R")
    return got.select(*[F.round(c, 8).alias(c) for c in got.columns])


@query("SELECT o_orderpriority, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 8) AS share FROM orders GROUP BY 1")
def value_share(spark, d):
    return statistics.value_shares(table(spark, d, "orders"), "o_orderpriority").withColumn("share", F.round("share", 8))


@query("""SELECT round(avg(s), 8) AS mean_max_share FROM (SELECT max(n)::DOUBLE / sum(n) AS s FROM
(SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey)""")
def max_share_by_group(spark, d):
    return statistics.max_share(table(spark, d, "orders"), "o_custkey", "o_orderpriority").select(F.round("mean_max_share", 8).alias("mean_max_share"))


@query("""WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS o FROM orders GROUP BY ALL),
t AS (SELECT *, sum(o) OVER (PARTITION BY a) AS r, sum(o) OVER (PARTITION BY b) AS k FROM c)
SELECT round(sqrt(greatest(0, sum(o * o / (r * k)) - 1) / greatest(1, least(count(DISTINCT a), count(DISTINCT b)) - 1)), 6) AS cramers_v FROM t""")
def cramers_v(spark, d):
    return statistics.cramers_v(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority").select(F.round("cramers_v", 6).alias("cramers_v"))


@query("""WITH r AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders)
SELECT round((2 * sum(i * x) - (any_value(n) + 1) * sum(x)) / (any_value(n) * sum(x)), 6) AS gini FROM r""")
def gini(spark, d):
    return statistics.gini(table(spark, d, "orders"), "o_totalprice").select(F.round("gini", 6).alias("gini"))


@query("""WITH c AS (SELECT l_partkey, count(*) AS f FROM lineitem GROUP BY 1), r AS (SELECT f, row_number() OVER (ORDER BY f DESC, l_partkey) AS k FROM c)
SELECT round(regr_slope(ln(f), ln(k)), 6) AS slope, round(regr_r2(ln(f), ln(k)), 6) AS r2 FROM r""")
def zipf_fit(spark, d):
    return statistics.zipf_fit(table(spark, d, "lineitem"), "l_partkey").select(F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem")
def pearson(spark, d):
    return table(spark, d, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("pearson"))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a,
rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT round(corr(a, b), 6) AS spearman FROM r""")
def spearman(spark, d):
    return statistics.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("spearman", 6).alias("spearman"))


@query("""SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.75), 4) AS q75,
round(quantile_cont(o_totalprice, 0.9), 4) AS q90 FROM orders GROUP BY 1""")
def percentiles(spark, d):
    exact = lambda p: F.round(F.percentile("o_totalprice", p), 4)
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(exact(0.5).alias("q50"), exact(0.75).alias("q75"), exact(0.9).alias("q90"))


@query("""WITH s AS (SELECT o_orderstatus AS k, count(*)::DOUBLE / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY 1)
SELECT round(avg(abs(coalesce(share, 0) - target)), 8) AS mad FROM (VALUES ('F', 0.5), ('O', 0.4), ('P', 0.1)) t(k, target) LEFT JOIN s USING (k)""")
def mad_vs_target(spark, d):
    got = statistics.deviation_from_target(table(spark, d, "orders"), "o_orderstatus", {"F": 0.5, "O": 0.4, "P": 0.1})
    return got.select(F.round("mad", 8).alias("mad"))


@query("""SELECT round(sum(CASE WHEN r <= greatest(1, floor(n / 100)) THEN x END) / sum(x), 6) AS top_share
FROM (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice DESC) AS r, count(*) OVER () AS n FROM orders)""")
def top_one_percent_share(spark, d):
    return statistics.top_share(table(spark, d, "orders"), "o_totalprice").select(F.round("top_share", 6).alias("top_share"))


@query("""SELECT l_orderkey, string_agg(l_returnflag || ':' || l_linenumber, '; ' ORDER BY l_linenumber, l_returnflag) AS lines FROM lineitem WHERE l_quantity > 40 GROUP BY 1""")
def listagg_ordered(spark, d):
    text = F.concat_ws(":", "l_returnflag", F.col("l_linenumber").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", text.alias("t"))))
    return table(spark, d, "lineitem").filter("l_quantity > 40").groupBy("l_orderkey").agg(F.array_join(rows["t"], "; ").alias("lines"))


@query("""WITH s AS (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey))) AS s FROM lineitem GROUP BY 1), c AS (SELECT s, count(*) AS n FROM s GROUP BY 1)
SELECT round(sum(CASE WHEN n > 1 THEN n ELSE 0 END)::DOUBLE / sum(n), 8) AS dup_rate FROM c""")
def set_signature_dup_rate(spark, d):
    return statistics.duplicate_signature_rate(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey").select(F.round("dup_rate", 8).alias("dup_rate"))


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL""")
def crosstab(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_returnflag, l_linestatus, grouping(l_returnflag) + grouping(l_linestatus) AS level, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_totals(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(
        (F.grouping("l_returnflag") + F.grouping("l_linestatus")).cast("bigint").alias("level"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("""SELECT user_id, avg(value) FILTER (WHERE event_type = 'purchase') AS mean_purchase, count(*) FILTER (WHERE value > 50) AS n_high FROM events GROUP BY 1 HAVING count(*) > 20""")
def filtered_aggregates(spark, d):
    got = table(spark, d, "events").groupBy("user_id").agg(
        F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("mean_purchase"), F.count_if(F.col("value") > 50).alias("n_high"), F.count(F.lit(1)).alias("n"))
    return got.filter("n > 20").drop("n")


@query("""SELECT year(o_orderdate) // 10 * 10 AS decade, count(*) AS n FROM orders GROUP BY 1""")
def decade_histogram(spark, d):
    return table(spark, d, "orders").groupBy(S.decade(F.year("o_orderdate")).cast("bigint").alias("decade")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS bucket, count(*) AS n, round(avg(l_discount), 8) AS mean_discount FROM lineitem GROUP BY 1""")
def case_bucket(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy(F.when(q < 10, "low").when(q < 30, "mid").otherwise("high").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 8).alias("mean_discount"))


@query("""SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10""")
def top_values(spark, d):
    """A report of the ten most frequent values."""
    return table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand").limit(10)


@query("""SELECT tag, count(*) AS n FROM (SELECT DISTINCT person_id, trim(unnest(regexp_split_to_array(style_tags, '[;,|]'))) AS tag FROM person) WHERE tag <> '' GROUP BY 1""")
def delimited_tag_counts(spark, d):
    tags = table(spark, d, "person").select("person_id", F.explode(S.split_list(F.col("style_tags"))).alias("tag")).distinct()
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


# ---- sets and duplicates


@query("""SELECT * FROM (SELECT c_nationkey AS nation, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier)
UNION ALL SELECT * FROM (SELECT c_nationkey, 'customer' FROM customer EXCEPT SELECT s_nationkey, 'customer' FROM supplier)""")
def set_ops(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))
    return c.intersect(s).withColumn("side", F.lit("both")).unionByName(c.subtract(s).withColumn("side", F.lit("customer")))


@query("""SELECT row_number() OVER (ORDER BY src, key) AS id, src, key, name FROM (SELECT 1 AS src, s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT 2, c_custkey, c_name FROM customer)""")
def union_renumber(spark, d):
    from weftline.operators.ranking import dense_ids

    s = table(spark, d, "supplier").select(F.lit(1).alias("src"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    c = table(spark, d, "customer").select(F.lit(2).alias("src"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return dense_ids(s.unionByName(c), ["src", "key"])


@query("""SELECT person_id, name, gender FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY recorded_at, deleted_at NULLS FIRST) AS r FROM person) WHERE r = 1""")
def keep_first(spark, d):
    return sampling.first_rows(table(spark, d, "person"), ["person_id"], ["recorded_at", F.col("deleted_at").asc_nulls_first()]).select("person_id", "name", "gender")


@query("""WITH n AS (SELECT row_number() OVER (ORDER BY p_brand) AS id, p_brand FROM (SELECT DISTINCT p_brand FROM part))
SELECT p_partkey, n.id AS brand_id FROM part JOIN n USING (p_brand)""")
def dictionary_encode(spark, d):
    from weftline.operators.ranking import dense_ids

    part = table(spark, d, "part").select("p_partkey", "p_brand")
    words = dense_ids(part.select("p_brand").distinct(), ["p_brand"], "brand_id")
    return part.join(words, "p_brand").select("p_partkey", "brand_id")


# ---- scalars


@query("""SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, isodow(o_orderdate) - 1 AS weekday, strftime(o_orderdate + INTERVAL 45 DAY, '%Y-%m-%d') AS later,
strftime(o_orderdate - INTERVAL 3 MONTH, '%Y-%m-%d') AS months_ago, strftime(o_orderdate, '%-d %B %Y') AS long_date FROM orders""")
def date_parts(spark, d):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, d, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.weekday("o_orderdate").alias("weekday"),
        S.offset_date(iso, 45).alias("later"), S.months_before(iso, 3).alias("months_ago"), S.long_date(iso).alias("long_date"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0""")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k")).filter("k % 2 = 0")


@query("""SELECT p_partkey, CAST(('0x' || substr(md5(p_name), 1, 8)) AS BIGINT) % 16 + 1 AS bucket FROM part""")
def md5_bucket(spark, d):
    return table(spark, d, "part").select("p_partkey", S.md5_bucket(F.col("p_name"), 16).cast("bigint").alias("bucket"))


@query("""SELECT o_orderkey, round((((o_orderkey & 4294967295) * 2654435761) & 4294967295) / 4294967296.0::DOUBLE, 10) AS u FROM orders""")
def knuth_hash(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(S.knuth_uniform(F.col("o_orderkey")), 10).alias("u"))


@query("""SELECT p_partkey, TRY_CAST(p_size || '.7' AS DOUBLE)::BIGINT AS ignored, trunc(TRY_CAST(p_size || '.7' AS DOUBLE))::BIGINT AS whole, TRY_CAST(p_name AS DOUBLE) AS none FROM part""".replace("TRY_CAST(p_size || '.7' AS DOUBLE)::BIGINT AS ignored, ", ""))
def lenient_cast(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", S.lenient_int(F.concat(F.col("p_size").cast("string"), F.lit(".7"))).alias("whole"), S.lenient_double(F.col("p_name")).alias("none"))


_SOUND = """(SELECT left(x, 1) || left(replace(array_to_string(list_filter(string_split(y, ''), lambda z, i: i = 1 OR z <> string_split(y, '')[i - 1]), '')[2:], '0', ''), {n})
FROM (SELECT x, regexp_replace(translate(x, 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000000'), '[^0-6]', '0', 'g') AS y
 FROM (SELECT regexp_replace(upper({t}), '[^\\p{{L}}]', '', 'g') AS x)))"""


@query("""WITH p AS (SELECT DISTINCT person_id, name FROM person WHERE name IS NOT NULL),
n AS (SELECT person_id, trim(regexp_replace(translate(name, '‘’“”`', concat(chr(39), chr(39), chr(34), chr(34), chr(39))), '\\s+', ' ', 'g')) AS t FROM p),
f AS (SELECT person_id, CASE WHEN contains(t, ',') THEN trim(split_part(t, ',', 1)) ELSE string_split(t, ' ')[-1] END AS l,
 CASE WHEN contains(t, ',') THEN trim(t[instr(t, ',') + 1:]) ELSE array_to_string(string_split(t, ' ')[:-2], ' ') END AS f FROM n)
SELECT person_id, """ + _SOUND.format(t="l", n=3) + " AS surname_code, " + _SOUND.format(t="l || ' ' || f", n=4) + " AS name_code FROM f")
def soundex5(spark, d):
    """Phonetic codes of the last names of people."""
    name = S.first_last(S.normalize_name(F.col("name")))
    people = table(spark, d, "person").filter("name IS NOT NULL").select("person_id", "name").distinct()
    return people.select("person_id", S.phonetic_code(name["last"], 4).alias("surname_code"), S.phonetic_code(F.concat_ws(" ", name["last"], name["first"])).alias("name_code"))


#: Tasks at least, where pairs are made of a small table.
_PAIR_TASKS = 96


@query("""SELECT x.p_partkey AS a, y.p_partkey AS b, bit_count((x.p_size * 37) & (y.p_size * 37)) / nullif(bit_count((x.p_size * 37) | (y.p_size * 37)), 0)::DOUBLE AS score
FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_type = y.p_type AND x.p_partkey < y.p_partkey""")
def bit_jaccard(spark, d):
    """The pairs are many and the table small, so tasks are made by number and not by the bytes they read, which would give a few."""
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", (F.col("p_size") * 37).alias("bits"))
    tasks, slices = max(_PAIR_TASKS, parallelism(spark)), 8
    same = ["p_brand", "p_type", "slice"]
    x = part.withColumn("slice", F.pmod(F.xxhash64("p_partkey"), F.lit(slices)).cast("int")).repartition(tasks, *same).alias("x")
    y = part.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(tasks, *same).alias("y")
    pairs = x.join(y, (F.col("x.p_brand") == F.col("y.p_brand")) & (F.col("x.p_type") == F.col("y.p_type")) & (F.col("x.slice") == F.col("y.slice")) & (F.col("x.p_partkey") < F.col("y.p_partkey")))
    return pairs.select(F.col("x.p_partkey").alias("a"), F.col("y.p_partkey").alias("b"), S.bit_jaccard(F.col("x.bits"), F.col("y.bits")).alias("score"))


@query("""SELECT p_partkey, '$' || format('{:,}', CAST(round(p_retailprice) AS BIGINT)) AS price, upper(left(p_name, 3)) AS head, length(p_name) AS n, replace(p_type, ' ', '_') AS kind FROM part""")
def text_formats(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", S.money(F.round("p_retailprice")).alias("price"), F.upper(F.left("p_name", F.lit(3))).alias("head"), F.length("p_name").cast("bigint").alias("n"),
        F.replace("p_type", F.lit(" "), F.lit("_")).alias("kind"))


@query("""SELECT 'o_orderstatus' AS column_name, count(*) AS n_rows, count_if(o_orderstatus IS NULL) AS n_null, count_if(trim(o_orderstatus) = '') AS n_empty, count_if(length(o_orderstatus) > 255) AS n_long,
count(DISTINCT o_orderstatus) AS n_distinct, count(*) - count_if(o_orderstatus IS NULL) - count(DISTINCT o_orderstatus) AS n_repeated FROM orders UNION ALL
SELECT 'o_orderpriority', count(*), count_if(o_orderpriority IS NULL), count_if(trim(o_orderpriority) = ''), count_if(length(o_orderpriority) > 255),
count(DISTINCT o_orderpriority), count(*) - count_if(o_orderpriority IS NULL) - count(DISTINCT o_orderpriority) FROM orders""")
def audit_nulls(spark, d):
    return statistics.column_profile(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("""SELECT lower(trim(gender)) AS value, count(*) AS n FROM person WHERE gender IS NOT NULL AND lower(trim(gender)) NOT IN ('male', 'female', 'nonbinary') GROUP BY 1""")
def audit_vocab(spark, d):
    people = table(spark, d, "person").filter("gender IS NOT NULL").select(clean_label(F.col("gender")).alias("value"))
    return people.filter(~F.col("value").isin("male", "female", "nonbinary")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
