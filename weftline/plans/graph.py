"""Queries over the temporal graph and ordered rows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators import graph, joins, sampling, sequences
from weftline.operators.references import COMPANY_TO_COMPANY, COMPANY_TO_PERSON
from weftline.plans.relational import _CASTS, _KIND, _VERSIONS, casts, versions
from weftline.session import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- ordered rows


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS nth,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS again FROM lineitem""")
def cumcount(spark: SparkSession, d: str) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    got = sequences.numbered(table(spark, d, "lineitem"), ["l_orderkey"], order)
    return got.select("l_orderkey", "l_linenumber", "nth", (F.col("nth") + 1).alias("again"))


@query("""SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS predecessor FROM orders""")
def lag_predecessor(spark, d):
    return sequences.predecessor(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey", "predecessor").select("o_custkey", "o_orderkey", "predecessor")


@query("""WITH s AS (SELECT l_suppkey AS k, date_trunc('month', l_shipdate) AS m, list_distinct(list(l_partkey)) AS s FROM lineitem GROUP BY ALL),
p AS (SELECT k, m, s, lag(s) OVER (PARTITION BY k ORDER BY m) AS b FROM s)
SELECT k, strftime(m, '%Y-%m') AS month, round(len(list_intersect(s, b))::DOUBLE / len(list_distinct(list_concat(s, b))), 8) AS score FROM p WHERE b IS NOT NULL""")
def jaccard_drift(spark, d):
    """Likeness of the parts a supplier ships in a month to those of its month before."""
    sets = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.collect_set("l_partkey").alias("s"))
    return sequences.set_drift(sets, "k", "month", "s").select("k", "month", F.round("score", 8).alias("score"))


@query("""SELECT o_orderkey, round(CASE WHEN count(*) OVER g = 1 THEN 0.525 ELSE 0.1 + (row_number() OVER w - 1) / (count(*) OVER g - 1)::DOUBLE * 0.85 END, 8) AS weight
FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice, o_orderkey), g AS (PARTITION BY o_custkey, o_orderstatus)""")
def percent_rank_calibrate(spark, d):
    got = sequences.calibrated_rank(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], ["o_totalprice", "o_orderkey"], 0.1, 0.95, "weight")
    return got.select("o_orderkey", F.round("weight", 8).alias("weight"))


@query("""SELECT o_custkey, o_orderkey, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3""")
def topn_rank(spark, d):
    return sequences.top_rows(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rank")


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS total FROM orders""")
def running_total(spark, d):
    got = sequences.running_sum(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "total")
    return got.select("o_orderkey", F.round("total", 2).alias("total"))


_DAYS = """SELECT event_type AS k, datediff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) + 1 AS day, strftime(ts, '%Y-%m-%d') AS date, value FROM events"""


@query(f"""SELECT k, CAST((day - 1) // 7 + 1 AS INT) AS week_no, min(date) AS week_start, round(sum(value), 4) AS value FROM ({_DAYS}) GROUP BY ALL""")
def weekly_rollup(spark, d):
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1
    days = table(spark, d, "events").select(F.col("event_type").alias("k"), day.alias("day"), F.date_format("ts", "yyyy-MM-dd").alias("date"), "value")
    return sequences.weekly(days, "k", "day", "date", ["value"]).withColumn("value", F.round("value", 4))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
SELECT o_custkey, o_orderkey, round(o_totalprice * 100 / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM r WHERE r <= 4""")
def share_renormalise(spark, d):
    got = sequences.renormalized_share(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], "o_totalprice", 4)
    return got.select("o_custkey", "o_orderkey", F.round("share", 6).alias("share"))


@query(f"""WITH y AS (SELECT person, year, count(*) AS n FROM ({_CASTS}) GROUP BY ALL)
SELECT a.person, a.year, round(sum(pow(0.8, a.year - b.year)), 6) AS load FROM y a JOIN y b ON a.person = b.person AND b.year BETWEEN a.year - 5 AND a.year GROUP BY ALL""")
def decayed_load(spark, d):
    """Work load of a person by the years they had films in, fading with age."""
    years = casts(spark, d).groupBy("person", "year").agg(F.count(F.lit(1)).alias("n"))
    return sequences.decayed_load(years, ["person"], "year", 0.8, 5).select("person", "year", F.round("load", 6).alias("load"))


@query(f"""WITH y AS (SELECT person, year, count(*)::DOUBLE AS n FROM ({_CASTS}) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY year) AS i FROM y)
SELECT a.person, a.year, round(greatest(0, least(5, sum(b.n * pow(0.7, a.i - b.i)) / sum(pow(0.7, a.i - b.i)))), 6) AS momentum
FROM r a JOIN r b ON a.person = b.person AND b.i BETWEEN a.i - 31 AND a.i GROUP BY ALL""")
def decayed_momentum(spark, d):
    years = casts(spark, d).groupBy("person", "year").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return sequences.decayed_mean(years, ["person"], ["year"], "n", 0.7, 32, 0.0, 5.0).select("person", "year", F.round("momentum", 6).alias("momentum"))


@query("""WITH RECURSIVE t AS (SELECT event_type AS k, CAST(strftime(ts, '%Y%m%d') AS INT) AS day, sum(value) AS s FROM events GROUP BY ALL),
y AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY day) AS i FROM t),
f AS (SELECT k, day, i, s::DOUBLE AS state FROM y WHERE i = 1 UNION ALL SELECT y.k, y.day, y.i, 0.72 * f.state + y.s FROM f JOIN y ON y.k = f.k AND y.i = f.i + 1)
SELECT k, day, round(state, 4) AS state FROM f""")
def stateful_regime(spark, d):
    """Smoothed state of each event type from day to day."""
    days = table(spark, d, "events").groupBy(F.col("event_type").alias("k"), F.date_format("ts", "yyyyMMdd").cast("int").alias("day")).agg(F.sum("value").alias("s"))
    return sequences.smoothed(days, "k", "day", "s", 0.72).withColumn("state", F.round("state", 4))


@query(f"""WITH RECURSIVE n AS (SELECT person, title_id, year, row_number() OVER (PARTITION BY person ORDER BY title_id, year) AS k FROM ({_CASTS})),
s AS (SELECT person, title_id, year, k, year AS spaced FROM n WHERE k = 1 UNION ALL
SELECT n.person, n.title_id, n.year, n.k, greatest(n.year, s.spaced + 2) FROM s JOIN n ON n.person = s.person AND n.k = s.k + 1) SELECT person, title_id, year, spaced FROM s""")
def min_gap_years(spark, d):
    """Years of a person's films moved at least two years apart."""
    films = casts(spark, d)
    return sequences.spaced_years(films, "person", "title_id", "year", 2)


# ---- sampling


@query("""WITH h AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS h,
 CAST('0x' || substr(md5('42|' || c_custkey), 1, 12) AS BIGINT) / pow(16, 12) AS u FROM customer),
e AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY (h <= 7) DESC, u, c_custkey) AS r FROM h)
SELECT c_nationkey, c_custkey, CASE WHEN h <= 7 THEN 'weight' ELSE 'draw' END AS chosen_by FROM e WHERE r <= 10""")
def bounded_topk_explore(spark, d):
    return sampling.top_and_explore(table(spark, d, "customer"), ["c_nationkey"], "c_acctbal", "c_custkey", 10).select("c_nationkey", "c_custkey", "chosen_by")


@query("""WITH s AS (SELECT p_brand, count(*) AS n, count(*) * 500.0::DOUBLE / (SELECT count(*) FROM part) AS e FROM part GROUP BY 1),
q AS (SELECT p_brand, floor(e) + (row_number() OVER (ORDER BY e - floor(e) DESC, p_brand) <= 500 - sum(floor(e)) OVER ())::INT AS quota, n FROM s),
r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY CAST('0x' || substr(md5('42|' || p_partkey), 1, 12) AS BIGINT) / pow(16, 12), p_partkey) AS r FROM part)
SELECT p_partkey, r.p_brand FROM r JOIN q ON r.p_brand = q.p_brand WHERE r.r <= least(n, quota)""")
def quota_sample(spark, d):
    """500 parts split over the brands by size; the quota is the feature."""
    return sampling.quota_sample(table(spark, d, "part"), "p_brand", "p_partkey", 500).select("p_partkey", "p_brand")


@query("""WITH w AS (SELECT p_partkey, p_brand, -ln(greatest(CAST('0x' || substr(md5('42|' || p_partkey), 1, 12) AS BIGINT) / pow(16, 12), 1e-12)) / p_retailprice AS k FROM part WHERE p_retailprice > 0)
SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY k, p_partkey) AS r FROM w) WHERE r <= 5""")
def weighted_draw(spark, d):
    return sampling.weighted_draw(table(spark, d, "part"), ["p_brand"], "p_retailprice", "p_partkey", 5).select("p_brand", "p_partkey")


@query(f"""WITH f AS (SELECT row_id, kind, kind IN ('rivalry', 'avoid', 'blacklist', 'market_rival') AS neg FROM ({_VERSIONS})),
c AS (SELECT count_if(neg) AS nf, count_if(NOT neg) AS nu FROM f), l AS (SELECT least(nf, floor(nu * 0.1 / 0.9)) AS mf, least(nu, floor(nf * 0.95 / 0.05)) AS mu FROM c)
SELECT row_id, kind FROM (SELECT f.*, row_number() OVER (PARTITION BY neg ORDER BY row_id) AS r FROM f) CROSS JOIN l WHERE r <= CASE WHEN neg THEN mf ELSE mu END""")
def negative_share_band(spark, d):
    """The share of negative versions held between 5 and 10 %."""
    v = versions(spark, d).select("row_id", "kind")
    return sampling.share_band(v, F.col("kind").isin(*graph.NEGATIVE), ["row_id"], 0.05, 0.10)


# ---- the graph


@query(f"""SELECT row_id, kind, src, dst FROM ({_VERSIONS}) WHERE vf <= 2012 AND (vt IS NULL OR (CASE WHEN retired THEN 2012 < vt ELSE 2012 <= vt END))""")
def scd2_asof(spark, d):
    return graph.as_of(versions(spark, d), 2012, "never").select("row_id", "kind", "src", "dst")


@query("""SELECT user_id, event_type AS state, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM
(SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type""")
def scd2_history(spark, d):
    """Versions of each user's state from an event log."""
    before = sequences.predecessor(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", "before")
    changes = before.filter(F.col("before").isNull() | (F.col("before") != F.col("event_type")))
    from pyspark.sql import Window

    nxt = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return changes.select("user_id", F.col("event_type").alias("state"), F.col("ts").alias("valid_from"), nxt.alias("valid_to"))


def _batch(spark, d):
    """One change per pair of collaborators and one per friendship, in a fixed order."""
    v = graph.canonical(versions(spark, d)).filter("kind IN ('friendship', 'collaboration')")
    once = v.groupBy("kind", "src", "dst").agg(F.min("row_id").alias("seq"))
    mode = F.when(F.col("kind") == "friendship", "update").when(F.col("seq") % 2 == 0, "add").otherwise("expire")
    return v, once.select("seq", mode.alias("mode"), "kind", "src", "dst", F.lit(0.5).alias("weight"), F.lit(0.3).alias("delta"), F.lit(2015).alias("year"))


_BATCH = f"""WITH v AS (SELECT row_id, kind, least(src, dst) AS src, greatest(src, dst) AS dst, w::DOUBLE AS w, vf, vt, retired FROM ({_VERSIONS}) WHERE kind IN ('friendship', 'collaboration')),
o AS (SELECT kind, src, dst, min(row_id) AS seq FROM v GROUP BY ALL), m AS (SELECT *, CASE WHEN kind = 'friendship' THEN 'update' WHEN seq % 2 = 0 THEN 'add' ELSE 'expire' END AS mode FROM o),
x AS (SELECT m.*, count(CASE WHEN v.vt IS NULL OR CASE WHEN v.retired THEN 2015 < v.vt ELSE 2015 <= v.vt END THEN 1 END) AS live,
 count(CASE WHEN (v.vf IS NULL OR v.vf <= 2015) AND (v.vt IS NULL OR CASE WHEN v.retired THEN 2015 < v.vt ELSE 2015 <= v.vt END) THEN 1 END) AS begun
 FROM m JOIN v USING (kind, src, dst) GROUP BY ALL)"""


@query(_BATCH + """ SELECT mode, CASE WHEN mode = 'add' THEN CASE WHEN begun > 0 THEN 'skipped' ELSE 'applied' END WHEN live > 0 THEN 'applied' ELSE 'skipped' END AS status, count(*) AS n FROM x GROUP BY ALL""")
def edge_batch_apply(spark, d):
    v, ops = _batch(spark, d)
    _, log = graph.apply_batch(v, ops)
    return ops.join(log, "seq").groupBy("mode", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH a AS (SELECT DISTINCT src, dst, w FROM ({_VERSIONS}) WHERE kind = 'friendship' AND (vf IS NULL OR vf <= 2010) AND (vt IS NULL OR CASE WHEN retired THEN 2010 < vt ELSE 2010 <= vt END)),
n AS (SELECT src AS v, dst AS w, w AS weight FROM a UNION SELECT dst, src, w FROM a) SELECT v, count(*) AS n, count(DISTINCT w) AS others FROM n GROUP BY v""")
def neighbours_asof(spark, d):
    return graph.neighbours(versions(spark, d), "friendship", 2010).groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("w").alias("others"))


@query(f"""WITH m AS (SELECT person FROM ({_CASTS}) GROUP BY person HAVING count(*) >= 20) SELECT row_id, src, dst FROM ({_VERSIONS}) WHERE src IN (FROM m) AND dst IN (FROM m)""")
def induced_subgraph(spark, d):
    busy = casts(spark, d).groupBy(F.col("person").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 20")
    return graph.induced(versions(spark, d), busy).select("row_id", "src", "dst")


@query(f"""WITH f AS ({_KIND.format(v=_VERSIONS, k='chemistry')}), n AS (SELECT src AS v, dst AS w FROM f UNION ALL SELECT dst, src FROM f)
SELECT x.w AS src, y.w AS dst, count(*) AS n_via FROM n x JOIN n y ON x.v = y.v AND x.w < y.w WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.src = x.w AND f.dst = y.w) GROUP BY ALL""")
def transitive_pairs(spark, d):
    """Over chemistry, as in its SQL; :func:`transitive_friends` is over friendship."""
    return graph.transitive_pairs(joins.undirected(versions(spark, d).filter("kind = 'chemistry'")))


@query(f"""WITH f AS ({_KIND.format(v=_VERSIONS, k='friendship')}), n AS (SELECT src AS v, dst AS w FROM f UNION ALL SELECT dst, src FROM f)
SELECT x.w AS src, y.w AS dst, count(*) AS n_via FROM n x JOIN n y ON x.v = y.v AND x.w < y.w WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.src = x.w AND f.dst = y.w) GROUP BY ALL""")
def transitive_friends(spark, d):
    return graph.transitive_pairs(joins.undirected(versions(spark, d).filter("kind = 'friendship'")))


@query("""WITH t AS (SELECT DISTINCT id, tag FROM (SELECT person_id AS id, trim(unnest(regexp_split_to_array(style_tags, '[;,|]'))) AS tag FROM person) WHERE tag <> ''),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY id) AS r FROM t) WHERE r <= 200)
SELECT x.id AS a, y.id AS b, count(*) AS n_shared FROM k x JOIN k y ON x.tag = y.tag AND x.id < y.id GROUP BY ALL HAVING count(*) >= 2""")
def tag_similarity(spark, d):
    people = table(spark, d, "person").groupBy(F.col("person_id").alias("id")).agg(F.flatten(F.collect_set(S.split_list(F.col("style_tags")))).alias("tags"))
    return graph.shared_tag_pairs(people, 2)


@query(f"""WITH v AS (SELECT row_id, kind, least(src, dst) AS a, greatest(src, dst) AS b FROM ({_VERSIONS}))
SELECT row_id FROM v WHERE kind = 'friendship' AND (a, b) IN (SELECT (a, b) FROM v WHERE kind = 'rivalry')""")
def contradiction_flag(spark, d):
    return graph.contradicted(versions(spark, d)).select("row_id")


@query(f"""WITH g AS (SELECT v, count(*) AS n FROM (SELECT src AS v FROM ({_VERSIONS}) UNION ALL SELECT dst FROM ({_VERSIONS})) WHERE v IS NOT NULL GROUP BY v)
SELECT count(*) AS vertices, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75, quantile_cont(n, 0.9) AS q90, quantile_cont(n, 0.99) AS q99, max(n) AS most FROM g""")
def degree_percentiles(spark, d):
    g = graph.degrees(versions(spark, d)).filter("v IS NOT NULL")
    q = lambda p: F.percentile("degree", p)
    return g.agg(F.count(F.lit(1)).alias("vertices"), q(0.5).alias("q50"), q(0.75).alias("q75"), q(0.9).alias("q90"), q(0.99).alias("q99"), F.max("degree").alias("most"))


#: The least vertex that reaches each vertex; a label is kept once for each vertex.
_COMPONENTS = f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({_VERSIONS}) WHERE src <> dst AND kind NOT IN (
 'brand_fit', 'employment', 'blacklist', 'exclusive_deal', 'co_production', 'market_rival', 'subsidiary')),
u AS (SELECT src AS v, dst AS w FROM e UNION SELECT dst, src FROM e),
c(v, component) USING KEY (v) AS (SELECT v, min(w) FROM (SELECT v, w FROM u UNION ALL SELECT v, v FROM u) GROUP BY v
 UNION SELECT u.v, min(c.component) FROM c JOIN u ON u.w = c.v JOIN recurring.c AS r ON r.v = u.v WHERE c.component < r.component GROUP BY u.v)"""


@query(_COMPONENTS + " SELECT count(*) AS vertices, count(DISTINCT component) AS components, max(n) AS largest, round(max(n)::DOUBLE / count(*), 8) AS share FROM (SELECT *, count(*) OVER (PARTITION BY component) AS n FROM c)")
def component_share(spark, d):
    """Share of the vertices that are in the largest connected group."""
    sizes = components(spark, d).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    got = sizes.agg(F.sum("n").alias("vertices"), F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"))
    return got.withColumn("share", F.round(F.try_divide("largest", "vertices"), 8))


@query(_COMPONENTS + " SELECT v, component FROM c")
def components(spark, d):
    """Connected groups over the edges of all kinds that join people.

    Ends without a person's record are vertices too.
    """
    others = (*COMPANY_TO_PERSON, *COMPANY_TO_COMPANY)
    return graph.components(joins.undirected(versions(spark, d).filter(~F.col("kind").isin(*others))))


@query(None)
def label_propagation(spark, d):
    """Communities of friends; a pair weighs as much as its strongest version, and one without a weight 0.5."""
    friends = graph.canonical(versions(spark, d)).filter("kind = 'friendship' AND src <> dst")
    weight = F.coalesce(F.max("w").cast("decimal(9,6)"), F.lit(0.5).cast("decimal(9,6)"))
    return graph.label_propagation(friends.groupBy("src", "dst").agg(weight.alias("weight")))


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS a, e.vec_id AS b, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS c
FROM q JOIN embeddings e ON q.vec_id <> e.vec_id) SELECT a, b, round(c, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM s) WHERE r <= 5""")
def vector_topk(spark, d):
    """Five nearest rows of each query row (every row whose id is divisible by 20) by exact cosine, queries in blocks."""
    return _vector_topk(table(spark, d, "embeddings"), 5)


def _vector_topk(vectors: DataFrame, keep: int, block: int = 2_000) -> DataFrame:
    """Exact search of a stated query set against all rows.

    The queries are sent to the tasks in blocks of bounded size; each task keeps the
    best of its rows for each query, and the best of these are chosen at the end.
    """
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql import Window

    queries = vectors.filter("vec_id % 20 = 0").select("vec_id", "embedding")
    blocks = max(1, -(-queries.count() // block))
    out = None
    for n in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).collect()  # about one block
        ids, embeddings = [r["vec_id"] for r in rows], [list(r["embedding"]) for r in rows]

        def nearest(parts: Iterator[pd.DataFrame], ids=ids, embeddings=embeddings) -> Iterator[pd.DataFrame]:
            import numpy as np

            q = np.asarray(embeddings, np.float64)
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            for part in parts:
                if not len(part) or not len(ids):
                    continue
                e = np.asarray(part["embedding"].tolist(), np.float64)
                scores = q @ (e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-300)).T
                mine = part["vec_id"].to_numpy()
                scores[np.asarray(ids)[:, None] == mine[None, :]] = -2
                order = np.lexsort((np.broadcast_to(mine, scores.shape), -scores), axis=1)[:, :keep]
                found = pd.DataFrame({"a": np.repeat(ids, order.shape[1]), "b": mine[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel()})
                yield found[found["score"] > -1.5]

        one = vectors.select("vec_id", "embedding").mapInPandas(nearest, "a long, b long, score double")
        out = one if out is None else out.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return out.withColumn("_r", rank).filter(F.col("_r") <= keep).select("a", "b", F.round("score", 4).alias("score"))


@query(f"""WITH v AS (SELECT row_number() OVER (ORDER BY row_id) AS seq, kind, least(src, dst) AS a, greatest(src, dst) AS b, w::DOUBLE AS w, vf, vt, row_id FROM ({_VERSIONS}) WHERE kind = 'friendship'),
f AS (SELECT *, first_value(seq) OVER (PARTITION BY a, b ORDER BY w DESC NULLS LAST, seq) AS kept FROM v)
SELECT a AS src, b AS dst, round(max(w), 6) AS w, max(vf) AS vf, min(vt) AS vt FROM f WHERE seq >= kept GROUP BY ALL""")
def dedupe_strongest(spark, d):
    """The strongest version of each friendship, its validity cut by those after it."""
    v = graph.canonical(versions(spark, d)).filter("kind = 'friendship'")
    kept = sequences.strongest_with_validity(v.withColumn("w", F.col("w").cast("double")), ["src", "dst"], "row_id", "w", "vf", "vt")
    return kept.select("src", "dst", F.round("w", 6).alias("w"), "vf", "vt")


# ---- more of the graph


_ACTIVE = "(vf IS NULL OR vf <= {y}) AND (vt IS NULL OR CASE WHEN retired THEN {y} < vt ELSE {y} <= vt END)"
_UNIFORM = "CAST('0x' || substr(md5({k}), 1, 12) AS BIGINT) / pow(16, 12)"


@query(f"""SELECT kind, count(*) AS n FROM ({_VERSIONS}) WHERE {_ACTIVE.format(y=2012)} AND {_UNIFORM.format(k="'42|' || row_id || '|2012'")} < 0.3 + 0.7 * coalesce(w, 0) GROUP BY kind""")
def soft_activation(spark, d):
    v = versions(spark, d).withColumn("w", F.col("w").cast("double"))
    return v.filter(graph.soft_active(2012)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH a AS (SELECT row_id, kind, {_UNIFORM.format(k="'7|' || row_id")} AS u FROM ({_VERSIONS}) WHERE {_ACTIVE.format(y=2015)})
SELECT kind, row_id FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY u, row_id) AS r FROM a) WHERE r <= 25""")
def family_sample(spark, d):
    """25 active versions of each kind, drawn by hash; the sample is the feature."""
    now = graph.as_of(versions(spark, d), 2015)
    return sampling.capped(now, ["kind"], [S.key_uniform(7, F.col("row_id")), "row_id"], 25).select("kind", "row_id")


@query(f"""WITH a AS (SELECT DISTINCT src, dst, w FROM ({_VERSIONS}) WHERE kind = 'friendship' AND {_ACTIVE.format(y=2010)}),
n AS (SELECT src AS v, dst AS o, w FROM a UNION SELECT dst, src, w FROM a), b AS (SELECT v, o, max(coalesce(w, 0)) AS w FROM n GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY w DESC, o) AS h, {_UNIFORM.format(k="'42|' || o")} AS u FROM b)
SELECT v, o FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY (h <= 4) DESC, u, o) AS r FROM h) WHERE r <= 6""")
def frontier_sample(spark, d):
    """Up to six friends of each person: the four closest and others drawn."""
    near = graph.neighbours(versions(spark, d), "friendship", 2010).groupBy("v", F.col("w").alias("o")).agg(F.max(F.coalesce("weight", F.lit(0.0))).alias("w"))
    return sampling.top_and_explore(near, ["v"], "w", "o", 6).select("v", "o")


@query(f"""WITH f AS ({_KIND.format(v=_VERSIONS, k='clique')}), n AS (SELECT src AS v, dst AS w FROM f UNION ALL SELECT dst, src FROM f),
m AS (SELECT x.w AS src, y.w AS dst, count(*) AS n_via FROM n x JOIN n y ON x.v = y.v AND x.w < y.w WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.src = x.w AND f.dst = y.w) GROUP BY ALL)
SELECT src, dst, n_via FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n_via DESC, dst) AS r FROM m WHERE {_UNIFORM.format(k="'42|' || src || '|' || dst")} < 0.4) WHERE r <= 8""")
def triadic_closure(spark, d):
    """Over cliques, as in its SQL; :func:`friend_closure` is over friendship."""
    return graph.triadic_closure(joins.undirected(versions(spark, d).filter("kind = 'clique'")), 0.4).select("src", "dst", "n_via")


@query(f"""WITH f AS ({_KIND.format(v=_VERSIONS, k='friendship')}), n AS (SELECT src AS v, dst AS w FROM f UNION ALL SELECT dst, src FROM f),
m AS (SELECT x.w AS src, y.w AS dst, count(*) AS n_via FROM n x JOIN n y ON x.v = y.v AND x.w < y.w WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.src = x.w AND f.dst = y.w) GROUP BY ALL)
SELECT src, dst, n_via FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n_via DESC, dst) AS r FROM m WHERE {_UNIFORM.format(k="'42|' || src || '|' || dst")} < 0.4) WHERE r <= 8""")
def friend_closure(spark, d):
    return graph.triadic_closure(joins.undirected(versions(spark, d).filter("kind = 'friendship'")), 0.4).select("src", "dst", "n_via")


@query(f"""WITH p AS (SELECT x.person AS a, y.person AS b, count(*) AS n FROM ({_CASTS}) x JOIN ({_CASTS}) y ON x.title_id = y.title_id AND x.person < y.person GROUP BY ALL HAVING count(*) >= 3),
f AS ({_KIND.format(v=_VERSIONS, k='collaboration')})
SELECT a, b, n, CASE WHEN n >= 10 THEN 0.40 WHEN n >= 4 THEN 0.25 ELSE 0.15 END::DOUBLE AS weight FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.src = a AND f.dst = b)""")
def coappearance_edges(spark, d):
    """Pairs of a cast that meet often and aren't linked yet, with a weight by how often."""
    from weftline.operators.reshape import collaborations

    credits = casts(spark, d).select(F.col("title_id").alias("film"), "person", F.col("person").alias("nth"), "year")
    met = collaborations(credits, billed=1_000, least=3)
    linked = joins.undirected(versions(spark, d).filter("kind = 'collaboration'")).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    weight = F.when(F.col("n") >= 10, 0.40).when(F.col("n") >= 4, 0.25).otherwise(0.15)
    return met.join(linked, ["a", "b"], "left_anti").select("a", "b", "n", weight.alias("weight"))


@query("""WITH p AS (SELECT person_id AS id, min(cand_community) AS c FROM person LEFT JOIN (SELECT pid, max(cand_community) AS cand_community FROM cast_year_cache WHERE cand_community >= 0 GROUP BY pid) ON pid = person_id GROUP BY 1),
k AS (SELECT row_number() OVER (ORDER BY c) - 1 AS nth, c AS community FROM (SELECT DISTINCT c FROM p WHERE c IS NOT NULL)), n AS (SELECT count(*) AS n FROM k)
SELECT p.id, coalesce(p.c, k.community) AS community FROM p CROSS JOIN n LEFT JOIN k ON p.c IS NULL AND k.nth = CAST('0x' || substr(md5(p.id::VARCHAR), 1, 8) AS BIGINT) % n.n""")
def community_fill(spark, d):
    """People without a community get one of those there are, by the hash of their id."""
    from weftline.operators.ranking import dense_ids

    known = table(spark, d, "cast_year_cache").filter("cand_community >= 0").groupBy(F.col("pid").alias("id")).agg(F.max("cand_community").alias("community"))
    people = table(spark, d, "person").select(F.col("person_id").alias("id")).distinct().join(known, "id", "left")
    names = dense_ids(people.filter("community IS NOT NULL").select("community").distinct(), ["community"], "nth", 0)
    return graph.fill_community(people, names)


@query(f"""SELECT kind, count(*) AS n, round(avg(w), 5) AS mean_weight, count_if(kind IN ('rivalry', 'avoid', 'blacklist', 'market_rival')) AS negative,
count(DISTINCT src) AS sources, round(count(*)::DOUBLE / (SELECT count(DISTINCT row_id) FROM edges), 6) AS share FROM ({_VERSIONS}) GROUP BY kind""")
def quality_summary(spark, d):
    from pyspark.sql import Window

    got = versions(spark, d).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("w").cast("double")), 5).alias("mean_weight"),
        F.count_if(F.col("kind").isin(*graph.NEGATIVE)).alias("negative"), F.countDistinct("src").alias("sources"),
    )
    return got.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query(f"""WITH c AS (SELECT DISTINCT company_id AS id FROM company WHERE tier = 'Global'), p AS (SELECT person AS id FROM ({_CASTS}) GROUP BY 1 HAVING count(*) >= 25)
SELECT DISTINCT src AS company, dst AS person, kind FROM ({_VERSIONS}) WHERE {_ACTIVE.format(y=2012)} AND kind IN ('employment', 'blacklist') AND src IN (FROM c) AND dst IN (FROM p)""")
def pair_probe(spark, d):
    """Which of the largest companies and the busiest people are linked; the other pairs of both lists are not.

    The links are probed with the lists, so the pairs of the lists are never made.
    """
    company = table(spark, d, "company").filter("tier = 'Global'").select(F.col("company_id").alias("company"))
    busy = casts(spark, d).groupBy(F.col("person")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 25")
    now = graph.as_of(versions(spark, d).filter("kind IN ('employment', 'blacklist')"), 2012)
    now = now.select(F.col("src").alias("company"), F.col("dst").alias("person"), "kind").distinct()
    return now.join(company, "company", "left_semi").join(busy, "person", "left_semi").select("company", "person", "kind")


@query("""WITH p AS (SELECT person_id AS id, max_by(debut_year, recorded_at) AS a, max_by(retirement_year, recorded_at) AS b FROM person WHERE debut_year IS NOT NULL GROUP BY 1),
c AS (SELECT DISTINCT row_id, src_id, dst_id, valid_from, valid_to FROM edges WHERE lower(trim(edge_type)) = 'friendship')
SELECT row_id, greatest(valid_from, x.a, y.a) AS vf, least(valid_to, x.b, y.b) AS vt FROM c JOIN p x ON x.id = src_id JOIN p y ON y.id = dst_id
WHERE least(valid_to, x.b, y.b) IS NULL OR greatest(valid_from, x.a, y.a) <= least(valid_to, x.b, y.b)""")
def validity_from_timelines(spark, d):
    """Friendships cut to the years in which both people worked; pairs that never did are left out."""
    people = table(spark, d, "person").filter("debut_year IS NOT NULL").groupBy(F.col("person_id").alias("id")).agg(
        F.max_by("debut_year", "recorded_at").alias("a"), F.max_by(F.coalesce("retirement_year", F.lit(-1)), "recorded_at").alias("b"))
    people = people.withColumn("b", F.when(F.col("b") >= 0, F.col("b")))
    v = versions(spark, d).filter("kind = 'friendship'")
    joined = v.join(people.select(F.col("id").alias("src"), F.col("a").alias("xa"), F.col("b").alias("xb")), "src").join(
        people.select(F.col("id").alias("dst"), F.col("a").alias("ya"), F.col("b").alias("yb")), "dst")
    cut = joined.select("row_id", F.greatest("vf", "xa", "ya").alias("vf"), F.least("vt", "xb", "yb").alias("vt"))
    return cut.filter("vt IS NULL OR vf <= vt")


@query("""WITH p AS (SELECT person_id AS id, list_sort(list_distinct(list_filter(flatten(list(list_transform(regexp_split_to_array(coalesce(style_tags, ''), '[;,|]'), lambda x: trim(x)))), lambda x: x <> ''))) AS tags,
 max(lower(trim(career_stage))) AS stage, max(nationality) AS nation, min(debut_year) AS debut FROM person GROUP BY 1)
SELECT a, b, score FROM (SELECT x.id AS a, y.id AS b, round(0.6 * CASE WHEN len(list_distinct(list_concat(x.tags, y.tags))) = 0 THEN 0 ELSE len(list_intersect(x.tags, y.tags))::DOUBLE / len(list_distinct(list_concat(x.tags, y.tags))) END
 + 0.4 * greatest(0, 1 - abs(x.debut - y.debut) / 50.0::DOUBLE), 6) AS score, row_number() OVER (PARTITION BY x.id ORDER BY round(0.6 * CASE WHEN len(list_distinct(list_concat(x.tags, y.tags))) = 0 THEN 0 ELSE len(list_intersect(x.tags, y.tags))::DOUBLE / len(list_distinct(list_concat(x.tags, y.tags))) END
 + 0.4 * greatest(0, 1 - abs(x.debut - y.debut) / 50.0::DOUBLE), 6) DESC, y.id) AS r
FROM p x JOIN p y ON x.stage = y.stage AND x.nation = y.nation AND x.debut = y.debut AND x.id <> y.id) WHERE r <= 3""")
def similar_people(spark, d):
    """Three most alike people of the same stage, nation and first year."""
    people = table(spark, d, "person").groupBy("person_id").agg(
        F.array_distinct(F.flatten(F.collect_list(S.split_list(F.coalesce("style_tags", F.lit("")))))).alias("tags"),
        F.max(F.lower(F.trim("career_stage"))).alias("stage"), F.max("nationality").alias("nation"), F.min("debut_year").alias("debut"))
    score = lambda x, y: F.round(0.6 * S.jaccard(x("tags"), y("tags")) + 0.4 * F.greatest(F.lit(0.0), 1 - F.abs(x("debut") - y("debut")) / 50.0), 6)
    return joins.block_scores(people, "person_id", ["stage", "nation", "debut"], score, 3)
