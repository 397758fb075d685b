"""Exported tables, made rows and readings of the graph: nulls, ties, empty tables and sums that have to hold."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import audit, export, graph, producers, qerror, reshape
from weftline.sources import loaders, writers


def test_credits(spark):
    actors = spark.createDataFrame([(1, 5, "Female", 2), (1, 4, None, 1), (None, 4, "m", 1), (1, 4, None, 1)], "movie_id long, person_id long, gender string, nr_order int")
    directors = spark.createDataFrame([(1, 9), (2, None)], "movie_id long, person_id long")
    crew = spark.createDataFrame([(1, 9, 7, 3, "cut")], "movie_id long, person_id long, role_id int, nr_order int, note string")
    got = export.credits(actors, directors, crew).orderBy("id").collect()
    assert [(r["id"], r["person_id"], r["role_id"], r["note"]) for r in got] == [(1, 4, 1, None), (2, 5, 2, None), (3, 9, 8, None), (4, 9, 7, "cut")]
    assert export.credits(actors.limit(0), directors.limit(0)).collect() == []


def test_attribute_rows(spark):
    df = spark.createDataFrame([(7, " DE ", "1999-03-05", None), (8, None, "soon", "premiere"), (9, "FR", "nan", None), (10, "FR", None, None)], "mid long, c string, d string, k string")
    got = {r["mid"]: (r["info"], r["note"]) for r in export.release_rows(df, "mid", F.col("c"), F.col("d"), F.col("k")).collect()}
    assert got[7][0] == "DE:5 March 1999" and got[8] == ("USA:soon", "(premiere)") and set(got) == {7, 8}
    films = spark.createDataFrame([(1, 5.0, 10), (2, 5.0, 10), (3, None, 4), (4, 9.0, None), (5, 1.0, 50)], "movie_id long, rating double, votes long")
    ranks = {(r["info_type_id"], r["info"]): r["movie_id"] for r in export.rating_rows(films, 2, 1, 0.2).filter("info_type_id > 101").collect()}
    assert ranks == {(112, "1"): 1, (112, "2"): 2, (113, "1"): 5}
    assert export.rating_rows(films.limit(0)).collect() == []


def test_names_and_completeness(spark):
    people = spark.createDataFrame([(i, n) for i, n in enumerate(["Ann-Mary Lee", "Cher", " ", None, "Bo  Ek"])], "person_id long, name string")
    got = export.name_variants(people, share=1.0, one=0.0).collect()
    assert {r["name"] for r in got if r["person_id"] == 1} == {"Cher Cher"} and {r["person_id"] for r in got} == {0, 1, 4}
    assert {r["name"] for r in got if r["person_id"] == 4} <= {"B. Ek", "Ek, Bo", "Bo E"}
    films = spark.createDataFrame([(1, "A", 5, 1), (2, None, None, None)], "movie_id long, tier string, n_cast int, n_crew int")
    rows = export.completeness(films).collect()
    assert {(r["movie_id"], r["subject_id"]) for r in rows} >= {(1, 1), (1, 2), (2, 1)} and {r["status_id"] for r in rows} <= {3, 4}


def test_risk(spark):
    df = spark.createDataFrame([(1, 3), (2, None), (3, 9), (4, 9)], "id long, x int")
    got = export.ranked_by_risk(df, {"big": (F.col("x") > 5, 1.5), "none": (F.col("x").isNull(), 1.0)}, ["id"])
    assert [(r["id"], r["risk"], r["place"]) for r in got.orderBy("place").collect()] == [(3, 1.5, 1), (4, 1.5, 2), (2, 1.0, 3), (1, 0.0, 4)]
    assert export.ranked_by_risk(df, {"big": (F.col("x") > 5, 1.5)}, ["id"], keep=1).collect()[0]["id"] == 3


VERSION = "row_id long, src long, dst long, kind string, w double, vf int, vt int, retired boolean"


def test_graph_readings(spark):
    v = spark.createDataFrame(
        [(1, 1, 2, "a", 0.1, 1990, 2000, False), (2, 1, 3, "a", 0.1, 2005, None, False), (3, 4, None, "b", 0.1, 2010, 2011, False), (4, 5, 5, None, None, None, None, None)], VERSION
    )
    got = {r["row_id"]: r["active"] for r in graph.active_or_all(v, 1995, ["kind"]).collect()}
    assert got == {1: True, 3: False}
    dead = graph.compacted(v.filter("kind IS NOT NULL"), ["kind"], F.coalesce(F.col("vt") < 2005, F.lit(False))).collect()
    assert {r["row_id"] for r in dead} == {2, 3}
    buckets = graph.bucketed(v, {"x": ("a",)}).collect()
    assert {(r["v"], r["n"], r["least"], r["most"]) for r in buckets} == {(1, 2, 2, 3), (2, 1, 1, 1), (3, 1, 1, 1)}
    events = spark.createDataFrame([(1, 1, "2020-01-01 00:00:00"), (1, 2, "2020-01-03 00:00:00"), (1, 3, "2020-01-03 00:00:00"), (2, 4, "2020-01-02 12:00:00"), (2, 5, None)], "k long, e long, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert {r["e"] for r in graph.recent(events, "k", "t", "e", 24, 1).collect()} == {3, 4}
    assert graph.recent(events.limit(0), "k", "t", "e", 24, 1).collect() == []


def test_sums_hold(spark):
    df = spark.createDataFrame([(1, 1000.4), (2, 3.0), (3, None), (4, float("nan")), (5, float("inf")), (6, -2.0), (7, 0.0)], "id long, v double")
    weeks = producers.weekly(df, "id", "v").groupBy("id").agg(F.sum("amount").alias("s"), F.min("amount").alias("least")).collect()
    assert {r["id"]: r["s"] for r in weeks} == {1: 1000, 2: 3} and min(r["least"] for r in weeks) >= 0
    counts = spark.createDataFrame([(1, 101), (2, 0), (3, None)], "id long, n long")
    cells = producers.crossed(counts, "id", "n", {"a": ["x", "y", "z"], "b": ["p", "q"]}).groupBy("id").agg(F.sum("n").alias("s"), F.count("a").alias("c")).collect()
    assert {r["id"]: (r["s"], r["c"]) for r in cells} == {1: (101, 6), 2: (0, 6)}
    ends = spark.createDataFrame([(1, "2020-05-01"), (2, "no"), (3, None)], "id long, d string")
    chain = producers.phases(ends, "id", "d", {"a": (1, 9), "b": (5, 5)}).orderBy("starts_on").collect()
    assert [r["phase"] for r in chain] == ["a", "b"] and chain[0]["ends_on"] == chain[1]["starts_on"] and str(chain[1]["ends_on"]) == "2020-05-01"
    assert (chain[1]["ends_on"] - chain[1]["starts_on"]).days == 5


def test_series_links_and_ratings(spark):
    df = spark.range(50).withColumnRenamed("id", "k").withColumn("n", F.col("k").cast("int"))
    nested = producers.series(df, "k").groupBy("k", "season").agg(F.max("episode").alias("m"), F.count("episode").alias("c")).collect()
    assert all(r["m"] == r["c"] <= 8 for r in nested) and {r["k"] for r in nested} == set(range(50))
    links = producers.links_back(df, "k", ["k"], share=1.0).collect()
    assert len(links) == 49 and all(r["earlier"] < r["k"] for r in links)
    assert producers.links_back(df.limit(0), "k", ["k"]).collect() == []
    rated = producers.ratings(df, "k", "n", 1000).collect()
    assert all(1 <= r["user_id"] <= 1000 and 1 <= r["stars"] <= 10 for r in rated) and sum(r["user_id"] <= 125 for r in rated) > len(rated) / 3


def test_calibrated(spark):
    from weftline.operators.statistics import gini

    df = spark.createDataFrame([(float(i),) for i in range(1, 200)] + [(None,), (-1.0,)], "w double")
    made, power = producers.calibrated(df, "w", 0.7)
    assert abs(gini(made, "calibrated").first()[0] - 0.7) <= 1e-3 and 0 < power < 16
    with pytest.raises(ValueError):
        producers.calibrated(spark.createDataFrame([(2.0,)] * 4, "w double"), "w", 0.5, steps=8)


def test_ids_and_columns(spark):
    df = spark.createDataFrame([(5, "a"), (5, "b"), (None, "c"), (0, "d"), (7, "e")], "id long, t string")
    assert {r["t"]: r["id"] for r in reshape.with_ids(df, "id", ["t"]).collect()} == {"a": 5, "b": 8, "c": 9, "d": 10, "e": 7}
    got = reshape.first_column(spark.createDataFrame([(" ", "x"), (None, None), ("y", "z")], "b string, c string"), "r", ["a", "b", "c"], "none")
    assert [r["r"] for r in got.collect()] == ["x", "none", "y"]


def test_plan_readings(spark):
    nodes = spark.createDataFrame([(0, 0, "Aggregate", 1, 1), (1, 1, "Join", 10, 200), (2, 2, "Filter", None, 5), (3, 2, "Relation", 50, 50)], "nth int, depth int, node string, estimated long, actual long")
    assert [r["node"] for r in qerror.below_aggregate(nodes).collect()] == ["Join"]
    assert [(r["q"], r["verdict"]) for r in qerror.real_nodes(nodes).collect()] == [(20.0, "REAL")]
    assert qerror.below_aggregate(nodes.filter("nth > 0")).collect() == []
    checks = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", False), ("c", False)], "s string, p boolean")
    assert {r["s"]: r["verdict"] for r in audit.verdicts(checks, "s", "p").collect()} == {"a": "GOOD", "b": "FAIR", "c": "POOR"}


def test_batches_and_compiled(spark, tmp_path):
    df = spark.createDataFrame([(2, "b\"x"), (1, None)], "id long, t string")
    path = str(tmp_path / "batch.json")
    for _ in range(2):
        assert writers.write_json_batch(df, path) == 2
    assert {(r["id"], r["t"]) for r in loaders.read_json_batch(spark, path, "id long, t string").collect()} == {(2, "b\"x"), (1, None)}
    with pytest.raises(ValueError):
        writers.write_json_batch(df, path, limit=1)
    made = []

    def make():
        made.append(1)
        return df

    for stamp in ("a", "a", "b"):
        assert writers.load_or_compile(spark, str(tmp_path / "c"), stamp, make).count() == 2
    assert len(made) == 2


def test_pair_metrics_of_a_hub(spark):
    """Someone's films are not multiplied by the people they have chemistry with."""
    from test_catalog import _records_sent

    films = spark.createDataFrame([(f, x) for f in range(1500) for x in (1, 2 + f % 40)], "title_id long, person long")
    people = spark.createDataFrame([(i, 1990, "a;b", "FR", 1.0) for i in range(1, 1501)], "id long, debut int, tags string, nationality string, pop double")
    pairs = spark.createDataFrame([(1, i) for i in range(2, 1502)], "x long, y long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _records_sent(spark)
        got = {r["y"]: (r["n_films"], r["films_a"], r["films_b"]) for r in graph.pair_metrics(pairs, people, films).collect()}
        assert got == {i: ((n := sum(f % 40 == i - 2 for f in range(1500))), 1500, n) for i in range(2, 1501)}
        assert _records_sent(spark) - before < 100_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_risk_of_a_large_genre(spark, tmp_path):
    """A genre's median is right where its films are over the limit and their ratios begin at 0."""
    import duckdb
    from compare import rows

    from weftline.plans import export as plans

    films = spark.range(1, 10_801).selectExpr(
        "id AS mid", "concat('F', id) AS title", "id % 40 AS director_id", "'2001-02-03' AS base_release_date",
        "struct(CAST(1950 + id % 70 AS INT) AS year, IF(id % 20 = 0, 'drama', 'war') AS genre, 'US' AS country, 'A' AS production_tier) AS concept",
        "struct(id % 10 / 1D AS rating, id AS num_votes, id * 9000D AS budget_usd, CASE WHEN id % 5 < 2 THEN 0D ELSE id % 977 / 50D END AS performance_ratio) AS fin",
    )
    films.write.parquet(f"{tmp_path}/movie_context.parquet")
    spark.range(1, 6000).selectExpr("id AS title_id", "1990 AS year", "sequence(1, 1 + id % 15) AS cast_ids").write.parquet(f"{tmp_path}/cast_ensemble.parquet")
    con = duckdb.connect()
    for t in ("movie_context", "cast_ensemble"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert rows(plans.risk_ranking(spark, str(tmp_path)).toPandas()) == rows(con.sql(plans.ORACLE["risk_ranking"]).df())
