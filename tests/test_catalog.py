"""The runner of query texts, and the registry of row generators."""

import glob
import os

import duckdb
import pytest
from compare import rows

from weftline.functions import registry
from weftline.plans import catalog

PLANNED = ("cat_friends_together", "cat_together_chemistry", "cat_together_former_collaborator", "cat_together_clique", "cat_together_mentorship", "cat_together_collaboration", "cat_rivals_together", "cat_director_befriends_cast", "cat_gap_same_person")


def test_runner(spark, tmp_path):
    spark.range(5).createOrReplaceTempView("few")
    for name, text in (("10b", "SELECT * FROM few;"), ("2a", "SELECT * FROM few WHERE id > 9"), ("3c", "SELECT nothing FROM few")):
        (tmp_path / f"{name}.sql").write_text(text)
    rows = catalog.run_folder(spark, str(tmp_path)).collect()
    assert [(r["query"], r["status"], r["n_rows"]) for r in rows] == [("2a", "EMPTY", 0), ("3c", "ERROR", None), ("10b", "OK", 5)]
    assert catalog.adapted("a = 'x'", [("'x'", "'[x]'"), ("a", "b")]) == "b = '[x]'"


def test_generators(spark):
    made = registry.register(registry.Generator("twice", "id", "id long, nth int, u double", lambda r, u: [(r["id"], n, u(n)) for n in range(2)]))
    first = sorted(map(tuple, registry.generate(spark.range(10), made.name).collect()))
    again = sorted(map(tuple, registry.generate(spark.range(10).repartition(3), made.name).collect()))
    assert first == again and len(first) == 20 and all(0 <= u < 1 for *_, u in first)


def test_external_calls(spark):
    df = spark.createDataFrame([("a",), ("b",), ("bad",)], "p string")

    def call(prompts):
        if "bad" in prompts:
            raise ValueError
        return [p.upper() for p in prompts]

    got = {r["p"]: r["answer"] for r in registry.external(df, call, "p", size=1).collect()}
    assert got == {"a": "A", "b": "B", "bad": None}


def test_sql_functions(spark):
    registry.register_sql(spark)
    assert spark.sql("SELECT phonetic('Ashcraft') AS c").first()["c"] == "A2261"
    assert [r["year"] for r in spark.sql("SELECT * FROM year_span(2000, 2002)").collect()] == [2000, 2001, 2002]


def _records_sent(spark):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture(scope="module")
def hub(spark, tmp_path_factory):
    """Person 1 is in 1,200 films and has 1,200 edges of each kind, few of them to people of those films."""
    folder = tmp_path_factory.mktemp("hub")
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        if os.path.basename(f)[:-8] not in ("movie_context", "cast_ensemble", "edges"):
            os.symlink(f, folder / os.path.basename(f))
    films = [(i, f"F{i}", (None if i % 50 == 0 else 1950 + i % 60, "Drama" if i % 3 else None, "US", "A"), None if i % 7 == 0 else i % 40 + 1, (100, "PG")) for i in range(1, 1201)]
    film = "mid long, title string, concept struct<year: int, genre: string, country: string, production_tier: string>, director_id long, fin struct<runtime_minutes: int, certification: string>"
    spark.createDataFrame(films, film).coalesce(1).write.parquet(str(folder / "movie_context.parquet"))
    casts = [(i, 1950 + i % 60, [1, 1, 1 + i % 30, 2 + i % 9, 0]) for i in range(1, 1201)] + [(5, 1955, [1, 40])]
    spark.createDataFrame(casts, "title_id long, year int, cast_ids array<long>").coalesce(1).write.parquet(str(folder / "cast_ensemble.parquet"))
    kinds = ("friendship", "rivalry", "mentorship", "chemistry", "collaboration", "clique", "former_collaborator")
    edges = [(len(kinds) * i + k, *((1, i + 1) if i % 4 else (i + 1, 1)), f" {kind.upper()}", 1950 + i % 30, None if i % 5 == 0 else 1990, (i % 10) / 10) for i in range(1200) for k, kind in enumerate(kinds)]
    edges += [(20_000, 1, 3, "friendship", None, 2000, 0.9), (20_001, None, 3, "friendship", 1950, 2000, 0.9), (20_002, 3, 3, "clique", 1950, 2000, 0.9)]
    spark.createDataFrame(edges, "row_id long, src_id long, dst_id long, edge_type string, valid_from int, valid_to int, weight double").coalesce(1).write.parquet(str(folder / "edges.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", PLANNED)
def test_planned_texts_send_little(spark, hub, name):
    """Results are the text's; a hub's edges are never multiplied by its films, nor its films by one another."""
    con = duckdb.connect()
    for t in ("movie_context", "cast_ensemble", "edges"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{hub}/{t}.parquet/*.parquet'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _records_sent(spark)
        df = catalog.QUERIES[name](spark, hub)
        got = df.toPandas()
        assert rows(got) == rows(con.sql(catalog.ORACLE[name]).df())
        assert _records_sent(spark) - before < 100_000
        assert "NestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
