"""Operators that SQL can't express, and semantics that are easy to get wrong."""

import random

from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators import audit, graph, joins, qerror, reshape, sampling, sequences, statistics
from weftline.operators.ranking import dense_ids
from weftline.sources import arrow_ipc, contract, loaders, writers

VERSION = "row_id long, kind string, src long, dst long, w double, vf int, vt int, retired boolean"


def soundex(s, length=5):
    codes = {c: d for d, cs in zip("123456", ("BFPV", "CGJKQSXZ", "DT", "L", "MN", "R")) for c in cs}
    s = "".join(c for c in s.upper() if c.isalpha())
    out, before = s[:1], codes.get(s[:1], "0")
    for c in s[1:]:
        d = codes.get(c, "0")
        if d != "0" and d != before and len(out) < length:
            out += d
        before = d
    return out


def test_phonetic_code(spark):
    words = ["Ashcraft", "Pfister", "Tymczak", "Lloyd", "O'Hara", "", "123", "Élan", "Jackson", "bbb", "Honeyman"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", S.phonetic_code(F.col("w")).alias("c"))
    assert {r["w"]: r["c"] for r in df.collect()} == {w: soundex(w) for w in words}


def test_lenient_values(spark):
    df = spark.createDataFrame([("7.0",), ("x",), ("",), (None,), (" -3.9 ",), ("nan",)], "v string")
    got = df.select(S.lenient_int(F.col("v")).alias("i"), S.null_if_missing(F.col("v")).alias("t"), S.lenient_bool(F.col("v")).alias("b")).collect()
    assert [r["i"] for r in got] == [7, None, None, None, -3, None]
    assert [r["t"] for r in got] == ["7.0", "x", None, None, "-3.9", None]
    assert not any(r["b"] for r in got)


def test_text_and_maps(spark):
    row = spark.range(1).select(
        S.split_list(F.lit(" a; b,,c|")).alias("l"), S.first_last(F.lit("Doe, Jane Ann")).alias("n"), S.first_last(F.lit("Jane Ann Doe")).alias("m"),
        S.country_code(F.lit("Japan")).alias("c"), S.country_code(F.lit("?")).alias("d"), S.link_type_id(F.lit("Remake")).alias("k"),
        S.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))).alias("j"), S.year_bucket(F.lit(1994), 10).alias("y"), S.long_date(F.lit("1999-03-05")).alias("e"),
        S.normalize_weights(F.create_map(F.lit("a"), F.lit(3.0), F.lit("b"), F.lit(1.0))).alias("w"),
    ).first()
    assert row["l"] == ["a", "b", "c"] and tuple(row["n"]) == ("Jane Ann", "Doe") == tuple(row["m"])
    assert (row["c"], row["d"], row["k"], row["y"], row["e"]) == ("[jp]", "[us]", 3, "1990-1999", "5 March 1999")
    assert abs(row["j"] - 1 / 3) < 1e-12 and row["w"] == {"a": 0.75, "b": 0.25}


def test_as_of_handover(spark):
    v = spark.createDataFrame([(1, "friendship", 1, 2, 0.5, 2000, 2005, True), (2, "friendship", 1, 2, 0.7, 2005, None, False), (3, "avoid", 5, 4, 0.1, None, 2001, False)], VERSION)
    at = lambda y, **k: sorted(r["row_id"] for r in graph.as_of(v, y, **k).collect())
    assert (at(2004), at(2005), at(1999), at(2001)) == ([1], [2], [3], [1, 3])
    assert at(2001, null_from="never") == [1]
    closed = graph.with_closures(v, spark.createDataFrame([(2, 2010, True, 1), (2, 2012, True, 2)], "row_id long, vt int, retired boolean, seq int"))
    assert {r["row_id"]: r["vt"] for r in closed.collect()} == {1: 2005, 2: 2012, 3: 2001}


def test_apply_batch(spark):
    v = spark.createDataFrame([(1, "friendship", 3, 9, 0.9, 2000, None, False)], VERSION)
    ops = [(1, "update", "friendship", 9, 3, None, 0.3, 2010), (2, "update", "friendship", 3, 9, None, -0.5, 2012), (3, "add", "friendship", 3, 9, 0.4, None, 2013), (4, "expire", "mentorship", 9, 3, None, None, 2013), (5, "add", "mentorship", 9, 3, 0.2, None, 2013)]
    after, log = graph.apply_batch(v, spark.createDataFrame(ops, "seq long, mode string, kind string, src long, dst long, weight double, delta double, year int"))
    assert {r["seq"]: r["status"] for r in log.collect()} == {1: "applied", 2: "applied", 3: "skipped", 4: "skipped", 5: "applied"}
    got = sorted((r["kind"], r["src"], r["vf"], r["vt"], r["retired"], round(r["w"], 6)) for r in after.collect())
    assert got == [("friendship", 3, 2000, 2010, True, 0.9), ("friendship", 3, 2010, 2012, True, 1.0), ("friendship", 3, 2012, None, False, 0.5), ("mentorship", 9, 2013, None, False, 0.2)]


def test_strongest_with_validity(spark):
    rows = [(1, 1, 0.8, 2000, 2010), (1, 2, 0.5, 2005, 2020), (2, 1, 0.5, 2000, 2010), (2, 2, 0.8, 2005, 2020)]
    got = sequences.strongest_with_validity(spark.createDataFrame(rows, "k int, q int, w double, a int, b int"), ["k"], "q", "w", "a", "b")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0.8, 2005, 2010), (2, 0.8, 2005, 2020)]


def test_components_and_labels(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)]
    root = {v: v for p in pairs for v in p if p[0] != p[1]}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(pairs, "src long, dst long")
    assert {r["v"]: r["component"] for r in graph.components(df).collect()} == {v: find(v) for v in root}
    labels = graph.label_propagation(df.withColumn("weight", F.lit(1.0)), 5).collect()
    assert {r["v"] for r in labels} == set(root) and all(find(r["label"]) == find(r["v"]) for r in labels)


def test_sequences(spark):
    days = spark.createDataFrame([(1, d, f"2020-01-{d:02d}", float(d)) for d in range(1, 31)], "t int, day int, date string, g double")
    weeks = sequences.weekly(days, "t", "day", "date", ["g"]).collect()
    assert len(weeks) == 5 and sum(r["g"] for r in weeks) == 465.0
    sets = spark.createDataFrame([(1, 1, [1, 2]), (1, 2, [1, 2]), (1, 3, []), (1, 4, [2])], "k int, o int, m array<int>")
    assert [r["score"] for r in sequences.set_drift(sets, "k", "o", "m").orderBy("o").collect()] == [1.0, 0.0]
    one = spark.createDataFrame([(1, 5)], "k int, o int")
    assert sequences.calibrated_rank(one, ["k"], ["o"], 0.1, 0.95, "w").first()["w"] == 0.525
    years = spark.createDataFrame([(1, 1, 2000), (1, 2, 2001), (1, 3, 2010)], "k int, o int, y int")
    assert [r["spaced"] for r in sequences.spaced_years(years, "k", "o", "y", 3).orderBy("o").collect()] == [2000, 2003, 2010]


def test_counts_and_joins(spark):
    core = spark.createDataFrame([(1,), (2,)], "k long")
    fact = spark.createDataFrame([(1,)] * 3 + [(2,)] * 2, "f long")
    assert int(joins.fan_out_count(core, [(fact, "f", "k"), (fact, "f", "k")]).first()["n"]) == 13
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "src long, dst long")
    assert [tuple(r) for r in joins.triangles(edges).collect()] == [(1, 2, 3)]
    assert joins.directed_cycles(edges).count() == 0
    names = spark.createDataFrame([("anna",), ("berta",)], "name string")
    others = spark.createDataFrame([("annas",), ("anne",), ("zzz",)], "name string")
    assert [tuple(r) for r in joins.near_names(names, others, F.left("name", F.lit(1))).collect()] == [("anna", "annas", 1)]
    left = joins.without_one_filter(core, {"a": F.col("k") > 1, "b": F.col("k") < 1})
    assert {r["dropped"]: r["n"] for r in left.collect()} == {"": 0, "a": 0, "b": 1}


def test_sampling_is_stable(spark):
    df = spark.range(200).select((F.col("id") % 4).alias("g"), "id", (F.col("id") / 7).alias("w"))
    draw = lambda: {r["id"] for r in sampling.top_and_explore(df, ["g"], "w", "id", 10).collect()}
    assert draw() == draw() and len(draw()) == 40
    assert sampling.quota_sample(df, "g", "id", 22).count() == 22


def test_statistics_edges(spark):
    none = spark.createDataFrame([], "x double, k string")
    assert statistics.gini(none, "x").first()["gini"] is None
    same = spark.createDataFrame([(1.0, "a")] * 5, "x double, k string")
    assert abs(statistics.gini(same, "x").first()["gini"]) < 1e-12
    assert statistics.cramers_v(same.withColumn("j", F.lit("b")), "k", "j").first()["cramers_v"] == 0.0


def test_reshape_and_audit(spark):
    df = spark.createDataFrame([(1, " x ", "nan"), (2, "", None)], "id int, a string, b string")
    long = reshape.to_attributes(df, "id", {1: F.col("a"), 2: F.col("b")})
    assert [tuple(r) for r in long.collect()] == [(1, 1, "x")]
    coded, words = reshape.encoded(df, "a", "a_id")
    assert coded.count() == 2 and words.count() == 2
    rows = audit.expectations(df, {"e": ("c", F.col("b").isNull(), 0.1, 0.6)}).collect()
    assert [(r["status"], r["n_bad"]) for r in rows] == [("WARN", 1)]
    assert [r["id"] for r in dense_ids(df.select("a"), ["a"]).orderBy("a").collect()] == [1, 2]


def test_q_error(spark):
    row = spark.range(1).select(qerror.q_error(F.lit(0), F.lit(4)).alias("a"), qerror.q_error(F.lit(0), F.lit(4), 0.0).alias("b"), qerror.verdict(F.lit(60.0)).alias("v")).first()
    assert (row["a"], row["b"], row["v"]) == (8.0, float("inf"), "STRONG")
    spark.range(50).withColumn("k", F.col("id") % 5).createOrReplaceTempView("q_left")
    nodes = qerror.plan_nodes(spark, "SELECT count(*) FROM q_left a JOIN q_left b ON a.k = b.k WHERE a.id > 10").collect()
    assert any(r["node"] == "Join" and r["actual"] == 390 for r in nodes)


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"", None), (2, "", 2.5)], "id long, t string, x double")
    spark.dataSource.register(arrow_ipc.ArrowSource)
    df.write.format("arrow_ipc").mode("append").save(str(tmp_path / "x.arrow"))
    assert sorted(map(str, loaders.read_table(spark, str(tmp_path), "x.csv").collect())) == sorted(map(str, df.collect()))
    assert loaders.read_table(spark, str(tmp_path), "none", "a int").collect() == []
    schema = contract.core_schema("movie_keyword")
    assert writers.write_table(spark.range(3).withColumnRenamed("id", "movie_id"), str(tmp_path / "k"), schema, "csv") == 3
    back = loaders.read_bulk_csv(spark, str(tmp_path / "k"), schema)
    assert contract.differences(back, schema) == [] and back.filter("id IS NULL").count() == 3
    keyed = writers.with_key(spark.createDataFrame([(5, "a"), (None, "b"), (None, "c")], "id long, t string"), "id", ["t"])
    assert sorted(r["id"] for r in keyed.collect()) == [5, 6, 7]
    tables = {"title": contract.conform(spark.range(2), contract.core_schema("title")), "movie_keyword": back}
    assert {(r["column_name"], r["n_keys"]) for r in contract.broken_keys(tables).collect()} == {("movie_id", 1), ("episode_of_id", 0)}


def test_nearest_of_all(spark):
    """All names within the edits are found, whatever they begin with."""
    rng = random.Random(12)
    names = ["".join(rng.choice("abA") for _ in range(rng.randint(0, 9))) for _ in range(150)] + ["Maro Lind", "Karo Lind", "aro Lindd"]
    left, right = names[:100] + names[-3:], names[60:]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    frame = lambda xs: spark.createDataFrame([(x,) for x in [*xs, None]], "name string")
    for edits in (1, 3):
        got = {r["name"]: (r["edits"], r["match"]) for r in joins.nearest_of_all(frame(left), frame(right), edits).collect()}
        want = {a: min((distance(a.lower(), b.lower()), b) for b in set(right) if b != a) for a in left}
        assert got == {a: m for a, m in want.items() if m[0] <= edits}


def test_names_with_equal_parts(spark):
    """Numbered names, each with others an edit away; before, all met all, which took some minute of the tasks' time."""
    frame = spark.range(4000).selectExpr("concat('Customer number ', lpad(id, 5, '0')) AS name")

    def seconds():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).executorCpuTime() for i in range(stages.size())) / 1e9

    before = seconds()
    got = joins.nearest_of_all(frame, frame).collect()
    assert len(got) == 4000 and {r["edits"] for r in got} == {1}
    assert {r["name"]: r["match"] for r in got}["Customer number 00123"] == "Customer number 00023"
    assert seconds() - before < 10


def test_labels_settle_by_weight(spark):
    """Two vertices alone settle instead of changing places; the heavier side wins; a cut run says so."""
    pairs = [(1, 2, 0.5), (10, 11, 1.0), (10, 12, 1.0), (11, 12, 1.0), (12, 13, 0.9), (13, 14, 0.1), (20, 21, 1.0), (21, 22, 1.0), (22, 23, 1.0), (20, 23, 1.0)]
    df = spark.createDataFrame(pairs, "src long, dst long, weight double")
    got = graph.label_propagation(df).collect()
    label = {r["v"]: r["label"] for r in got}
    assert all(r["stable"] for r in got) and got[0]["rounds"] < 100
    assert label[1] == label[2] and label[10] == label[11] == label[12] == label[13]
    for v in label:  # no vertex has a heavier label next to it
        votes: dict = {}
        for a, b, w in pairs:
            if v in (a, b):
                other = label[b if v == a else a]
                votes[other] = votes.get(other, 0) + w
        assert votes[label[v]] == max(votes.values())
    assert not all(r["stable"] for r in graph.label_propagation(df, 1).collect())


def test_person_graph_is_whole(spark):
    """Components span every kind between people, communities every friend."""
    from weftline.plans import graph as plans
    from weftline.plans.relational import versions

    folder = "/root/testdata/sf0.001"
    company = ["brand_fit", "employment", "blacklist", "exclusive_deal", "co_production", "market_rival", "subsidiary"]
    v = versions(spark, folder).filter("src <> dst")
    ends = lambda df: {x for r in df.select("src", "dst").collect() for x in r}
    assert {r["v"] for r in plans.components(spark, folder).collect()} == ends(v.filter(~F.col("kind").isin(company)))
    assert {r["v"] for r in plans.label_propagation(spark, folder).collect()} == ends(v.filter("kind = 'friendship'"))


def test_film_links_of_all_years(spark, tmp_path):
    """Films of any year are linked, those without a year too."""
    from weftline.plans import reshaping

    films = [(1, 1970, [1, 2]), (2, 1990, [1, 2, 3]), (3, 2021, [2, 3, 1]), (4, None, [3, 2, 2]), (5, 1991, [3, 0, -1])]
    spark.createDataFrame(films, "title_id long, year int, cast_ids array<long>").write.parquet(str(tmp_path / "cast_ensemble.parquet"))
    got = {(r["source"], r["target"]): r["n_shared"] for r in reshaping.film_links(spark, str(tmp_path)).collect()}
    assert got == {(1, 2): 2, (1, 3): 2, (2, 3): 3, (2, 4): 2, (3, 4): 2}


def test_common_neighbours_of_hubs(spark):
    """A hub's friends are not multiplied by its rivals; either end may have fewer."""
    from test_catalog import _records_sent

    links = [(1, i) for i in range(2, 1502)] + [(i, i + 1) for i in range(2, 400)] + [(3, 3), (None, 2), (9, 1)]
    pairs = [(1, i) for i in range(3, 1003)] + [(i, i + 2) for i in range(5, 60)] + [(5000, 1), (7, 7), (4, 1)]
    near: dict = {}
    for a, b in links:
        if a and b and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    asked = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
    want = {p: n for p in asked if (n := len(near.get(p[0], set()) & near.get(p[1], set())))}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _records_sent(spark)
        frames = [spark.createDataFrame(x, "src long, dst long") for x in (pairs, links)]
        got = {(r["src"], r["dst"]): r["n_common"] for r in joins.common_neighbours(*frames).collect()}
        assert got == want and _records_sent(spark) - before < 100_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bit_jaccard_keeps_all_tasks_busy(spark, tmp_path):
    """Few bytes make many pairs; no task may be left with most of them."""
    from weftline.plans import relational

    part = spark.range(1, 601).selectExpr("id AS p_partkey", "'B' AS p_brand", "'T' AS p_type", "CAST(id % 50 + 1 AS INT) AS p_size")
    part.write.parquet(f"{tmp_path}/part.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = relational.bit_jaccard(spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in got.groupBy("task").count().collect()]
        assert sum(sizes) == 600 * 599 // 2 and max(sizes) < sum(sizes) / 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
