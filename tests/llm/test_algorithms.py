"""Percentiles, co-occurrence and packing against plain loops."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.llm import cooccurrence, packing, percentiles


def nearest(values, p):
    values = sorted(values)
    return values[max(0, -(-len(values) * p // 100) - 1)]


def test_percentiles_merge(spark):
    rng = random.Random(4)
    rows = [("a" if i % 3 else f"g{i % 7}", rng.choice([float(rng.randint(1, 5)), rng.lognormvariate(3, 2)])) for i in range(3000)]
    dirty = [("a", None), ("a", math.nan), ("a", math.inf), ("a", 0.0), ("a", -1.0), (None, 3.0)]
    df = spark.createDataFrame(rows + dirty, "g string, v double")
    days = [percentiles.frequency_table(df.filter(F.pmod(F.xxhash64("v"), F.lit(2)) == i), F.col("g"), F.col("v")) for i in (0, 1)]
    got = {r["grp"]: r for r in percentiles.percentiles(percentiles.merge_frequencies(*days), ("0.01", "0.5", "0.95")).collect()}
    groups: dict = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert [got[g][c] for c in ("n_values", "p1", "p50", "p95")] == [len(vs), nearest(vs, 1), nearest(vs, 50), nearest(vs, 95)]


def test_percentiles_bound_and_empty(spark):
    values = [1.5**i for i in range(40)]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    freq = percentiles.frequency_table(df, F.col("g"), F.col("v"), relative_error=0.01)
    got = percentiles.percentiles(freq, ("0.5",)).first()["p50"]
    assert abs(got / nearest(values, 50) - 1) <= 0.0101
    assert percentiles.percentiles(freq.limit(0)).collect() == []


def test_percentiles_of_all_signs(spark):
    """Zero and negative values count where asked for, each within the bound of its own size."""
    values = [-(1.5**i) for i in range(20)] + [0.0] * 5 + [1.5**i for i in range(20)]
    df = spark.createDataFrame([("a", v) for v in [*values, math.nan, -math.inf, None]], "g string, v double")
    for e in (0.0, 0.01):
        freq = percentiles.frequency_table(df, F.col("g"), F.col("v"), e, above_zero=False)
        got = percentiles.percentiles(freq, ("0.1", "0.4", "0.5", "0.9")).first()
        assert got["n_values"] == 45
        for p in (10, 40, 50, 90):
            assert abs(got[f"p{p}"] - nearest(values, p)) <= abs(nearest(values, p)) * (e * 1.01)


def test_percentiles_of_every_field(spark):
    from weftline.llm import plans

    folder = "/root/testdata/sf0.001"
    fin = spark.read.parquet(f"{folder}/movie_context.parquet").select("fin.*")
    numbers = {n for n, kind in fin.dtypes if kind in ("int", "bigint", "double")}
    got = plans.p5_fields(spark, folder).collect()
    assert {r["field"] for r in got if r["table_name"] == "movie_context"} == numbers
    assert min(r["p5"] for r in got if r["field"] == "company_momentum") < 0


@pytest.mark.parametrize("block,at_once", [(1_000_000, 1_000_000), (40, 50)])
def test_pairs(spark, monkeypatch, block, at_once):
    """Records delivered again, in another order and with other people, count once with all their people."""
    monkeypatch.setattr(cooccurrence, "PAIRS_AT_ONCE", at_once)
    rng = random.Random(6)
    records = [(i, [rng.choice([1, 1, 2, 3, rng.randint(4, 60), 0, -1, None]) for _ in range(rng.randint(0, 9))]) for i in range(400)]
    records += [(i, ids[::-1]) for i, ids in records[:50]] + [(900, None), (901, []), (7, [1, 2, 61]), (8, [62])]
    df = spark.createDataFrame(records, "t long, ids array<long>")
    got = cooccurrence.pair_counts(df, F.col("t"), F.col("ids"), pairs_a_block=block)
    pairs, items, n = got.pairs, got.items, got.records
    sets: dict = {}
    for i, ids in records:
        sets.setdefault(i, set()).update(x for x in ids or [] if x and x > 0)
    sets = {i: sorted(s) for i, s in sets.items() if s}
    assert n == len(sets)
    one, two = Counter(x for s in sets.values() for x in s), Counter(p for s in sets.values() for p in itertools.combinations(s, 2))
    assert {r["item"]: r["n"] for r in items.collect()} == one
    assert {(r["a"], r["b"]): r["n_ab"] for r in pairs.collect()} == two
    strong = cooccurrence.strong_pairs(cooccurrence.with_significance(got), n, 2, 2)
    assert {(r["a"], r["b"]) for r in strong.collect()} == {(a, b) for (a, b), k in two.items() if k >= 2 and k * n >= 2 * one[a] * one[b]}
    assert cooccurrence.pair_counts(df.limit(0), F.col("t"), F.col("ids")).pairs.collect() == []


def test_all_pairs_come_out(spark, tmp_path):
    """Pairs that meet once are pairs too."""
    from weftline.llm import plans

    films = [(i, [1, 2]) for i in range(5)] + [(5, [1, 3]), (6, [2, 3, 4]), (7, [4, 3]), (8, [5])]
    spark.createDataFrame(films, "title_id long, cast_ids array<long>").write.parquet(str(tmp_path / "cast_ensemble.parquet"))
    got = {(r["person_a"], r["person_b"]): (r["n_ab"], r["lift"]) for r in plans.p6_pairs(spark, str(tmp_path)).collect()}
    assert got == {(1, 2): (5, 1.25), (1, 3): (1, 0.5), (2, 3): (1, 0.5), (2, 4): (1, 0.75), (3, 4): (2, 3.0)}


def test_pack():
    rng = random.Random(8)
    for capacity in (1, 7, 10, 100):
        sizes = [rng.randint(1, capacity) for _ in range(200)]
        place = packing.pack(sizes, capacity)
        fill = Counter()
        for s, p in zip(sizes, place):
            fill[p] += s
        assert max(fill.values()) <= capacity and sorted(fill) == list(range(len(fill)))
    # best fit alone takes 24 containers, exchanges reach the 20 that are needed
    sizes = [4] * 20 + [3] * 40
    assert len(set(packing.pack(sizes, 10, search=False))) == 24 and len(set(packing.pack(sizes, 10))) == 20
    assert packing.pack([], 10) == []


def test_local_search_empties_containers():
    """From first fit in any order fewer containers are left, each step raises the sum of squared fills, and nothing is lost."""
    rng = random.Random(5)
    for capacity, most in ((512, 512), (512, 400), (700, 700)):
        sizes = [min(most, max(1, int(rng.lognormvariate(5, 1)))) for _ in range(1500)]
        place = packing._first_fit(sizes, capacity)
        before, steps = len(set(place)), []
        packing.local_search(sizes, place, capacity, steps)
        fill = Counter()
        for s, p in zip(sizes, place):
            fill[p] += s
        assert packing.least_containers(sizes, capacity) <= len(fill) < before and max(fill.values()) <= capacity
        assert steps and all(x < y for x, y in zip(steps, steps[1:]))
        assert len(set(packing.pack(sizes, capacity))) <= len(set(packing.pack(sizes, capacity, search=False)))


def test_fill_containers(spark):
    sizes = spark.createDataFrame([(1, 25), (2, 10), (3, 4), (4, 6), (5, 0), (6, None), (7, 20)], "key long, n_tokens long")
    kinds = spark.createDataFrame([("k", 10), ("k", 10), (None, 5), ("z", 0), ("big", 100)], "kind string, capacity int")
    placed = packing.fill_containers(sizes, kinds)
    rows = placed.collect()
    for kind, capacity, pieces in (("k", 10, 8), ("big", 100, 5)):
        mine = [r for r in rows if r["kind"] == kind]
        fill = Counter()
        for r in mine:
            fill[r["container"]] += r["token_to"] - r["token_from"]
        assert len(mine) == pieces and sum(fill.values()) == 65 and max(fill.values()) <= capacity
    assert sorted((r["piece"], r["token_from"], r["token_to"]) for r in rows if r["kind"] == "k" and r["key"] == 1) == [(0, 0, 10), (1, 10, 20), (2, 20, 25)]
    assert {r["kind"]: r["n_tokens"] for r in packing.container_fill(placed, kinds).groupBy("kind").agg(F.sum("n_tokens").alias("n_tokens")).collect()} == {"k": 65, "big": 65}
    assert packing.fill_containers(sizes.limit(0), kinds).collect() == []


def test_token_sizes(spark):
    docs = spark.createDataFrame([(1, "the harness stayed"), (2, " \n  "), (3, None), (4, "")], "d long, t string")
    got = {r["key"]: r["n_tokens"] for r in packing.token_sizes(docs, "d", "t").collect()}
    assert set(got) == {1} and got[1] >= 3
