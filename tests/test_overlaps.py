"""Common members of all pairs of sets against plain loops, in one block and in several."""

import hashlib
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from test_catalog import _records_sent

from weftline.operators import graph
from weftline.operators.overlaps import common_members
from weftline.plans import reshaping


def links(n=160, seed=5):
    """Undirected pairs with a hub."""
    rng = random.Random(seed)
    pairs = {(1, i) for i in range(2, n)} | {tuple(sorted(rng.sample(range(2, n + 20), 2))) for _ in range(2 * n)}
    return sorted(pairs)


def met(pairs):
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return {(a, b): n for a, b in combinations(sorted(near), 2) if b not in near[a] and (n := len(near[a] & near[b]))}


@pytest.mark.parametrize("blocks,step", [(10**6, 1 << 20), (90, 1 << 20), (90, 50), (300, 1)])
def test_common_members(spark, blocks, step):
    rng = random.Random(3)
    rows = [(rng.choice([-4, *range(60)]), rng.choice([7, 7, 7, -2, *range(90)])) for _ in range(900)] + [(None, 7), (3, None), (900, 901)]
    sets: dict = {}
    for i, m in rows:
        if i is not None and m is not None:
            sets.setdefault(i, set()).add(m)
    want = {(a, b): n for a, b in combinations(sorted(sets), 2) if (n := len(sets[a] & sets[b])) >= 2}
    got = common_members(spark.createDataFrame(rows, "id long, member long"), 2, block_members=blocks, step=step).collect()
    assert {(r["a"], r["b"]): r["n"] for r in got} == want and len(got) == len(want)
    assert common_members(spark.createDataFrame([], "id long, member long")).collect() == []


def test_each_two_blocks_have_a_task(spark):
    """Before, some tasks counted several, one after another, and others none."""
    got = common_members(spark.range(600).select("id", F.lit(7).cast("bigint").alias("member")), block_members=100)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() == 36


@pytest.mark.parametrize("blocks,step", [(10**6, 1 << 20), (100, 300)])
def test_unlinked_and_drawn(spark, blocks, step):
    pairs = links()
    both = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "id long, member long")
    want = met(pairs)
    got = {(r["a"], r["b"]): r["n"] for r in common_members(both, unlinked=True, block_members=blocks, step=step).collect()}
    assert got == want
    best: dict = {}
    for (a, b), n in sorted(want.items(), key=lambda x: (x[0][0], -x[1], x[0][1])):
        if int(hashlib.md5(f"42|{a}|{b}".encode()).hexdigest()[:12], 16) / 16**12 < 0.1:
            best.setdefault(a, []).append((b, n))
    drawn = common_members(both, unlinked=True, chance=0.1, most=3, block_members=blocks, step=step).collect()
    assert sorted((r["a"], r["b"], r["n"]) for r in drawn) == sorted((a, b, n) for a, bs in best.items() for b, n in bs[:3])


@pytest.mark.parametrize("made", [graph.transitive_pairs, lambda p: graph.triadic_closure(p, 0.4), "film_links"])
def test_pairs_of_a_hub_are_not_sent(spark, tmp_path, made):
    """Before, a hub's 719,400 pairs were."""
    if made == "film_links":
        films = spark.range(1, 1201).select(F.col("id").alias("title_id"), F.lit(1990).alias("year"), F.array(F.lit(1), F.col("id") + 10, F.lit(2)).alias("cast_ids"))
        films.write.parquet(f"{tmp_path}/cast_ensemble.parquet")
        run, n = lambda: reshaping.film_links(spark, str(tmp_path)).count(), 1200 * 1199 // 2
    else:
        pairs = spark.range(2, 1202).select(F.lit(1).cast("bigint").alias("src"), F.col("id").alias("dst"))
        run, n = lambda: made(pairs).count(), 1200 * 1199 // 2 if made is graph.transitive_pairs else None
    before = _records_sent(spark)
    got = run()
    assert (got == n if n else 0 < got < 8 * 1200) and _records_sent(spark) - before < 100_000
