"""As-of versions, heavy keys, intervals and references against plain loops."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.operators.asof import AsofSpec, asof_versions, employment_asof
from weftline.operators.intervals import edge_periods
from weftline.operators.references import broken_references
from weftline.operators.skew import heavy_keys, keyed_histogram, keyed_quantiles

EVENT = "_event long, _entity long, _period int, _at long, extra string"
VERSION = "_version long, _entity long, _first int, _last int, _from int, _known long, _n string"


def best(event, versions):
    key, entity, period, at, _ = event
    if None in (entity, period, at):
        return None
    usable = [v for v in versions if None not in v[:6] and v[1] == entity and v[2] <= period <= v[3] and v[5] <= at]
    return max(usable, key=lambda v: (v[4], v[5], v[0]))[0] if usable else None


@pytest.mark.parametrize("hot,chain,span", [(50_000, 10**6, 30), (20, 10**6, 30), (50_000, 50, 30), (20, 10**6, 0)])
def test_asof_versions(spark, hot, chain, span):
    """Units may be whole entities or parts of them; with a span of 0 all versions became known at one moment."""
    rng = random.Random(7)
    versions = [(i, rng.choice([1, 1, 1, 2, 3]), f := rng.randint(0, 9), f + rng.randint(-1, 6), f, rng.randint(0, span), "x") for i in range(300)]
    versions += versions[:40] + [(900, 1, None, 5, 1, 1, "x"), (901, None, 0, 9, 0, 0, "x"), (902, 1, 0, 9, 0, None, "x")]
    events = [(i, rng.choice([1, 1, 2, 3, 4]), rng.randint(0, 12), rng.randint(0, 35), "x") for i in range(400)]
    events += events[:30] + [(900, None, 1, 1, "x"), (901, 1, None, 1, "x"), (902, 1, 1, None, "x")]
    spec = AsofSpec(bucket_rows=100, hot_rows=hot, chain_rows=chain)
    scale = 1_000_000
    got = asof_versions(
        spark.createDataFrame([(*e[:3], None if e[3] is None else e[3] * scale, e[4]) for e in events], EVENT),
        spark.createDataFrame([(*v[:5], None if v[5] is None else v[5] * scale, v[6]) for v in versions], VERSION),
        spec,
    ).collect()
    assert {r["_event"]: r["_version"] for r in got} == {e[0]: best(e, versions) for e in events}
    assert len(got) == len({e[0] for e in events})


def test_asof_empty(spark):
    events = spark.createDataFrame([(1, 1, 1, 1, "x")], EVENT)
    none = spark.createDataFrame([], VERSION)
    assert [r["_version"] for r in asof_versions(events, none).collect()] == [None]
    assert asof_versions(events.limit(0), none).collect() == []


def test_employment_bounds(spark):
    t = datetime(2020, 1, 1)
    edges = [
        (1, 7, " EMPLOYMENT ", 2000, 2005, True, t), (2, 7, "employment", 2005, None, False, t), (3, 8, "employment", 2006, 2004, False, t),
        (4, 9, "friendship", 2000, None, False, t), (5, 8, "employment", None, 2010, False, t), (6, 10, "employment", 2000, 2005, None, t + timedelta(days=1)),
    ]
    edges = spark.createDataFrame(edges, "row_id long, dst_id long, edge_type string, valid_from int, valid_to int, _scd2_retired boolean, recorded_at timestamp")
    cache = [(1, 2005, 7, t), (2, 2004, 7, t), (3, 2005, 8, t), (4, 2000, 9, t), (5, 2005, 10, t), (6, 2005, 10, t + timedelta(days=2))]
    cache = spark.createDataFrame(cache, "cache_id long, year int, pid long, built_at timestamp")
    got = {r["cache_id"]: r["row_id"] for r in employment_asof(cache, edges).collect()}
    assert got == {1: 2, 2: 1, 3: None, 4: None, 5: None, 6: 6}


@pytest.mark.parametrize("hot", [10_000, 50])
def test_keyed_quantiles(spark, hot):
    rng = random.Random(3)
    rows = [(i, 1 if i % 3 else rng.randint(2, 40), rng.choice([rng.lognormvariate(0, 9), float(rng.randint(-3, 3))])) for i in range(3000)]
    rows += [(5000, 77, None), (5001, 77, math.nan), (5002, 78, math.inf), (5003, None, 1.0)] + rows[:200]
    df = spark.createDataFrame(rows, "r long, k long, v double")
    got = {r["key"]: r for r in keyed_quantiles(keyed_histogram(df, df.k, df.v, df.r), ("0.01", "0.5", "0.95", "1"), hot, 8).collect()}
    values: dict = {}
    for r, k, v in {x[0]: x for x in rows}.values():
        values.setdefault(k, []).append(v)
    assert set(got) == set(values) - {None}
    for k, vs in values.items():
        if k is None:
            continue
        finite = sorted(v for v in vs if v is not None and math.isfinite(v))
        assert got[k]["n_records"] == len(vs) and got[k]["n_values"] == len(finite)
        for p, c in ((1, "q0_01"), (50, "q0_5"), (95, "q0_95"), (100, "q1")):
            assert got[k][c] == (finite[max(0, -(-len(finite) * p // 100) - 1)] if finite else None)


@pytest.mark.parametrize("values", [
    [0.0] * 30 + [i / 50 for i in range(40)], [-i / 50 for i in range(40)] + [0.0] * 9, [0.0] * 20 + [5e-324] * 20,
    [0.0, 1e-300, 1.0, 1e300, 1.7e308] * 9, [-1.7e308, 0.0, 1e300] * 9, [0.0] * 40,
])
def test_refined_ranges_with_a_zero(spark, values):
    """A range may begin or end at 0, be too narrow to divide by, or reach the largest numbers."""
    df = spark.createDataFrame(list(enumerate(values)), "r long, v double").withColumn("k", F.lit(1))
    got = keyed_quantiles(keyed_histogram(df, df.k, df.v, df.r), ("0.01", "0.5", "0.95"), 5, 8).first()
    ordered = sorted(values)
    assert [got["q0_01"], got["q0_5"], got["q0_95"]] == [ordered[max(0, -(-len(values) * p // 100) - 1)] for p in (1, 50, 95)]


def test_heavy_keys_and_empty(spark):
    df = spark.createDataFrame([(i, 1 if i < 2 else i) for i in range(100)], "r long, k long")
    q = keyed_quantiles(keyed_histogram(df, df.k, df.r, df.r))
    assert [r["key"] for r in heavy_keys(q, 100).collect()] == [1]
    assert keyed_quantiles(keyed_histogram(df.limit(0), df.k, df.r, df.r)).collect() == []


EDGE = "row_id long, src_id long, dst_id long, edge_type string, valid_from int, valid_to int, _scd2_retired boolean, n_versions string"


def test_edge_periods(spark):
    rng = random.Random(5)
    edges = []
    for i in range(400):
        f = rng.randint(0, 30)
        edges.append((i, rng.choice([1, 2]), rng.choice([1, 2, 3]), rng.choice([" Friendship", "mentorship", "EMPLOYMENT"]), f, rng.choice([None, f, f + 1, f + 3, f - 1, f + 2]), rng.choice([True, False, None]), ""))
    edges = [e for e in edges if not (e[4] < 26 and e[5] is None)]
    edges += edges[:50] + [(900, None, 1, "clique", 1, 2, False, ""), (901, 1, 2, None, 1, 2, False, ""), (902, 1, 2, "clique", None, 2, False, "")]
    covered: dict = {}
    for e in {x[0]: x for x in edges}.values():
        row, s, d, t, f, l, r, _ = e
        if None in (s, d, t, f):
            continue
        t = t.strip().lower()
        if t == "friendship" and s > d:
            s, d = d, s
        last = 9999 if l is None else l - bool(r)
        if last >= f:
            covered.setdefault((s, d, t), []).append((f, last))
    want = set()
    for key, spans in covered.items():
        periods: list = []
        for f, l in sorted(spans):
            if periods and f <= periods[-1][1] + 1:
                periods[-1] = (periods[-1][0], max(l, periods[-1][1]), periods[-1][2] + 1)
            else:
                periods.append((f, l, 1))
        want |= {(*key, "merged", *p) for p in periods}
        want |= {(*key, "gap", a[1] + 1, b[0] - 1, None) for a, b in zip(periods, periods[1:])}
    got = edge_periods(spark.createDataFrame(edges, EDGE)).collect()
    assert {tuple(r[c] for c in ("src_id", "dst_id", "edge_type", "span_kind", "year_from", "year_to", "n_versions")) for r in got} == want
    assert len(got) == len(want)
    assert edge_periods(spark.createDataFrame([], EDGE)).collect() == []


def test_broken_references(spark):
    t = datetime(2020, 1, 1)
    day = timedelta(days=1)
    parents = [("p", i, t, None) for i in range(50)] + [("p", 3, t - day, t + 5 * day), ("p", 60, t + 9 * day, None), ("c", 61, t, t), ("p", None, t, None), ("p", 62, None, None)]
    parents = spark.createDataFrame(parents, "parent_kind string, parent_id long, recorded_at timestamp, deleted_at timestamp")
    refs = [(i, "p", i, t + day) for i in range(60)] + [(100, "p", 3, t + 5 * day), (101, "p", 60, t), (102, "c", 61, t), (103, "p", 61, t), (104, "p", None, t), (105, "p", 3, None), (106, "p", 62, t), (107, "p", 999, None)]
    refs = spark.createDataFrame([("e", "f", *r) for r in refs], "table_name string, ref_field string, row_key long, parent_kind string, parent_id long, at timestamp")
    want = {(i, "missing") for i in range(50, 60)} | {(100, "deleted"), (101, "late"), (102, "deleted"), (103, "missing"), (107, "missing")}
    for limits in ({}, {"max_bits": 64, "broadcast_rows": 0}, {"broadcast_rows": 0, "hot_references": 0}):
        rows = broken_references(refs, parents, **limits).collect()
        assert {(r["row_key"], r["ref_state"]) for r in rows} == want and len(rows) == len(want)
    assert broken_references(refs.limit(0), parents).collect() == []
    assert {r["ref_state"] for r in broken_references(refs, parents.limit(0)).collect()} == {"missing"}
