"""Every query of the core against its SQL, on the smallest tables."""

import pytest
from compare import connect, rows

from weftline.plans import catalog, export, flows, graph, producers, relational, reshaping, training

DATA = "/root/testdata/sf0.001"
MODULES = (training, relational, graph, reshaping, export, flows, producers, catalog)
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
ORACLE = {n: s for m in MODULES for n, s in m.ORACLE.items()}


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE:
        want = con.sql(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
