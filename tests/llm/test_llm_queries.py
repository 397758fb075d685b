"""Queries p5 to p9 on the smallest tables; those with SQL against it."""

import pytest
from compare import connect, rows

from weftline.llm.plans import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in ORACLE:
        assert rows(got) == rows(connect(DATA).sql(ORACLE[name]).df())
