"""Every query with SQL against that SQL, over the smallest test data."""

import os
from collections import Counter

import pytest

from rostire.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def tidy(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    r = duck.sql(catalog.oracles()[name])
    cols = sorted(df.columns)
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    want = Counter(str([tidy(x[i]) for i in at]) for x in r.fetchall())
    got = Counter(str([tidy(x[c]) for c in cols]) for x in df.collect())
    assert got == want


@pytest.mark.parametrize("name", ["sentence_type_mix", "annotate_pronunciation", "error_grid", "emotion_classifier", "rendered_forms"])
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_every_sql_has_a_query():
    assert set(catalog.oracles()) <= set(catalog.queries())
