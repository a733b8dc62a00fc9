"""Every query that has SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from glintframe.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else str(v) if not isinstance(v, (int, float, str, bool)) else v


def near(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-6 * max(1.0, abs(a)))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    told = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == cols
    want = sorted(([plain(r[names.index(c)]) for c in cols] for r in told.fetchall()), key=repr)
    have = sorted(([plain(r[c]) for c in cols] for r in got.collect()), key=repr)
    assert len(have) == len(want)
    assert all(near(x, y) for a, b in zip(have, want) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - {"pipeline_end_to_end"}))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
