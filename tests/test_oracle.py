"""Every core query against its oracle SQL on the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from ledgerloom.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return None if v is None else str(list(v) if isinstance(v, (list, tuple)) else v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small, duck):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rows = Counter(tuple(norm(r[c]) for c in columns) for r in df.collect())
    if name in ORACLE:
        found = duck.sql(ORACLE[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert rows == Counter(tuple(norm(r[i]) for i in at) for r in found.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES) and len(ORACLE) >= 60
