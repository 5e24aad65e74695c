"""Every query of the families against its DuckDB query on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from kelpline.plans import FAMILIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {k: v for f in FAMILIES for k, v in f.queries.items()}
ORACLES = {k: v for f in FAMILIES for k, v in f.oracles.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if name in ORACLES:
        r = duck.execute(ORACLES[name])
        at = {d[0]: i for i, d in enumerate(r.description)}
        assert sorted(at) == columns
        assert got == sorted(repr([plain(row[at[c]]) for c in columns]) for row in r.fetchall())


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
