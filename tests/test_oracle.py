"""Every query of the catalog against its DuckDB SQL on the given tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from loomlog.plans import catalog
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    own = duckdb.connect()
    for t in TABLES:
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return own


def plain(rows):
    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return ""
        if isinstance(x, bool):
            return str(x)
        return f"{float(x):.6f}" if isinstance(x, (int, float)) else str(x)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    names = sorted(found.columns)
    wanted = duck.execute(catalog.ORACLES[name])
    columns = [x[0] for x in wanted.description]
    assert sorted(columns) == names
    rows = [[r[columns.index(c)] for c in names] for r in wanted.fetchall()]
    assert plain(found.select(*names).collect()) == plain(rows)


def test_entry_points():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 15
