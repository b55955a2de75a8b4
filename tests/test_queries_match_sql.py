"""Every registered query of the analytics against its DuckDB SQL at the smallest size."""

import datetime
import os

import duckdb
import pytest

from tessera.plans import artifact_queries, build_queries, export_queries, graph_queries, tables_queries
from tests.conftest import SMALL

QUERIES = {**tables_queries.QUERIES, **graph_queries.QUERIES, **artifact_queries.QUERIES, **export_queries.QUERIES, **build_queries.QUERIES}
SQL = {**tables_queries.SQL, **graph_queries.SQL, **artifact_queries.SQL, **export_queries.SQL, **build_queries.SQL}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SMALL}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def shown(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([shown(x) for x in v])
    return repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(shown, r)) for r in df.select(*columns).collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    theirs = sorted(tuple(map(shown, r)) for r in duck.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall())
    assert ours == theirs
