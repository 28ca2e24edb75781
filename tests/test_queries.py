"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from tidewright.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"dsir_fit", "dsir_sweep"}  # fitted on small features in test_operators


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, decimal.Decimal):
        return int(x) if x == int(x) else round(float(x), 6)
    return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


def rows(got):
    return sorted(([plain(x) for x in r] for r in got), key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in SLOW])
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = rows(df.select(*[f"`{c}`" for c in cols]).collect())
    if name in registry.SQL:
        rel = con.sql(registry.SQL[name])
        assert sorted(rel.columns) == cols
        assert got == rows(con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({registry.SQL[name]})").fetchall())
    else:
        assert got


def test_only_operators_that_sql_cannot_express_have_none():
    assert set(registry.QUERIES) - set(registry.SQL) == {"kmeans", "dsir_fit", "dsir_sweep"}
