"""Every registered query with an oracle gives the oracle's rows."""

import math

import duckdb
import pytest

from ledgerlake.plans import registry
from ledgerlake.plans.fixtures import TABLES


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _text(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(round(v, 9)) if isinstance(v, float) else str(v)[:10] if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == names
    place = [want.columns.index(n) for n in names]
    assert sorted("|".join(_text(r[n]) for n in names) for r in df.collect()) == sorted("|".join(_text(r[i]) for i in place) for r in want.fetchall())


def test_every_query_has_rows_or_a_schema(spark, sf_dir):
    for name in set(registry.QUERIES) - set(registry.ORACLES):
        assert registry.QUERIES[name](spark, sf_dir).columns
