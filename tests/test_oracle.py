"""Each query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from cardloom.plans import all as _  # noqa: F401
from cardloom.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return c


def plain(v):
    return round(float(v), 9) if isinstance(v, float) or "loat" in type(v).__name__ or type(v).__name__ == "Decimal" else v.item() if hasattr(v, "item") else v


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(repr([plain(v) for v in r]) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, DIR).toPandas()) == rows(duck.execute(registry.ORACLES[name]).df())


def test_queries_without_sql_give_rows(spark):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLES)):
        assert registry.QUERIES[name](spark, DIR).count() > 0, name
