"""Every candle query against its SQL, on the small tables."""

import duckdb
import pandas as pd
import pytest

from tests.conftest import DATA
from tidemark.plans import registry


def rows(frame, columns):
    tidy = lambda v: None if v is None or pd.isna(v) else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(tidy(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in (DATA / "sf0.01").glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, str(DATA / "sf0.01")).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_entry_works_alone(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[0] == "symbol"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
