"""Every query that has SQL gives the rows that DuckDB gives, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from fathom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    plain = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(([plain(v.item() if hasattr(v, "item") else v) for v in row] for row in frame[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    mine, theirs = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
