"""Every query with an oracle gives the rows of its SQL."""

import duckdb
import pytest

from concordia.plans import catalogue

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return con


def rows(df):
    return sorted(map(tuple, df[sorted(df.columns)].astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, duck, name):
    got, want = catalogue.queries()[name](spark, ROOT).toPandas(), duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) and rows(got) == rows(want)


def test_rows_only(spark):
    for name in set(catalogue.queries()) - set(catalogue.oracle_sql()):
        assert catalogue.queries()[name](spark, ROOT).count() > 0
