"""Every query of the catalogue against its SQL on the smallest tables, and the driver's contract."""

import os
import re

import pytest

import __spark_entry__
from quillon.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(re.sub(r"datetime\.date\((\d+), (\d+), (\d+)\)", r"\1-\2-\3", str(tuple(r))) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(df.select(*[f"`{c}`" for c in columns]).collect())
    cursor = con.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({catalog.oracle_sql()[name]}) q")
    assert got == plain(cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_every_oracle_has_rows():
    """At the scale that the driver compares, no query is compared over nothing."""
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    empty = [name for name, sql in catalog.oracle_sql().items() if not c.execute(f"SELECT count(*) FROM ({sql}) q").fetchone()[0]]
    assert not empty
