"""Every registered core query against its SQL equivalent, on the smallest tables."""

import duckdb
import pytest

from rillstone.plans.catalogue import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def _norm(v):
    return round(v, 4) if isinstance(v, float) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    r = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in r.description]
    df = QUERIES[name](spark, DIR)
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([_norm(x) for x in row]) for row in r.fetchall())
    assert sorted(repr([_norm(x) for x in row]) for row in df.select(*names).collect()) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
