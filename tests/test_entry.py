import os

import duckdb
import pytest

import __spark_entry__ as entry
from hearken.plans import queries

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def rows_of(frame):
    clean = lambda x: None if str(x) in ("nan", "<NA>", "None") else round(float(x), 6) if isinstance(x, (float, int)) or hasattr(x, "dtype") else str(x)
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(map(clean, r))) for r in frame.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    if name in queries.ORACLE_SQL:
        want = duck.sql(queries.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)
    else:
        assert len(got)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
