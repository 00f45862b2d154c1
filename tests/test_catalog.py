import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from callweave.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    columns = sorted(frame.columns)
    cell = lambda v: "NULL" if v is None or v is pd.NA or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return columns, sorted(tuple(cell(v) for v in row) for row in frame[columns].astype(object).values.tolist())


@pytest.fixture(scope="session")
def tables():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return db


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, name):
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    if name in catalog.ORACLES:
        assert rows_of(got) == rows_of(tables.execute(catalog.ORACLES[name]).fetchdf())
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
