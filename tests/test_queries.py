"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import pytest

from graftline import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def canonical(rows, columns):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        return repr(round(v, 6)) if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    ours = canonical([tuple(r) for r in df.collect()], df.columns)
    spark.catalog.clearCache()
    if name not in registry.ORACLE_SQL:
        assert ours
        return
    cursor = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert ours == canonical(cursor.fetchall(), columns)
