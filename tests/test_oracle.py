"""Every query that has SQL against DuckDB, at the smallest scale."""

import duckdb
import pytest

from skein.plans.registry import ORACLE_SQL, QUERIES, STAR_COLUMNS

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in STAR_COLUMNS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def normal(rows):
    def cell(v):
        return round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    result = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    assert normal([tuple(r[c] for c in columns) for r in found.collect()]) == normal(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    found = QUERIES[name](spark, FOLDER)
    rows = found.collect()
    assert rows and len(rows[0]) == len(found.columns)
