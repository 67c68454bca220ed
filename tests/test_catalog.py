import math

import duckdb
import pytest

from lexmill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "customer", "supplier", "orders", "documents")


def _cell(x):
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else x


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    frame = catalog.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    ours = sorted((tuple(_cell(r[c]) for c in columns) for r in frame.collect()), key=repr)
    cursor = con.execute(catalog.oracle_sql()[name])
    place = {d[0]: k for k, d in enumerate(cursor.description)}
    assert sorted(place) == columns
    theirs = sorted((tuple(_cell(r[place[c]]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert ours == theirs and ours


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
