"""Every registered query against its SQL, on the smallest tables."""
import math

import duckdb
import pytest

import __spark_entry__ as entry
from packetloom.plans import catalog

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
# Fits on Spark's learners take long and have no SQL; test_learning.py covers them.
SLOW = {"split_evaluation", "frontier_training", "gate_training", "attributor_training", "chosen_point_test",
        "attribution_test_report"}


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool) or isinstance(x, str):
        return str(x)
    return f"{round(float(x), 9) + 0.0:.9f}"


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=lambda r: [(c is not None, c or "") for c in r])


@pytest.fixture(scope="module")
def con(sf):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf, con, name):
    rows = entry.queries()[name](spark, sf)
    found = con.execute(entry.oracle_sql()[name])
    columns, expected = [d[0] for d in found.description], found.fetchall()
    assert sorted(rows.columns) == sorted(columns)
    assert expected
    assert bag(rows.columns, rows.collect()) == bag(columns, expected)


def test_every_query_without_sql_is_known():
    assert set(catalog.QUERIES) - set(catalog.SQL) == SLOW


def test_entry(spark):
    assert entry.entry(spark).count() > 0
