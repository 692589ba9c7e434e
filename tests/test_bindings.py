"""Every bound operator against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from cinnabar.plans.bindings import ORACLES, RULES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in os.listdir(DATA):
        c.sql(f"CREATE VIEW {p.split('.')[0]} AS SELECT * FROM '{DATA}/{p}'")
    return c


def normal(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(repr(round(r[i], 8) if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(RULES))
def test_same_rows(spark, duck, name):
    df = RULES[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert normal(map(tuple, df.collect()), df.columns) == normal(want.fetchall(), want.columns)
