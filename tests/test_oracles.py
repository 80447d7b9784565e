"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from cairn.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def tidy(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted((tuple(tidy(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows(spark, duck, name):
    got = rows(plans.QUERIES[name](spark, SF).toPandas())
    want = rows(duck.execute(plans.SQL[name]).fetchdf())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1], strict=True):
        for x, y in zip(a, b, strict=True):
            if isinstance(x, float) and y is not None:
                assert x == pytest.approx(float(y), abs=2e-6)
            elif x is None or str(x) in ("nan", "<NA>"):
                assert y is None or str(y) in ("nan", "<NA>")
            else:
                assert str(x) == str(y) or float(x) == float(y)
