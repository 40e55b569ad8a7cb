"""Every query that SQL can express gives DuckDB's rows."""

import decimal
import math

import pytest

from loomsql import plans

ORACLES = plans.oracle_sql()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        if isinstance(v, float) and math.isnan(v):
            return "nan"
        return f"{v:.6g}" if v != int(v) or abs(v) > 1e15 else str(int(v))
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_match(name, spark, duck, data):
    df = plans.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted(tuple(plain(row[i]) for i in at) for row in rel.fetchall())
    assert got == want


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(plans.queries())
