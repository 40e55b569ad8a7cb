"""Queries of this subpackage that SQL can express give DuckDB's rows."""

import pytest

from loomsql.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_match(name, spark, duck, data):
    df = registry.queries()[name](spark, data)
    columns = sorted(df.columns)
    rel = duck.sql(registry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(row[i] for i in at) for row in rel.fetchall())


def test_names():
    assert all(n[0] == "p" and n[1] in "12345678" for n in registry.queries()) and set(registry.oracle_sql()) <= set(registry.queries())
