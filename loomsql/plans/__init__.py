from . import constructs, events, meta, nested, tpch  # noqa: F401
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql if isinstance(sql, str) else sql() for name, sql in ORACLES.items()}
