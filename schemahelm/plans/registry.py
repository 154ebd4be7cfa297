"""The queries that can be run by name, each with its oracle statement where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemahelm.plans.fixtures import Inputs, with_views

_QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Inputs], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"duplicate query: {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = with_views(sql)
        return fn

    return register


def load_all() -> None:
    from schemahelm.plans import (  # noqa: F401
        access, audit, changes, defaults, labels, metrics, quality, rules, scans, snapshots, streams, types, upserts,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()
    return {name: (lambda spark, sf_dir, fn=fn: fn(Inputs(spark, sf_dir))) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(_ORACLES)


def ts_text(c: Column | str) -> Column:
    """Timestamp as text with microseconds, the same in both engines."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def ts_sql(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def joined(c: Column | str) -> Column:
    """Array as one text."""
    return F.array_join(c, ",")


def case_sql(expr: str, table: dict[str, list[str]], default: str = "NULL") -> str:
    whens = " ".join(
        f"WHEN {expr} IN ({', '.join(repr(n) for n in names)}) THEN '{result}'" for result, names in table.items()
    )
    return f"CASE {whens} ELSE {default} END"
