"""Every operator as a query over the driver tables, next to its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def half_even(sql: str) -> str:
    """``round(x, n)`` as the half-even rounding of the binary product, which both engines share."""
    start = 0
    while (at := sql.find("round(", start)) >= 0:
        depth, end = 1, at + len("round(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner, digits = sql[at + len("round("):end - 1].rsplit(",", 1)
        scaled = f"(round_even(({inner}) * 1e{digits.strip()}, 0) / 1e{digits.strip()})"
        sql = sql[:at] + scaled + sql[end:]
        start = at + len("(round_even((")
    return sql


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is what DuckDB runs on the same tables."""

    def register(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = half_even(sql)
        return query

    return register


def load_all() -> None:
    from checks import (  # noqa: F401
        alerting, catalogs, classifying, cycles, ingesting, markets, payloads, reporting, streams, texts,
    )
