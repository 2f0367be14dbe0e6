"""Registered queries: a Spark plan, the columns it returns and, where SQL can say it, the same
result in plain SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def _columns(spec: str) -> list[tuple[str, int | None]]:
    out = []
    for item in spec.split():
        name, _, digits = item.partition(":")
        out.append((name, int(digits) if digits else None))
    return out


def query(name: str, columns: str, sql: str | None = None):
    """Register a query.  ``columns`` lists the output; ``x:6`` compares a double at 6 decimals
    (adding 0.0 turns a negative zero into zero on both engines)."""
    cols = _columns(columns)

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.select(
                *[
                    F.col(n) if d is None else (F.round(F.col(n).cast("double"), d) + F.lit(0.0)).alias(n)
                    for n, d in cols
                ]
            )

        text = None
        if sql is not None:
            picks = ", ".join(n if d is None else f"round(CAST({n} AS DOUBLE), {d}) + 0.0 AS {n}" for n, d in cols)
            text = f"SELECT {picks} FROM ({sql}) AS q"
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = Query(name, run, text)
        return fn

    return wrap
