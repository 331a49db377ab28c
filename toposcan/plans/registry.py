"""Registry of catalogue queries: a Spark callable and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from toposcan.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(v)``; ``v(view_name)`` gives the input tables. ``sql`` may use ``{view}`` names."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(partial(views.view, spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = views.oracle(sql)
        return fn

    return deco


def r6(col: Column | str, places: int = 6) -> Column:
    """Rounded double for comparison with the oracle; no negative zero."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), places) + F.lit(0.0)


def q6(expr: str, places: int = 6) -> str:
    """SQL twin of :func:`r6`."""
    return f"(round(CAST({expr} AS DOUBLE), {places}) + CAST(0 AS DOUBLE))"


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: r6(c, places) for c in cols})
