"""Named queries over the test tables, each with its DuckDB oracle.

``@query(name, sql)`` registers a builder ``(spark, sf_dir) -> DataFrame``;
``sql`` is written over the canonical tables (students, courses, ...) and gets
the adapter CTEs prepended, or is ``None`` for operators SQL cannot express
(those are checked against brute force in ``tests/``).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import functions as F

from campusflow.plans.oracle import with_canonical

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

# Fixed clocks for as_of-driven queries: courses start in Jan-Feb 2024,
# orders and order lines run 1995-2001.
AS_OF_COURSES = "2024-01-15 06:00:00"
AS_OF_SALES = "2001-06-15 12:00:00"


def _wall_clock(df):
    """Timestamps leave as TIMESTAMP_NTZ (UTC wall clock), the type the oracle returns."""
    if not any(f.dataType.simpleString() == "timestamp" for f in df.schema.fields):
        return df
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name)
                       if f.dataType.simpleString() == "timestamp" else F.col(f.name)
                       for f in df.schema.fields])


def query(name: str, sql: str | None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def built(spark, sf_dir):
            return _wall_clock(fn(spark, sf_dir))

        QUERIES[name] = built
        if sql is not None:
            ORACLES[name] = with_canonical(sql)
        return fn
    return deco
