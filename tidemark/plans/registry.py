"""Named queries of the engine and the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: round(x, digits) + 0.0 in an oracle.
ROUND = re.compile(r"round\(((?:(?!round\().)*?), (\d+)\) \+ 0\.0", re.S)


def nudged(sql: str) -> str:
    """Rounding that does not hang on the last bits: values at a tie are lifted over it, as rounded() does."""
    return ROUND.sub(lambda m: f"round({m[1]} + 1e-{int(m[2]) + 3}, {m[2]}) + 0.0", sql)


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name, with its oracle if SQL can express it."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = nudged(sql)
        return fn

    return add


def rounded(df: DataFrame, columns: str, digits: int = 6) -> DataFrame:
    """Floats rounded for comparison: sums in another order differ in the last bits. No negative zero."""
    return df.withColumns({c: F.round(F.col(c) + F.lit(10.0 ** -(digits + 3)), digits) + F.lit(0.0) for c in columns.split()})


def sql_rounded(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns.split())
