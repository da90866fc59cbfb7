"""Registry of queries and their oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, SparkSession, functions as F

from visitlens.operators.sizing import checkpoint_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a query under the operator it exercises."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def rounded(column: Column, digits: int = 6) -> Column:
    """Rounded well above summation noise, with no negative zero."""
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def rounded_sql(expression: str, digits: int = 6) -> str:
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/scratch-{uuid.uuid4().hex}"
