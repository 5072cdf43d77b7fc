"""Column steps from SQL text.

A wide step (a model with a hundred constants, fifty running sums) is given to
Spark as one list of SQL expressions. Building the same columns one function
call at a time would spend seconds on the driver for every plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def add(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Append new columns, all in one step."""
    return df.selectExpr("*", *[f"{e} AS {name(c)}" for c, e in columns.items()])


def replace(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Give existing columns new values, all in one step; they move to the end."""
    kept = [name(c) for c in df.columns if c not in columns]
    return df.selectExpr(*kept, *[f"{e} AS {name(c)}" for c, e in columns.items()])
