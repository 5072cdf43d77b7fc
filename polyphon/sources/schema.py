"""Flat schemas from short text, usable before a session exists."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
}


def flat_schema(text: str) -> T.StructType:
    """``"a long, b string"`` as a schema of nullable columns."""
    fields = [f.split() for f in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])
