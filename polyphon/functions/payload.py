"""Instances and models as text payloads, and back."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType, StructField, StructType


def encode_payload(*cols: Column | str) -> Column:
    """Base64 of the JSON form of the given columns, on one line."""
    text = F.base64(F.encode(F.to_json(F.struct(*cols)), "UTF-8"))
    # Depending on a session setting the encoder breaks lines every 76 characters.
    return F.translate(text, "\r\n", "")


def decode_text(payload: Column, schema: StructType) -> Column:
    """Struct from a base64 payload; null when the payload is broken."""
    return decode_bytes(F.try_to_binary(payload, F.lit("base64")), schema)


def decode_bytes(payload: Column, schema: StructType) -> Column:
    """Struct from JSON bytes; null when any part of them does not fit the schema.

    The parser reports such a record in a column of its own, so a valid record
    whose fields are all null is still an instance.
    """
    bad = "_corrupt_record"
    full = StructType([*schema.fields, StructField(bad, StringType())])
    parsed = F.from_json(payload.cast("string"), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    fine = parsed.isNotNull() & parsed[bad].isNull()
    return F.when(fine, F.struct(*(parsed[f].alias(f) for f in schema.fieldNames())))


def decode_payload(kind: Column, text: Column, raw: Column, instance: Column, schema: StructType) -> Column:
    """Instance of a message whose payload is text, bytes or an instance already.

    A broken payload gives null. A kind that is none of the three raises.
    """
    return (
        F.when(kind == "text", decode_text(text, schema))
        .when(kind == "bytes", decode_bytes(raw, schema))
        .when(kind == "instance", instance)
        .otherwise(F.raise_error(F.concat(F.lit("cannot decode payload kind "), F.coalesce(kind, F.lit("null")))))
    )
