"""Time columns as epoch milliseconds, whatever the session time zone is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import TimestampNTZType


def epoch_ms(df: DataFrame, name: str) -> Column:
    """Milliseconds since 1970 of a timestamp column.

    A zone-free timestamp is read as UTC. Casting it goes through the session
    zone, so the zone's offset is added back; under UTC that adds nothing.
    """
    if isinstance(df.schema[name].dataType, TimestampNTZType):
        instant = F.from_utc_timestamp(F.col(name).cast("timestamp"), F.current_timezone())
        return F.unix_millis(instant)
    return F.unix_millis(F.col(name))
