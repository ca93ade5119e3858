"""Timestamps in seconds: of texts, timestamps, numbers; UTC where none is given."""

from __future__ import annotations

from datetime import datetime, timezone
from numbers import Real
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def seconds(c: Column, kind: T.DataType) -> Column:
    """Seconds since 1970 of a column; what can't be read is null.

    Text is ISO 8601; times without zone are in the session's zone (the engine's sessions use
    UTC); numbers are seconds already.
    """
    if isinstance(kind, T.StringType):
        return F.unix_micros(F.try_to_timestamp(c)) / 1e6
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")) / 1e6
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    return F.lit(None).cast("double")


def one(value: Any) -> float | None:
    """The same for a single value on the driver."""
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value.replace("Z", "+00:00"))
        except ValueError:
            return None
    if isinstance(value, datetime):
        return (value if value.tzinfo else value.replace(tzinfo=timezone.utc)).timestamp()
    return float(value) if isinstance(value, Real) else None


def normalised(metadata: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Copies of metadata dicts with `timestamp` in seconds or None."""
    return [{**m, "timestamp": one(m.get("timestamp"))} for m in metadata]
