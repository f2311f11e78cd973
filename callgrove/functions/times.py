"""Time helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (session zone UTC)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))
