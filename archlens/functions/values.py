"""Times and numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso(moment: Column) -> Column:
    """A time in UTC with milliseconds, ``2024-01-31T08:00:00.000Z``; the session's time zone must be UTC."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def fixed(number: Column, digits: int) -> Column:
    """A number with exactly so many digits behind the point, rounded half up."""
    return F.format_string(f"%.{digits}f", number)
