"""Date expressions."""

from __future__ import annotations

import calendar
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def db_datetime(text: Column) -> Column:
    """RFC 3339, `yyyy-MM-dd HH:mm:ss` or `yyyy-MM-ddTHH:mm:ss`; anything else (a bare date too) is null."""
    full = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:?\d{2})?$")
    return F.when(full, F.try_to_timestamp(F.replace(text, F.lit("T"), F.lit(" "))))


def start_of_day(d: datetime) -> datetime:
    return d.replace(hour=0, minute=0, second=0, microsecond=0)


def end_of_day(d: datetime) -> datetime:
    return d.replace(hour=23, minute=59, second=59, microsecond=0)


def month_range(year: int, month: int) -> tuple[datetime, datetime]:
    last = calendar.monthrange(year, month)[1]
    return datetime(year, month, 1, tzinfo=UTC), datetime(year, month, last, 23, 59, 59, tzinfo=UTC)


def year_range(year: int) -> tuple[datetime, datetime]:
    return datetime(year, 1, 1, tzinfo=UTC), datetime(year, 12, 31, 23, 59, 59, tzinfo=UTC)


def days_before(d: datetime, n: int) -> datetime:
    return d - timedelta(days=n)
