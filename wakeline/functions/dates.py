"""Days and times as column expressions, all in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_day(epoch) -> Column:
    return F.to_date(F.timestamp_seconds(F.col(epoch) if isinstance(epoch, str) else epoch))


def days_between(start: str, end: str, pattern: str = "dd.MM.yyyy") -> Column:
    """All days of a closed range."""
    return F.explode(F.sequence(F.to_date(F.lit(start), pattern), F.to_date(F.lit(end), pattern)))


def local_time(epoch, offset: str = "+10:00") -> Column:
    return F.from_utc_timestamp(F.timestamp_seconds(F.col(epoch)), offset)


def file_day(name) -> Column:
    """The day in an archive file's name (DD.MM.YYYY_...json); null where the name has another form."""
    return F.try_to_date(F.nullif(F.regexp_extract(F.col(name) if isinstance(name, str) else name, r"(\d{2}\.\d{2}\.\d{4})_[^/]*\.json$", 1), F.lit("")), "dd.MM.yyyy")
