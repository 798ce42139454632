"""Date and time expressions, independent of the session time zone."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "1970-01-01 00:00:00"


def _since_epoch(seconds: Column) -> Column:
    zero = F.lit(0)
    return F.to_timestamp_ntz(F.lit(_EPOCH)) + F.make_dt_interval(zero, zero, zero, seconds)


def from_epoch_millis(col: Column | str) -> Column:
    """Epoch milliseconds to a UTC wall-clock timestamp, milliseconds kept."""
    millis = F.col(col) if isinstance(col, str) else col
    return _since_epoch((millis.cast("decimal(18,0)") / F.lit(1000)).cast("decimal(18,6)"))


def from_epoch_millis_whole_seconds(col: Column | str) -> Column:
    """Epoch milliseconds to a UTC wall-clock timestamp, cut to whole seconds (towards zero)."""
    millis = F.col(col) if isinstance(col, str) else col
    seconds = ((millis - F.try_mod(millis, F.lit(1000))) / F.lit(1000)).cast("decimal(18,6)")
    return _since_epoch(seconds)


def as_timestamp(col: Column | str, data_type: str) -> Column:
    """A point in time from epoch milliseconds, text or a time column; unreadable text is null."""
    value = F.col(col) if isinstance(col, str) else col
    if data_type in ("bigint", "int", "smallint", "tinyint", "double", "float") or data_type.startswith("decimal"):
        return from_epoch_millis(value)
    if data_type == "string":
        return value.try_cast("timestamp_ntz")
    return value


def year_end(year: Column) -> Column:
    """31 December of the year."""
    return F.make_date(year.cast("int"), F.lit(12), F.lit(31))


def month_end(year: Column, month: Column) -> Column:
    """Last day of the month."""
    return F.last_day(F.make_date(year.cast("int"), month.cast("int"), F.lit(1)))


def shift_months(day: dt.date, months: int) -> dt.date:
    """The same day some months away, clamped to the end of a shorter month."""
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    last = calendar.monthrange(year, month + 1)[1]
    return dt.date(year, month + 1, min(day.day, last))


def as_of_dates(base: dt.date, months: int = 24) -> list[dt.date]:
    """Month-spaced dates before ``base``, oldest first; each is counted from the base itself."""
    return [shift_months(base, back - months) for back in range(months)]
