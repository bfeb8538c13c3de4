"""Column functions over stamps. All assume a session in UTC (see ``session.pin``)."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"microsecond": 1, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}
SECOND, MINUTE, DAY = _UNITS["second"], _UNITS["minute"], _UNITS["day"]
LABEL_FORMAT = "yyyyMMdd-HH:mm:ss"


def micros(length: str | dt.timedelta) -> int:
    """``'15 minutes'`` or a timedelta as microseconds."""
    if isinstance(length, dt.timedelta):
        total = length // dt.timedelta(microseconds=1)
    else:
        match = re.fullmatch(r"\s*(\d+)\s+([a-z]+?)s?\s*", length)
        if not match or match[2] not in _UNITS:
            raise ValueError(f"not a length of time: {length!r}")
        total = int(match[1]) * _UNITS[match[2]]
    if total <= 0:
        raise ValueError(f"length must be positive: {length!r}")
    return total


def floor_div(value: Column, width: int) -> Column:
    """Whole-number division rounding down, also below zero."""
    return ((value - F.pmod(value, F.lit(width))) / width).cast("long")


def parse_exact(text: Column) -> Column:
    """ISO stamp with its seconds and fraction, null where the text is no stamp."""
    return F.try_to_timestamp(text)


def parse_minute(text: Column) -> Column:
    """ISO stamp cut to the minute, null where the text is no stamp."""
    return F.date_trunc("minute", parse_exact(text))


def parse_in_zone(text: Column, zone: str = "America/Los_Angeles") -> Column:
    """Wall-clock text of ``zone`` (fraction and suffix ignored) as a stamp, seconds kept."""
    return F.to_utc_timestamp(F.substring(text, 1, 19).try_cast("timestamp"), zone)


def parse_plain(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text as a stamp."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))


def bin_end(stamp: Column, width: str = "15 minutes") -> Column:
    """End of the half-open bin [start, start + width) that holds the stamp."""
    return F.window(stamp, width)["end"]


def micros_of_day(stamp: Column) -> Column:
    return F.pmod(F.unix_micros(stamp), F.lit(DAY))


def day_start(day: dt.date | str) -> Column:
    """Midnight of a fixed day, or of the day in the named date column."""
    if isinstance(day, str):
        return F.col(day).cast("timestamp")
    return F.lit(dt.datetime.combine(day, dt.time(), dt.timezone.utc))


def label(start: Column, offset: Column) -> Column:
    """Text label of the instant ``offset`` microseconds after ``start``."""
    return F.date_format(F.timestamp_micros(F.unix_micros(start) + offset), LABEL_FORMAT)


def is_weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def weekdays(first: dt.date, last: dt.date, *, weekends: bool = False) -> list[dt.date]:
    """Days from ``first`` to ``last``, both included; Saturdays and Sundays only on request."""
    days = (first + dt.timedelta(days=i) for i in range((last - first).days + 1))
    return [d for d in days if weekends or d.weekday() < 5]
