"""Time features of a record. Hours and weekdays are read in the session time zone (pinned to UTC)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TEMPORAL_FEATURES = ("hour_of_day", "is_night", "day_of_week", "is_weekend")
DAY_NAMES = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")

# Stand-ins for a timestamp that cannot be read.
DEFAULT_HOUR = 12
DEFAULT_WEEKDAY = 2


# An offset after a time of day; the written hour counts, whatever the zone.
_OFFSET = r"(\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*(?:[zZ]|[+-]\d{2}(?::?\d{2})?)$"


def parse_ts(col: Column, formats: Sequence[str] = ()) -> Column:
    """Lenient parse: anything unreadable becomes null. Timestamps pass through.

    An offset is dropped, so hours are those that are written. ``formats`` are further layouts, tried in order.
    """
    written = F.regexp_replace(F.trim(col.cast("string")), _OFFSET, "$1")
    return F.coalesce(F.try_to_timestamp(written), *(F.try_to_timestamp(written, F.lit(f)) for f in formats))


def hour_of_day(ts: Column) -> Column:
    return F.coalesce(F.hour(ts), F.lit(DEFAULT_HOUR))


def is_night(ts: Column) -> Column:
    """22:00 to 06:59."""
    return F.coalesce((F.hour(ts) >= 22) | (F.hour(ts) <= 6), F.lit(False)).cast("int")


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.coalesce(F.weekday(ts), F.lit(DEFAULT_WEEKDAY))


def is_weekend(ts: Column) -> Column:
    return F.coalesce(F.weekday(ts) >= 5, F.lit(False)).cast("int")


def temporal_features(ts: Column) -> list[Column]:
    """The four time features of a timestamp column, in feature order."""
    exprs = (hour_of_day(ts), is_night(ts), day_of_week(ts), is_weekend(ts))
    return [e.alias(name) for e, name in zip(exprs, TEMPORAL_FEATURES)]


def bool_feature(col: Column) -> Column:
    """Null and false are 0."""
    return F.coalesce(col, F.lit(False)).cast("int")
