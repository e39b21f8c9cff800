"""Column expressions for timestamps.

All expressions work on ``TIMESTAMP_NTZ`` (wall-clock) values, so results do not depend on the
session time zone.  ``TIMESTAMP`` inputs are cast to ``TIMESTAMP_NTZ`` first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000


def epoch() -> Column:
    """1970-01-01 00:00 as a wall-clock timestamp (built lazily: needs an active session)."""
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ntz(col) -> Column:
    return _c(col).cast("timestamp_ntz")


def epoch_micros(col) -> Column:
    """Microseconds since 1970-01-01 00:00 of a wall-clock timestamp (bigint)."""
    return F.timestamp_diff("MICROSECOND", epoch(), ntz(col))


def from_epoch_micros(micros) -> Column:
    return F.timestamp_add("MICROSECOND", _c(micros).cast("bigint"), epoch())


def epoch_hours(col) -> Column:
    """Whole hours since the epoch (floor)."""
    return F.floor(epoch_micros(col) / F.lit(MICROS_PER_HOUR)).cast("bigint")


def from_epoch_hours(hours) -> Column:
    return F.timestamp_add("HOUR", _c(hours).cast("bigint"), epoch())


def round_hour(col) -> Column:
    """Nearest hour, ties to the even hour (00:30 -> 00:00, 01:30 -> 02:00).

    Exact decimal division, so a tie is a tie and one microsecond off a tie is not.
    """
    hours = F.bround(epoch_micros(col).cast("decimal(20,0)") / F.lit(MICROS_PER_HOUR), 0).cast("bigint")
    return F.timestamp_add("HOUR", hours, epoch())


def month_start(col) -> Column:
    c = ntz(col)
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def day_start(col) -> Column:
    c = ntz(col)
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.lit(0), F.lit(0), F.lit(0))


def weekday(col) -> Column:
    """Day of week, Monday = 0."""
    return F.weekday(ntz(col))


def ts_bound(value) -> Column:
    """A literal or string argument as a wall-clock timestamp bound."""
    if isinstance(value, Column):
        return ntz(value)
    return F.lit(str(value)).cast("timestamp_ntz")


def format_minutes(col) -> Column:
    return F.date_format(ntz(col), "yyyy-MM-dd HH:mm")
