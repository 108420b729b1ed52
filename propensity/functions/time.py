"""Time Column helpers (work on ``timestamp`` and ``timestamp_ntz`` alike)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000
MICROS_PER_SECOND = 1_000_000


def as_timestamp(value) -> Column:
    """Column, ``datetime`` or ``'yyyy-MM-dd HH:mm:ss'`` string -> ``timestamp_ntz`` Column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(value)).cast("timestamp_ntz")


def micros_between(start: Column, end: Column) -> Column:
    """Signed microseconds from ``start`` to ``end``."""
    return F.timestamp_diff("MICROSECOND", start, end)


def whole_days(start: Column, end: Column) -> Column:
    """Whole days from ``start`` to ``end``, floored toward -inf (``timedelta.days``).

    Not ``datediff`` (calendar days) and not ``timestampdiff(DAY)`` (truncates).
    """
    return F.floor(micros_between(start, end) / F.lit(float(MICROS_PER_DAY))).cast("bigint")


def seconds_between(start: Column, end: Column) -> Column:
    return micros_between(start, end) / F.lit(float(MICROS_PER_SECOND))


def minus_days(ts: Column, days: float) -> Column:
    """``ts - days`` with fractional days (3.5 d = 84 h) kept exact in microseconds."""
    micros = int(round(days * MICROS_PER_DAY))
    return F.timestamp_add("MICROSECOND", F.lit(-micros), ts)


def in_window(ts: Column, as_of: Column, days: float) -> Column:
    """Half-open window ``as_of - days <= ts < as_of``."""
    return (ts >= minus_days(as_of, days)) & (ts < as_of)


def as_of_date(converted: Column, converted_at: Column, created_at: Column,
               latest_event_at: Column, now, horizon_days: int = 90) -> Column:
    """Point-in-time cut-off of a labelled lead.

    Converted with a date: one day before conversion.  Otherwise the earliest of
    created_at + horizon, now and the latest event (when there is one).
    """
    now_c = as_timestamp(now)
    capped = F.least(F.timestamp_add("DAY", F.lit(horizon_days), created_at), now_c)
    fallback = F.when(latest_event_at.isNull(), capped).otherwise(F.least(capped, latest_event_at))
    return (F.when(F.coalesce(converted, F.lit(False)) & converted_at.isNotNull(),
                   F.timestamp_add("DAY", F.lit(-1), converted_at))
            .otherwise(fallback))
