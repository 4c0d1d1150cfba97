"""Hybrid-logical-clock ticks: 50 ms steps since 2020, shifted left by 16 bits that count within a step.

Arithmetic is on whole microseconds, so an instant on a step's border is never a step low.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_SECONDS, STEPS_PER_SECOND, COUNTER_BITS = 1_577_836_800, 20, 16


def _div(x: Column, by: int) -> Column:
    """Division of whole numbers, without a detour by doubles."""
    return F.call_function("div", x, F.lit(by).cast("long"))


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp, zoned or not (the session's zone is UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def tick(unix_micros: Column) -> Column:
    """Instants before 2020 give tick 0."""
    steps = _div(unix_micros - EPOCH_SECONDS * 1_000_000, 1_000_000 // STEPS_PER_SECOND)
    return F.shiftleft(F.greatest(F.lit(0).cast("long"), steps), COUNTER_BITS)


def with_offset(tick_: Column, offset: Column | int) -> Column:
    return tick_ + (offset if isinstance(offset, Column) else F.lit(offset))


def seconds(tick_: Column) -> Column:
    """Whole unix seconds."""
    return _div(F.shiftright(tick_, COUNTER_BITS), STEPS_PER_SECOND) + EPOCH_SECONDS


def millis(unix_micros: Column) -> Column:
    """Whole milliseconds, rounded down before 1970 as well."""
    return _div(unix_micros - F.pmod(unix_micros, F.lit(1000).cast("long")), 1000)


def seconds_exact(tick_: Column) -> Column:
    return F.shiftright(tick_, COUNTER_BITS) / F.lit(float(STEPS_PER_SECOND)) + F.lit(float(EPOCH_SECONDS))


def utc_time(tick_: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of a tick."""
    return F.date_format(F.timestamp_seconds(seconds(tick_)), "yyyy-MM-dd HH:mm:ss")


def next_after(seen: Column, now: Column) -> Column:
    """The clock's next value: now, or one past the largest tick seen where that is ahead of now."""
    return F.when(seen > now, seen + 1).otherwise(now)
