"""Time arithmetic on TIMESTAMP_NTZ columns, in whole microseconds.

The session time zone must be UTC (see ``pulseweave.session``); the cast to a
zoned timestamp is then an identity and every difference is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(_col(ts).cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def plus_micros(ts, us) -> Column:
    return from_micros(micros(ts) + us)


def hours_between(start, end) -> Column:
    return (micros(end) - micros(start)) / F.lit(float(HOUR))


def minutes(us: Column) -> Column:
    return us / F.lit(float(MINUTE))


def floor_div(a: Column, b) -> Column:
    """Integer floor division, also right for negative ``a`` (``div`` truncates)."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a - F.pmod(a, b), b)


def ceil_div(a: Column, b) -> Column:
    return -floor_div(-a, b)


def micros_of(seconds: float) -> int:
    """A width in seconds as whole microseconds."""
    return int(round(seconds * SECOND))
