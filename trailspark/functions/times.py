"""Exact time arithmetic on TIMESTAMP_NTZ columns.

Differences go through ANSI intervals: no zone is involved, and the result is
whole microseconds, so sums do not depend on the order of addition.
"""

from datetime import datetime

from pyspark.sql import Column, functions as F

MICROS = 1_000_000


def micros_between(start: Column, end: Column) -> Column:
    seconds = (end - start).cast("interval second").cast("decimal(18,6)")
    return (seconds * F.lit(MICROS)).cast("bigint")


def micros_to_seconds(micros: Column) -> Column:
    return micros / F.lit(float(MICROS))


def seconds_between(start: Column, end: Column) -> Column:
    return micros_to_seconds(micros_between(start, end))


def as_ntz(moment: str | datetime) -> Column:
    """Literal UTC moment without zone."""
    text = moment if isinstance(moment, str) else moment.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def interval(text: str) -> Column:
    """``'12 hours'`` style day-time interval."""
    amount, unit = text.split()
    return F.expr(f"INTERVAL '{int(amount)}' {unit.rstrip('s').upper()}")


def interval_micros(text: str) -> int:
    amount, unit = text.split()
    size = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
    return int(float(amount) * size[unit.rstrip("s")] * MICROS)


def time_cell(ts: Column, width: str) -> Column:
    """Number of the fixed-width time cell a timestamp falls in; grows with time."""
    epoch = as_ntz("1970-01-01 00:00:00")
    return F.floor(micros_between(epoch, ts) / F.lit(interval_micros(width)))
