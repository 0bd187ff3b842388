"""Time helpers; every instant is read in the session zone, UTC."""

from pyspark.sql import Column, functions as F


def instant(value: Column) -> Column:
    """Timestamp with zone, also from zone-less columns."""
    return value.cast("timestamp")


def micros(value: Column) -> Column:
    return F.unix_micros(instant(value))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / 1e6


def days_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / 86400e6


def months_before(as_of: Column, months: int) -> Column:
    """Calendar months back; the day is clamped and the time of day kept."""
    if months <= 0:
        return instant(as_of)
    return instant(as_of) - F.make_ym_interval(F.lit(0), F.lit(months))


def days_after(value: Column, days: int) -> Column:
    return instant(value) + F.make_dt_interval(F.lit(days))


def iso_utc(value: Column) -> Column:
    """ISO text with 'Z'; a fraction only where there is one."""
    at = instant(value)
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(micros(at) % 1_000_000 != 0, F.date_format(at, ".SSSSSS")).otherwise("")
    return F.when(at.isNotNull(), F.concat(whole, fraction, F.lit("Z")))


def parse_instant(text: Column, default: Column | None = None) -> Column:
    """Lenient ISO parse; unreadable text gives ``default``."""
    parsed = F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))
    return parsed if default is None else F.coalesce(parsed, instant(default))
