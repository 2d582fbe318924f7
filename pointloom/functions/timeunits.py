"""Calendar units: whole-unit distances, shifts and truncation of zone-free timestamps."""

from __future__ import annotations

from datetime import datetime, timedelta
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Unit(Enum):
    YEARS = "YEAR"
    MONTHS = "MONTH"
    DAYS = "DAY"
    HOURS = "HOUR"
    MINUTES = "MINUTE"
    SECONDS = "SECOND"

    @classmethod
    def of(cls, name: str | Unit) -> Unit:
        """The unit of that name; unlike a silent default, an unknown name is an error."""
        if isinstance(name, cls):
            return name
        try:
            return cls[str(name).upper()]
        except KeyError:
            raise ValueError(f"no such time unit: {name}") from None


_MICROS = {Unit.HOURS: 3_600_000_000, Unit.MINUTES: 60_000_000, Unit.SECONDS: 1_000_000}


def whole_months(a: Column, b: Column) -> Column:
    """Signed whole months from a's to b's date; the end of a month gets no leniency."""
    months = (F.year(b) * 12 + F.month(b)) - (F.year(a) * 12 + F.month(a))
    late = (months > 0) & (F.dayofmonth(b) < F.dayofmonth(a))
    early = (months < 0) & (F.dayofmonth(b) > F.dayofmonth(a))
    return months - late.cast("int") + early.cast("int")


def distance(unit: str | Unit, a: Column, b: Column) -> Column:
    """Absolute distance in whole units (bigint): by dates down to days, by elapsed time below."""
    unit = Unit.of(unit)
    if unit is Unit.MONTHS:
        return F.abs(whole_months(a, b)).cast("bigint")
    if unit is Unit.YEARS:
        return F.floor(F.abs(whole_months(a, b)) / 12).cast("bigint")
    if unit is Unit.DAYS:
        return F.abs(F.datediff(F.to_date(b), F.to_date(a))).cast("bigint")
    return F.abs(F.timestamp_diff(unit.value, a, b)).cast("bigint")


def shift(unit: str | Unit, t: Column, n: Column | int) -> Column:
    """t moved by n units of calendar arithmetic (a shorter month's end is kept to)."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.timestamp_add(Unit.of(unit).value, n.cast("int"), t)


def unit_micros(unit: str | Unit) -> int | None:
    """Microseconds of a unit of fixed length; None for months and years."""
    unit = Unit.of(unit)
    return 86_400_000_000 if unit is Unit.DAYS else _MICROS.get(unit)


def micros(t: Column | datetime | None) -> Column:
    """Microseconds since 1970 of a zone-free time; null for none."""
    if t is None:
        return F.lit(None).cast("bigint")
    if isinstance(t, datetime):
        return F.lit((t - datetime(1970, 1, 1)) // timedelta(microseconds=1)).cast("bigint")
    return F.timestamp_diff("MICROSECOND", _epoch(), t)


def _whole(n: Column, size: int) -> Column:
    return n if size == 1 else F.call_function("div", n, F.lit(size).cast("bigint"))


def day_of(moment: Column) -> Column:
    """Days since 1970 of micros()."""
    day = F.lit(unit_micros(Unit.DAYS)).cast("bigint")
    return _whole(moment - F.pmod(moment, day), unit_micros(Unit.DAYS))


def clock(unit: str | Unit, t: Column) -> Column:
    """A whole number for a time, so that clock_distance() of two is distance() of their times.

    It is worked out once per point; calendar functions per pair cost more than all the rest of a pair.
    """
    unit = Unit.of(unit)
    if unit in (Unit.YEARS, Unit.MONTHS):
        return ((F.year(t) * 12 + F.month(t)) * 32 + F.dayofmonth(t)).cast("bigint")
    return day_of(micros(t)) if unit is Unit.DAYS else micros(t)


def clock_distance(unit: str | Unit, a: Column, b: Column) -> Column:
    # a month has 32 steps, more than its days
    size = {Unit.YEARS: 12 * 32, Unit.MONTHS: 32, Unit.DAYS: 1} | _MICROS
    return _whole(F.abs(b - a), size[Unit.of(unit)])


def free_units(unit: str | Unit, t: Column, t0: Column, t1: Column, most: int) -> Column:
    """Whole units, most at most, by which a time can move either way and stay from t0 to t1; -1 for one outside."""
    unit = Unit.of(unit)

    def upto(a: Column, b: Column, sign: int) -> Column:
        if unit in (Unit.YEARS, Unit.MONTHS):
            n = _whole(((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("bigint"), 12 if unit is Unit.YEARS else 1)
        else:
            n = F.timestamp_diff(unit.value, a, b)
        n = F.least(n, F.lit(most).cast("bigint"))
        moved = shift(unit, t, n * sign)
        # within the last month it is the day that decides
        return n - ((moved < t0) | (moved > t1)).cast("bigint")

    return F.when((t < t0) | (t > t1), F.lit(-1).cast("bigint")).otherwise(F.least(upto(t0, t, -1), upto(t, t1, 1)))


def truncate(unit: str | Unit, t: Column) -> Column:
    return F.date_trunc(Unit.of(unit).value, t).cast("timestamp_ntz")


def _epoch(text: str = "1970-01-01") -> Column:
    return F.lit(text).cast("timestamp_ntz")


def from_epoch_ms(ms: Column, zone: str = "UTC") -> Column:
    """Wall-clock time of a zone at milliseconds since 1970, whatever the session's zone."""
    utc = F.timestamp_add("MILLISECOND", ms, _epoch())
    return utc if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def to_epoch_ms(t: Column, zone: str = "UTC") -> Column:
    """Milliseconds since 1970 of a zone's wall-clock time."""
    utc = t if zone == "UTC" else F.convert_timezone(F.lit(zone), F.lit("UTC"), t)
    return F.timestamp_diff("MILLISECOND", _epoch(), utc)


def seconds_of(t: Column) -> Column:
    """Whole seconds since the year 1, from the zone-free time alone."""
    return F.timestamp_diff("SECOND", _epoch("0001-01-01"), t)


def longest_seconds(unit: str | Unit, n: int) -> int:
    """Seconds of the longest stretch that n units of calendar arithmetic can span."""
    unit = Unit.of(unit)
    if unit in (Unit.YEARS, Unit.MONTHS):
        return n * (366 if unit is Unit.YEARS else 31) * 86_400
    return n * (86_400 if unit is Unit.DAYS else _MICROS[unit] // 1_000_000)
