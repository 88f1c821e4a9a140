"""Dates, times of day and timestamps.

A time of day is a bigint count of seconds since midnight; ``time_text``
renders it. Ranges are closed forms over the row index, so any row can be
computed without the rows before it.
"""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.draws import bits, int_div, slot

DAY_SECONDS = 86_400

# Units by name, in months, days or microseconds.
MONTH_UNITS = {"MONTHS": 1, "YEARS": 12, "DECADES": 120, "CENTURIES": 1200, "MILLENNIA": 12000}
DAY_UNITS = {"DAYS": 1, "WEEKS": 7}
MICRO_UNITS = {
    "MICROS": 1, "MILLIS": 1000, "SECONDS": 10**6, "MINUTES": 60 * 10**6, "HOURS": 3600 * 10**6,
    "HALF_DAYS": 12 * 3600 * 10**6,
}


def _unit(name: str, *allowed: dict) -> tuple[dict, int]:
    for table in allowed:
        if name.upper() in table:
            return table, table[name.upper()]
    raise ValueError(f"unit {name} does not fit this type")


# -- random values around an anchor ---------------------------------------------


def _signed(draw: Column, n: int) -> Column:
    """Uniform in (-n, n), built from a fair sign and a magnitude below n."""
    size = int_div(bits(draw), 2) % F.lit(n).cast("bigint")
    return F.when(bits(draw) % 2 == 0, size).otherwise(-size)


def random_date(draw: Column, anchor: Column) -> Column:
    return F.date_add(anchor, _signed(draw, 90).cast("int"))


def random_time(draw: Column, anchor_seconds: Column) -> Column:
    return F.pmod(anchor_seconds + _signed(draw, 24) * 3600, F.lit(DAY_SECONDS).cast("bigint"))


def random_datetime(draw: Column, anchor: Column) -> Column:
    days = F.timestamp_add("DAY", _signed(slot(draw, 1), 90).cast("int"), anchor)
    return F.timestamp_add("HOUR", _signed(slot(draw, 2), 24).cast("int"), days)


# -- current values ---------------------------------------------------------------


def current_date() -> Column:
    return F.current_date()


def current_time() -> Column:
    return seconds_of_day(F.localtimestamp())


def current_datetime() -> Column:
    return F.localtimestamp()


# -- times of day -------------------------------------------------------------------


def seconds_of_day(moment: Column) -> Column:
    return (F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)).cast("bigint")


def parse_time(text: str) -> int:
    """Seconds since midnight of an ISO time literal."""
    t = dt.time.fromisoformat(text)
    return t.hour * 3600 + t.minute * 60 + t.second


def time_text(seconds: Column) -> Column:
    hours, minutes, rest = int_div(seconds, 3600), int_div(seconds, 60) % 60, seconds % 60
    return F.concat_ws(":", *[F.lpad(part.cast("string"), 2, "0") for part in (hours, minutes, rest)])


# -- arithmetic -----------------------------------------------------------------------


def plus_date(value: Column, amount: Column | int, unit: str) -> Column:
    """Add to a date; month steps clamp to the end of the month, time units are refused."""
    table, factor = _unit(unit, MONTH_UNITS, DAY_UNITS)
    count = (_amount(amount) * factor).cast("int")
    return F.add_months(value, count) if table is MONTH_UNITS else F.date_add(value, count)


def plus_time(seconds: Column, amount: Column | int, unit: str) -> Column:
    """Add to a time of day in whole seconds, wrapping at midnight; date units and units below a second are refused."""
    _, micros = _unit(unit, MICRO_UNITS)
    if micros % 10**6:
        raise ValueError(f"a time of day holds whole seconds, not {unit}")
    return F.pmod(seconds.cast("bigint") + _amount(amount) * F.lit(micros // 10**6).cast("bigint"), F.lit(DAY_SECONDS).cast("bigint"))


def plus_datetime(value: Column, amount: Column | int, unit: str) -> Column:
    table, factor = _unit(unit, MONTH_UNITS, DAY_UNITS, MICRO_UNITS)
    if table is MICRO_UNITS:
        whole, name = (factor // 10**6, "SECOND") if factor % 10**6 == 0 else (factor, "MICROSECOND")
        return F.timestamp_add(name, _amount(amount) * F.lit(whole).cast("bigint"), value)
    name = "MONTH" if table is MONTH_UNITS else "DAY"
    return F.timestamp_add(name, (_amount(amount) * factor).cast("int"), value)


def _amount(amount: Column | int) -> Column:
    return (amount if isinstance(amount, Column) else F.lit(amount)).cast("bigint")


# -- ranges over the row index ----------------------------------------------------------


def _position(row: Column, cycle: int | None) -> Column:
    """Steps from the start: the first row is one step in; a cycle starts over at its origin."""
    ahead = row + 1
    return ahead if cycle is None else ahead % F.lit(cycle).cast("bigint")


def _step(step: int | None) -> int:
    step = 1 if step is None else step
    if step <= 0:
        raise ValueError("step must be positive")
    return step


def _clamped(day: dt.date, months: int) -> dt.date:
    total = day.year * 12 + day.month - 1 + months
    year, month = divmod(total, 12)
    return dt.date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


def _month_walk(start: dt.date, months: int, end: dt.date | None) -> tuple[list[tuple[int, dt.date]], int | None]:
    """Repeated month steps, where a clamped day stays clamped.

    Returns the few steps at which the day of month drops, each with the date
    reached, and the cycle length up to ``end``. Without an end, one full
    400-year calendar cycle is walked, after which the day cannot drop again.
    """
    drops, day, n = [(0, start)], start, 0
    limit = 4800 if end is None else None
    while limit is None or n < limit:
        year_month = day.year * 12 + day.month - 1 + months
        if year_month // 12 > 9999:
            break
        after = _clamped(day, months)
        if end is not None and after > end:
            break
        n += 1
        if after.day != day.day:
            drops.append((n, after))
        day = after
    return drops, None if end is None else n + 1


def _walk_column(position: Column, drops: list[tuple[int, dt.date]], months: int) -> Column:
    def leg(at: int, day: dt.date) -> Column:
        return F.add_months(F.lit(day), ((position - at) * months).cast("int"))

    out = leg(*drops[0])
    for at, day in drops[1:]:
        out = F.when(position >= at, leg(at, day)).otherwise(out)
    return out


def date_range(row: Column, start: dt.date, end: dt.date | None = None, step: int | None = 1, unit: str = "DAYS") -> Column:
    """Dates stepping from ``start``; past ``end`` the walk starts over."""
    step = _step(step)
    if end is not None and end < start:
        raise ValueError("range ends before it starts")
    table, factor = _unit(unit, DAY_UNITS, MONTH_UNITS)
    if table is MONTH_UNITS:
        drops, cycle = _month_walk(start, step * factor, end)
        return _walk_column(_position(row, cycle), drops, step * factor)
    days = step * factor
    cycle = None if end is None else (end - start).days // days + 1
    return F.date_add(F.lit(start), (_position(row, cycle) * days).cast("int"))


def time_range(row: Column, start: int, end: int | None = None, step: int | None = 1, unit: str = "SECONDS") -> Column:
    """Seconds of day stepping from ``start``; wraps at midnight or starts over past ``end``."""
    _, micros = _unit(unit, MICRO_UNITS)
    if micros % 10**6:
        raise ValueError("times of day step by whole seconds")
    if end is not None and end < start:
        raise ValueError("range ends before it starts")
    seconds = _step(step) * (micros // 10**6)
    if end is None:
        # The walk repeats after one day's worth of steps at most, which also keeps the product small.
        return (_position(row, DAY_SECONDS) * seconds + start) % F.lit(DAY_SECONDS).cast("bigint")
    return _position(row, (end - start) // seconds + 1) * seconds + F.lit(start).cast("bigint")


def datetime_range(
    row: Column, start: dt.datetime, end: dt.datetime | None = None, step: int | None = 1, unit: str = "DAYS"
) -> Column:
    step = _step(step)
    if end is not None and end < start:
        raise ValueError("range ends before it starts")
    table, factor = _unit(unit, MONTH_UNITS, DAY_UNITS, MICRO_UNITS)
    origin = F.lit(start.isoformat(" ")).cast("timestamp_ntz")
    if table is MONTH_UNITS:
        last = None
        if end is not None:
            last = end.date() if end.time() >= start.time() else end.date() - dt.timedelta(days=1)
        drops, cycle = _month_walk(start.date(), step * factor, last)
        day = _walk_column(_position(row, cycle), drops, step * factor)
        clock = dt.datetime.combine(dt.date.min, start.time()) - dt.datetime.min
        micros = clock // dt.timedelta(microseconds=1)
        return F.timestamp_add("MICROSECOND", F.lit(micros).cast("bigint"), day.cast("timestamp_ntz"))
    micros = step * factor * (DAY_SECONDS * 10**6 if table is DAY_UNITS else 1)
    cycle = None if end is None else (end - start) // dt.timedelta(microseconds=micros) + 1
    name, size = ("SECOND", micros // 10**6) if micros % 10**6 == 0 else ("MICROSECOND", micros)
    return F.timestamp_add(name, _position(row, cycle) * F.lit(size).cast("bigint"), origin)
