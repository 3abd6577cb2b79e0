"""Calendars: closed day intervals by cyclic steps, with leap-day rules, and aggregation windows."""

from __future__ import annotations

import calendar
from collections.abc import Iterator
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

#: A calendar of more intervals is taken for a mistake.
LIMIT = 365_000
UNITS = ("days", "weeks", "months", "years")
DAY = timedelta(days=1)


def is_leap(year: int) -> bool:
    """By the calendar's rule, so 1900 and 2100 are common years."""
    return calendar.isleap(year)


def steps_of(step: int | str | list[int]) -> list[int]:
    """A step, a list of steps or a comma-joined string of them, to be used in turn."""
    if isinstance(step, str):
        step = step.split(",")
    return [int(x) for x in step] if isinstance(step, (list, tuple)) else [int(step)]


def shift(day: date, unit: str, n: int) -> date:
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit}")
    if unit in ("days", "weeks"):
        return day + timedelta(days=n * (7 if unit == "weeks" else 1))
    months = day.year * 12 + day.month - 1 + n * (12 if unit == "years" else 1)
    year, month = divmod(months, 12)
    return date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


def _day(value: str | date, fmt: str) -> date:
    return datetime.strptime(value, fmt).date() if isinstance(value, str) else value


def date_range(start: str | date, end: str | date, unit: str, step: int | str | list[int], offset: int | str | list[int] = 0, ignore_29feb: bool = True, fmt: str = "%Y%m%d") -> list[tuple[date, date]]:
    """Intervals that start up to ``end``; the last may reach beyond it. Steps and offsets (gaps behind an interval) are used in turn.

    ignore_29feb makes leap years look like others. Months: an interval that would end
    on 29 February ends on the 28th. Days: one that begins by February and reaches
    beyond it in a leap year is a day longer; the first start after February of a leap
    year, also the very first, moves on by a day; and one that begins in a common year
    and ends in a leap year is a day longer.

    unit ``static`` gives one interval, from start to end. Steps below 1, negative
    offsets and calendars of over LIMIT intervals raise a ValueError.
    """
    first, last = _day(start, fmt), _day(end, fmt)
    if unit == "static":
        return [(first, last)]
    steps, gaps = steps_of(step), steps_of(offset or 0)
    if min(steps) < 1 or min(gaps) < 0:
        raise ValueError("steps are 1 or more and offsets 0 or more")
    by_day = ignore_29feb and unit == "days"
    out: list[tuple[date, date]] = []
    at, due = first, True
    while at <= last:
        if len(out) >= LIMIT:
            raise ValueError(f"more than {LIMIT} intervals")
        leap = is_leap(at.year)
        if by_day and leap and due and at.month > 2:
            at, due = at + DAY, False
        elif not leap:
            due = True
        after = shift(at, unit, steps[len(out) % len(steps)])
        stop = after - DAY
        if by_day and ((leap and at.month <= 2 < after.month) or (not leap and is_leap(stop.year))):
            stop += DAY
        elif ignore_29feb and unit == "months" and (stop.month, stop.day) == (2, 29):
            stop -= DAY
        gap = gaps[len(out) % len(gaps)]
        out.append((at, stop))
        at = shift(after, unit, gap) if gap else after
    return out


def date_strings(spans: list[tuple[date, date]], fmt: str, ignore_29feb: bool = True) -> list[tuple[str, str]]:
    """Intervals as text (see format_day)."""
    return [(format_day(a, fmt, ignore_29feb), format_day(b, fmt, ignore_29feb)) for a, b in spans]


def format_day(day: date, fmt: str, ignore_29feb: bool = True) -> str:
    """Text of a day; with %j and ignore_29feb, days after February of a leap year count as in a common year."""
    if ignore_29feb and "%j" in fmt and is_leap(day.year) and day.month > 2:
        day -= DAY
    return day.strftime(fmt)


def windows(first: date, last: date, kind: str, pad_days: int = 0) -> Iterator[tuple[int, str, date, date, date, date]]:
    """Rows (win_id, tm, sel_start, sel_end, out_start, out_end) of a kind of window.

    Kinds: monthly, bimonthly, quarterly, yearly; monthly_longterm and
    bimonthly_longterm pool the same months of all years under one win_id.
    """
    months = {"monthly": 1, "bimonthly": 2, "quarterly": 3}
    if kind in months:
        spans = date_range(date(first.year, 1, 1), last, "months", months[kind])
        for i, (a, b) in enumerate(spans):
            yield i, "", a - timedelta(days=pad_days), b + timedelta(days=pad_days), a, b
    elif kind == "yearly":
        for y in range(first.year, last.year + 1):
            yield y, "yearly", date(y, 1, 1), date(y, 12, 31), date(y, 1, 1), date(y, 12, 31)
    elif kind in ("monthly_longterm", "bimonthly_longterm"):
        n = 1 if kind.startswith("m") else 2
        for y in range(first.year, last.year + 1):
            for i, (a, b) in enumerate(date_range(date(y, 1, 1), date(y, 12, 31), "months", n, ignore_29feb=False)):
                yield i + 1, f"{'m' if n == 1 else 'b'}{i + 1:02d}", a, b, first, last
    else:
        raise ValueError(f"unknown kind {kind}")


def windows_df(spark: SparkSession, first: date, last: date, kind: str, pad_days: int = 0) -> DataFrame:
    return spark.createDataFrame(list(windows(first, last, kind, pad_days)), "win_id int, tm string, sel_start date, sel_end date, out_start date, out_end date")


def intervals_df(spark: SparkSession, spans: list[tuple[date, date]]) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "i int, start_date date, end_date date")
