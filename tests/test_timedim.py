from datetime import date

import pytest

from gridloom.operators.timedim import date_range, date_strings, is_leap, shift

STEPS = [16] * 22 + [13]


def stripped(spans):
    return [(a.month, a.day, b.month, b.day) for a, b in spans]


FOUR = (("2013-01-01", "2016-01-01"), ("2016-01-01", "2019-01-01"))
BY_DAY = (("2013001", "2016001"), ("2016001", "2019001"))


@pytest.mark.parametrize(("ranges", "unit", "step", "fmt"), [(FOUR, "months", 1, "%Y-%m-%d"), (BY_DAY, "months", 1, "%Y%j"), (BY_DAY, "days", STEPS, "%Y%j"), (BY_DAY, "days", ",".join(map(str, STEPS)), "%Y%j")])
def test_leap_years_look_like_others(ranges, unit, step, fmt):
    one, two = (date_range(a, b, unit, step, fmt=fmt) for a, b in ranges)
    assert stripped(one) == stripped(two)
    three = date_range(*ranges[1], unit, step, fmt=fmt, ignore_29feb=False)
    assert stripped(one) != stripped(three)


def test_day_numbers_look_alike():
    one, two = ([(a[4:], b[4:]) for a, b in date_strings(date_range(*r, "days", STEPS, fmt="%Y%j"), "%Y%j")] for r in BY_DAY)
    assert one == two
    three = [(a[4:], b[4:]) for a, b in date_strings(date_range(*BY_DAY[1], "days", STEPS, fmt="%Y%j", ignore_29feb=False), "%Y%j", False)]
    assert one != three


def test_year_ends():
    got = date_range("2013001", "2016001", "days", STEPS, fmt="%Y%j")
    assert len(got) == 70 and got[68:] == [(date(2015, 12, 19), date(2015, 12, 31)), (date(2016, 1, 1), date(2016, 1, 16))]
    into_leap = date_range("20151201", "20160101", "days", 20)
    assert into_leap == [(date(2015, 12, 1), date(2015, 12, 20)), (date(2015, 12, 21), date(2016, 1, 10))]
    assert date_range("20160301", "20160310", "days", 5)[0] == (date(2016, 3, 2), date(2016, 3, 6))


def test_limits():
    with pytest.raises(ValueError, match="intervals"):
        date_range("10000101", "20991231", "days", 1)
    for bad in ({"step": 0}, {"step": [5, -1]}, {"step": 1, "offset": -1}):
        with pytest.raises(ValueError, match="steps"):
            date_range("20150101", "20160101", "days", **bad)
    assert date_range("20150301", "20160229", "static", 1) == [(date(2015, 3, 1), date(2016, 2, 29))]
    assert not is_leap(1900) and is_leap(2000)


def test_offsets_in_turn():
    got = date_range("20150101", "20150201", "days", 2, offset="1,4")
    assert [(a.day, b.day) for a, b in got[:4]] == [(1, 2), (4, 5), (10, 11), (13, 14)]


def test_golden_calendar():
    got = date_range("20141202", "20201201", "days", [109, 96, 80, 80])
    assert len(got) == 24
    for y, four in zip(range(2015, 2021), (got[i : i + 4] for i in range(0, 24, 4)), strict=True):
        assert four == [(date(y - 1, 12, 2), date(y, 3, 20)), (date(y, 3, 21), date(y, 6, 24)), (date(y, 6, 25), date(y, 9, 12)), (date(y, 9, 13), date(y, 12, 1))]


def test_sixteen_days_and_offset():
    got = date_range("2016001", "2019001", "days", STEPS, fmt="%Y%j")
    assert len(got) == 70
    assert got[3:5] == [(date(2016, 2, 18), date(2016, 3, 5)), (date(2016, 3, 6), date(2016, 3, 21))]
    assert [a for a, _ in date_range("20150301", "20170301", "months", 1, offset=11)] == [date(2015, 3, 1), date(2016, 3, 1), date(2017, 3, 1)]


def test_shift_keeps_month_ends():
    assert shift(date(2015, 1, 31), "months", 1) == date(2015, 2, 28)
    assert shift(date(2016, 2, 29), "years", 1) == date(2017, 2, 28)
