"""Date functions on columns, as spreadsheets count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1899-12-30"


def _days(b: Column, a: Column) -> Column:
    return F.date_diff(b, a)


def _leap(y: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(y, F.lit(2), F.lit(1)))) == 29


def from_serial(n: Column) -> Column:
    """The date of a spreadsheet serial number."""
    return F.date_add(F.lit(EPOCH).cast("date"), F.floor(n).cast("int"))


def edate(d: Column, months: Column | int) -> Column:
    return F.add_months(d, months)


def eomonth(d: Column, months: Column | int) -> Column:
    return F.last_day(F.add_months(d, months))


def shift_keep_month_end(d: Column, months: Column | int) -> Column:
    """Months on; the last day of a month stays the last day."""
    return F.when(d == F.last_day(d), F.last_day(F.add_months(d, months))).otherwise(F.add_months(d, months))


def datedif(a: Column, b: Column, unit: str) -> Column:
    """Whole days, months, years, or months beyond years, from a to b; null if b comes first."""
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - F.when(F.dayofmonth(b) < F.dayofmonth(a), 1).otherwise(0)
    value = {"D": _days(b, a), "M": months, "Y": F.floor(months / 12), "YM": months % 12}[unit.upper()]
    return F.when(b >= a, value.cast("int"))


def weekday(d: Column, kind: int = 1) -> Column:
    """1: Sunday is 1; 2: Monday is 1; 3: Monday is 0."""
    iso = F.weekday(d)  # Monday 0
    return {1: (iso + 1) % 7 + 1, 2: iso + 1, 3: iso}[kind]


def fy_year(d: Column, end_month: Column | int) -> Column:
    """The financial year that a date falls in."""
    return F.year(d) + F.when(F.month(d) <= end_month, 0).otherwise(1)


def _actual(a: Column, b: Column) -> Column:
    """Actual/actual for a <= b: the year's own length within a year, else the mean of the years touched."""
    y1, y2 = F.year(a), F.year(b)
    feb29 = (F.month(a) == 2) & (F.dayofmonth(a) == 29)
    year_on = F.when(feb29, F.make_date(y1 + 1, F.lit(3), F.lit(1))).otherwise(F.add_months(a, 12))
    end_feb = lambda y: F.last_day(F.make_date(y, F.lit(2), F.lit(1)))
    holds = lambda y: _leap(y) & end_feb(y).between(a, b)
    mean = _days(F.make_date(y2 + 1, F.lit(1), F.lit(1)), F.make_date(y1, F.lit(1), F.lit(1))) / (y2 - y1 + 1)
    year = F.when(y1 == y2, F.when(_leap(y1), 366).otherwise(365)).otherwise(F.when(holds(y1) | holds(y2), 366).otherwise(365))
    return _days(b, a) / F.when(b <= year_on, year.cast("double")).otherwise(mean)


def _thirty(a: Column, b: Column, european: bool) -> Column:
    d1, d2 = F.dayofmonth(a), F.dayofmonth(b)
    if european:
        d1, d2 = F.least(d1, F.lit(30)), F.least(d2, F.lit(30))
    else:
        feb_a, feb_b = (F.month(a) == 2) & (a == F.last_day(a)), (F.month(b) == 2) & (b == F.last_day(b))
        first = F.when(feb_a, 30).otherwise(d1)
        second = F.when(feb_a & feb_b, 30).otherwise(d2)
        d2 = F.when((second == 31) & (first >= 30), 30).otherwise(second)
        d1 = F.when(first == 31, 30).otherwise(first)
    return ((F.year(b) - F.year(a)) * 360 + (F.month(b) - F.month(a)) * 30 + d2 - d1) / 360.0


def yearfrac(a: Column, b: Column, basis: int | str = 1) -> Column:
    """Year fraction between two dates in either order. Bases 0 to 4, or 'actual/actual', 'actual/365'."""
    basis = {"actual/actual": 1, "actual/365": 3, "actual/360": 2}.get(basis, basis)
    lo, hi = F.least(a, b), F.greatest(a, b)
    return {0: lambda: _thirty(lo, hi, False), 1: lambda: _actual(lo, hi), 2: lambda: _days(hi, lo) / 360.0, 3: lambda: _days(hi, lo) / 365.0, 4: lambda: _thirty(lo, hi, True)}[basis]()
