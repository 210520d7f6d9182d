"""Dates that people write, as column expressions. Dates are ISO strings; a value that is none is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days between receipt and date above which a date is worth a warning, and years that a yearless date may go back.
FAR_DAYS, YEARS_BACK = 31, 9


def _iso(y: Column, m: Column, d: Column) -> Column:
    text = F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int"))
    return F.date_format(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), "yyyy-MM-dd")


def iso_date(value: Column) -> Column:
    """The value if it is a day of the calendar in the form 2025-03-26."""
    s = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return F.when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (F.date_format(F.try_to_timestamp(s, F.lit("yyyy-MM-dd")), "yyyy-MM-dd") == s), s)


def parse_date(text: Column, received: Column) -> Column:
    """2025-03-26 (also . and /), 20250326, 25.03.26, 250326, and without a year 3-26 or 0326: the latest such day up to
    ``received`` (a date), going back nine years for a leap day."""
    s = F.trim(F.coalesce(text.cast("string"), F.lit("")))
    part = F.split(s, "[-./]")
    sub = lambda a, n: F.substring(s, a, n)
    century = lambda y: y.cast("int") + 2000
    day = r"^[0-9]{1,2}[-./][0-9]{1,2}$"
    m = F.when(s.rlike(day), part[0]).otherwise(sub(1, 2)).cast("int")
    d = F.when(s.rlike(day), part[1]).otherwise(sub(3, 2)).cast("int")
    years = F.transform(F.sequence(F.lit(0), F.lit(YEARS_BACK - 1)), lambda back: _iso(F.year(received) - back, m, d))
    yearless = F.filter(years, lambda x: x.isNotNull() & (x <= F.date_format(received, "yyyy-MM-dd")))
    return (
        F.when(s.rlike(r"^[0-9]{4}([-./])[0-9]{1,2}\1[0-9]{1,2}$"), _iso(part[0], part[1], part[2]))
        .when(s.rlike("^[0-9]{8}$"), _iso(sub(1, 4), sub(5, 2), sub(7, 2)))
        .when(s.rlike(r"^[0-9]{2}([-./])[0-9]{1,2}\1[0-9]{1,2}$"), _iso(century(part[0]), part[1], part[2]))
        .when(s.rlike("^[0-9]{6}$"), _iso(century(sub(1, 2)), sub(3, 2), sub(5, 2)))
        .when(s.rlike(day) | s.rlike("^[0-9]{4}$"), F.get(yearless, F.lit(0)))
    )


def date_warning(iso: Column, received: Column) -> Column:
    """'future' or 'far' for a date after receipt or long before it."""
    days = F.datediff(received, F.to_date(iso))
    return F.when(days < 0, "future").when(days > FAR_DAYS, "far")


def date_from_name(name: Column, pattern: str, year: int = 1, month: int = 2, day: int = 3) -> Column:
    """The date in a file's name by the groups of a pattern; two-digit years are of this century. Not checked."""
    y, m, d = (F.regexp_extract(name, pattern, i) for i in (year, month, day))
    y = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    return F.when(F.regexp_extract(name, pattern, 0) != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def days_between(earlier: Column, later: Column) -> Column:
    """Days that lie between two ISO dates: 0 for the same and the next day; null if one isn't a date."""
    n = F.datediff(F.to_date(iso_date(later)), F.to_date(iso_date(earlier)))
    return F.when(n > 1, n - 1).when(n.isNotNull(), 0)


def month_of(day: Column) -> Column:
    """The month of a date that looks like one (2025-03-...), else null."""
    return F.when(day.rlike("^[0-9]{4}-[0-9]{2}-"), F.substring(day, 1, 7))


def in_month(day: Column, month: str) -> Column:
    """By code points, whatever follows the month."""
    return (day >= f"{month}-") & (day < f"{month}.")


def local_day(utc: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(utc, zone))


def stamp_ms(ts: Column) -> Column:
    return F.unix_millis(ts)
