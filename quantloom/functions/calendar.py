"""Solar Hijri dates as integer arithmetic on columns: keys, conversion both ways, month ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(text: Column) -> tuple[Column, Column, Column]:
    """Year, month and day of a `yyyy/mm/dd` text, padded or not; nulls if it isn't one."""
    pattern = "^\\s*(\\d{4})[/-](\\d{1,2})[/-](\\d{1,2})\\s*$"
    return tuple(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("int") for k in (1, 2, 3))


def date_key(text: Column) -> Column:
    """yyyymmdd as a number, null for other texts."""
    y, m, d = parts(text)
    return y * 10000 + m * 100 + d


def key_text(y: Column, m: Column, d: Column) -> Column:
    return F.format_string("%04d/%02d/%02d", y, m, d)


def _whole(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("int")


def jalali_days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01, by the 33-year leap rule."""
    y = y + 1595
    before = F.when(m < 7, (m - 1) * 31).otherwise((m - 7) * 30 + 186)
    return (F.lit(-355668) + 365 * y + _whole(y, 33) * 8 + _whole(y % 33 + 3, 4) + d + before - 719528).cast("int")


def jalali_to_date(y: Column, m: Column, d: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), jalali_days(y, m, d))


def date_to_jalali(date: Column) -> tuple[Column, Column, Column]:
    days = F.datediff(date, F.lit("1970-01-01").cast("date")) + 719528 + 355668 - 1
    y = -1595 + 33 * _whole(days, 12053)
    days = days % 12053
    y = y + 4 * _whole(days, 1461)
    days = days % 1461
    late = days > 365
    y = F.when(late, y + _whole(days - 1, 365)).otherwise(y)
    days = F.when(late, (days - 1) % 365).otherwise(days)
    m = F.when(days < 186, 1 + _whole(days, 31)).otherwise(7 + _whole(days - 186, 30))
    d = F.when(days < 186, 1 + days % 31).otherwise(1 + (days - 186) % 30)
    return y.cast("int"), m.cast("int"), d.cast("int")


def jalali_month_end(y: Column, m: Column) -> Column:
    """The Gregorian date of a Jalali month's last day."""
    after_y, after_m = F.when(m == 12, y + 1).otherwise(y), F.when(m == 12, 1).otherwise(m + 1)
    return F.date_sub(jalali_to_date(after_y, after_m, F.lit(1)), 1)


def jalali_months_between(y1: Column, m1: Column, y2: Column, m2: Column) -> Column:
    return (y2 - y1) * 12 + (m2 - m1)


def jalali_month_days(y: Column, m: Column) -> Column:
    """31 in the first half year, 30 after, and 29 in the last month of a year that isn't leap."""
    leap = jalali_days(y + 1, F.lit(1), F.lit(1)) - jalali_days(y, F.lit(1), F.lit(1)) == 366
    return F.when(m <= 6, 31).when((m < 12) | leap, 30).otherwise(29)


def valid_jalali_to_date(y: Column, m: Column, d: Column) -> Column:
    """As jalali_to_date; null where there is no such day."""
    return F.when(m.between(1, 12) & (d >= 1) & (d <= jalali_month_days(y, m)), jalali_to_date(y, m, d))


def add_jalali_months(y: Column, m: Column, n: Column | int) -> tuple[Column, Column]:
    """Year and month n months on, or back for a negative n."""
    whole = y * 12 + m - 1 + n
    return _whole(whole, 12), (F.pmod(whole, F.lit(12)) + 1).cast("int")


def jalali_months_ago(y: Column, m: Column, d: Column, n: Column | int) -> Column:
    """The date text n months back, on the same day or the month's last; the last month of a year counts 29 days."""
    back_y, back_m = add_jalali_months(y, m, -n)
    most = F.when(back_m <= 6, 31).when(back_m < 12, 30).otherwise(29)
    return key_text(back_y, back_m, F.least(d, most))


def epoch_date(text: Column, last_year: int) -> Column:
    """The day, in UTC, of seconds over 1e9 or milliseconds over 1e12, from 2010 to last_year; else null."""
    digits = F.nullif(F.regexp_replace(F.translate(text, "۰۱۲۳۴۵۶۷۸۹", "0123456789"), "[^0-9]", ""), F.lit(""))
    number = digits.try_cast("double")
    seconds = F.when(number > 1e12, number / 1000.0).when(number > 1e9, number)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.when(seconds < 1e11, seconds) / 86400.0).cast("int"))
    return F.when(F.year(day).between(2010, last_year), day)


def eight_digits(text: Column) -> Column:
    """The first eight digits of a text as a number, null for fewer."""
    digits = F.regexp_replace(F.translate(text, "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789"), "[^0-9]", "")
    return F.when(F.length(digits) >= 8, F.substring(digits, 1, 8)).cast("int")


def fresh_or(day: Column, otherwise: Column, today: Column, most: int = 10) -> Column:
    """A day within most days of today, else another."""
    return F.coalesce(F.when(F.abs(F.datediff(day, today)) <= most, day), otherwise)


def either_calendar(key: Column) -> Column:
    """A date from an eight-digit key: years over 1500 are Gregorian, 1300 to 1500 Jalali; others, and days that don't exist,
    are null."""
    y, m, d = _whole(key, 10000), _whole(key % 10000, 100), (key % 100).cast("int")
    return F.when(y > 1500, F.try_to_date(F.format_string("%08d", key), "yyyyMMdd")).when(y.between(1300, 1500), valid_jalali_to_date(y, m, d))
