"""Numeric column functions: guarded ratios, clipping, rounding, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is null."""
    return a / F.nullif(b, F.lit(0.0))


def growth_pct(now: Column, before: Column) -> Column:
    """Change against the magnitude of the earlier value, in percent."""
    return ratio(now - before, F.abs(before)) * 100.0


def pct_of(part: Column, whole: Column) -> Column:
    return ratio(part, F.abs(whole)) * 100.0


def within(x: Column, low: float, high: float) -> Column:
    """x where it lies between the bounds, else null."""
    return F.when(x.between(low, high), x)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Nulls stay null: greatest and least alone would skip them."""
    out = x if low is None else F.greatest(x, num(low))
    out = out if high is None else F.least(out, num(high))
    return F.when(x.isNotNull(), out)


def round_half(x: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d, which engines agree on, unlike round()."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / F.lit(scale)


def round_away(x: Column, digits: int) -> Column:
    """Rounded with halves away from zero."""
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / F.lit(scale)


def cents(x: Column) -> Column:
    """Whole hundredths as a double: sums of these are exact in any order."""
    return F.floor(x * 100.0 + 0.5).cast("double")


def sigmoid(x: Column, scale: float = 10.0) -> Column:
    """Below -700 scales the exponential would leave the range of doubles; the result is 0 to 300 digits there."""
    return F.lit(1.0) / (1.0 + F.exp(F.least(-x / scale, F.lit(700.0))))


def power_of_ten_ratio(a: Column, b: Column, tolerance: float = 0.1) -> Column:
    """The power of ten between two magnitudes, 1 where they differ otherwise or in sign; null where either is zero."""
    size = F.log10(F.nullif(F.abs(a), F.lit(0.0)) / F.nullif(F.abs(b), F.lit(0.0)))
    whole = F.floor(size + 0.5)
    same_sign = F.signum(a) == F.signum(b)
    return F.when(size.isNotNull(), F.when(same_sign & (F.abs(size - whole) <= tolerance), F.pow(F.lit(10.0), whole)))


def comparable(a: Column, b: Column, factor: float = 100.0) -> Column:
    """Whether two magnitudes are within a factor of each other."""
    return (F.abs(a) <= F.abs(b) * factor) & (F.abs(b) <= F.abs(a) * factor)


def operating_amount(profit: Column, revenue: Column, eps: Column, net_profit: Column) -> Column:
    """An operating profit as an amount, where some reports give it a share.

    It is a share's where it is below a thousandth of the revenue; without revenue, where it is below a twentieth of the
    net profit and between a twentieth and a hundred times the EPS. Shares are what net profit and EPS, both positive,
    imply; without them the value stays.
    """
    size, earns = F.abs(profit), F.coalesce((eps > 0) & (net_profit > 0), F.lit(False))
    whole = profit * net_profit / eps
    by_revenue = F.when((size < 0.001 * F.abs(revenue)) & earns, whole).otherwise(profit)
    by_eps = F.when(earns & (size < 0.05 * net_profit) & (size < 100.0 * eps) & (size >= 0.05 * eps), whole).otherwise(profit)
    return F.when(F.coalesce(F.abs(revenue) > 0, F.lit(False)), by_revenue).otherwise(by_eps)


def ramp(x: Column, low: float, high: float, top: float) -> Column:
    """0 up to low, top from high on, linear between; null counts as 0."""
    return F.coalesce(clip((x - low) / (high - low) * top, 0.0, top), F.lit(0.0))


def _plain(text: Column) -> Column:
    """Digits of one kind, no separators, one kind of minus."""
    plain = F.translate(F.trim(text), "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩٫−–—", "01234567890123456789.---")
    return F.regexp_replace(plain, "[,٬،\\s\u00a0]", "")


def to_number(text: Column) -> Column:
    """A number from report text: Persian and Arabic digits, separators, parentheses as minus; null for junk and dashes."""
    plain = _plain(text)
    minus = plain.rlike("^\\(.*\\)$")
    bare = F.regexp_replace(plain, "[()]", "")
    value = F.when(bare.rlike("^[-+]?[0-9]+(\\.[0-9]+)?$"), bare.cast("double"))
    return F.when(minus, -value).otherwise(value)


def to_amount(text: Column, junk: float | None = 0.0) -> Column:
    """A number from a statement's cell: letters and signs about it are left out, parentheses about all of it are a minus;
    dashes, blanks, null and what is no number are junk."""
    plain = _plain(text)
    minus = plain.rlike("^\\([+-]?[0-9]+(\\.[0-9]+)?\\)$")
    bare = F.regexp_replace(plain, "[^0-9.+-]", "")
    bare = F.when(minus, F.concat(F.lit("-"), F.regexp_replace(bare, "[+-]", ""))).otherwise(bare)
    value = F.when(bare.rlike("^[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$"), bare.cast("double"))
    return F.coalesce(value, F.lit(junk).cast("double"))


def to_whole(text: Column) -> Column:
    """The first number in a text, cut to a whole one, as a bigint; a leading minus or parentheses make it negative; else null."""
    plain = _plain(text)
    first = F.regexp_extract(F.regexp_replace(plain, "[()]", ""), "-?[0-9]+(?:\\.[0-9]+)?", 0)
    value = F.nullif(first, F.lit("")).try_cast("decimal(38,6)").try_cast("bigint")
    return F.when((plain.startswith("-") | plain.rlike("^\\(.*\\)$")) & (value > 0), -value).otherwise(value)


def to_decimal(text: Column) -> Column:
    """A decimal of four digits; parentheses make it negative, blanks, dashes and junk are null."""
    plain = _plain(text)
    bare = F.regexp_replace(plain, "[()]", "")
    value = F.when(bare.rlike("^[-+]?[0-9]+(\\.[0-9]+)?$"), bare).try_cast("decimal(30,4)")
    return F.when(plain.rlike("^\\(.*\\)$"), -value).otherwise(value)
