"""Text column functions: Persian normal forms, tokens, similarity, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letter variants and the letters they stand for, digits, and marks without width.
LETTERS = ("يىكۀةأإؤ", "ییکههااو")
DIGITS = ("۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789")
MARKS = "[‌‍‎‏‪-‮⁦-⁩]"
#: Words that company names share, fixed values; and those that are left out where names are matched.
COMMON_WORDS = ("شرکت", "سهامی", "عام", "خاص", "گروه")
COMPANY_WORDS = ("شرکت", "سهامی", "عام", "خاص")
#: Currency units in words, fixed values: millions, thousands, rials.
MILLION, THOUSAND, RIAL = "میلیون", "هزار", "ریال"


def normalize_letters(x: Column) -> Column:
    return F.translate(x, "يك", "یک")


def normalize_text(x: Column) -> Column:
    """Letters and digits in one form, no marks, single spaces, none at the ends."""
    plain = F.regexp_replace(F.translate(x, LETTERS[0] + DIGITS[0], LETTERS[1] + DIGITS[1]), MARKS, "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, " ", " "), "\\s+", " "))


def normalize_name(x: Column) -> Column:
    """Two letters in one form, no joiners and direction marks, no spaces at the ends; null is empty."""
    return F.coalesce(F.trim(F.regexp_replace(F.translate(x, "يك\u00a0", "یک "), "[\u200c\u200e\u200f]", "")), F.lit(""))


def words_of(x: Column) -> Column:
    return F.filter(F.split(F.trim(x), "\\s+"), lambda w: w != "")


def normalize_company_name(x: Column) -> Column:
    """A company's name in normal form; raises where nothing is left."""
    name = normalize_text(x)
    return F.when(F.coalesce(F.length(name), F.lit(0)) == 0, F.raise_error(F.lit("company name is empty"))).otherwise(name)


def normalize_header(x: Column) -> Column:
    """A table's header on one line: letters and digits in one form, single spaces."""
    return normalize_text(x)


def currency_unit(x: Column) -> Column:
    """million_rial, thousand_rial, rial or unknown, by the words of a text."""
    plain = F.coalesce(normalize_label(x), F.lit(""))
    say = lambda *words: plain.contains(" ".join(words))
    return F.when(say(MILLION, RIAL), "million_rial").when(say(THOUSAND, RIAL), "thousand_rial").when(say(RIAL), "rial").otherwise("unknown")


def normalize_label(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(normalize_text(x)), "[^\\p{L}\\p{N}]+", " "))


def tokens(x: Column, common: tuple[str, ...] = COMMON_WORDS) -> Column:
    """The distinct words of a label without common ones."""
    words = F.filter(F.split(normalize_label(x), " "), lambda w: w != "")
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, common)).cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all tokens; 0 where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def company_key(name: Column) -> Column:
    return F.md5(normalize_text(name))


def is_md5(x: Column) -> Column:
    return F.coalesce(x.rlike("^[0-9a-fA-F]{32}$"), F.lit(False))


def is_identifier(x: Column) -> Column:
    """Whether a text may stand for a table's name in SQL."""
    return F.coalesce(x.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False))


def with_page(url: Column, page: Column) -> Column:
    """A listing's address with another page number, added where it has none."""
    text = page.cast("string")
    changed = F.regexp_replace(url, F.lit("([?&]PageNumber=)[0-9]*"), F.concat(F.lit("$1"), text))
    added = F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit("PageNumber="), text)
    return F.when(url.rlike("[?&]PageNumber="), changed).otherwise(added)


def url_join(base: Column, link: Column) -> Column:
    """The address that a link on a page leads to: whole links stay, the rest is taken from the base."""
    scheme, root = F.regexp_extract(base, "^([a-z]+:)", 1), F.regexp_extract(base, "^([a-z]+://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, "[?#].*$", ""), "^([a-z]+://[^/]*(?:/.*)?)/", 1)
    folder = F.when(F.length(folder) >= F.length(root), folder).otherwise(root)
    return (F.when(link.rlike("^[a-z][a-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(root, link))
            .when(link.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), link)).otherwise(F.concat(folder, F.lit("/"), link)))


def percent_text(x: Column, digits: int = 1) -> Column:
    """A percentage with its sign; a dash for null."""
    return F.when(x.isNotNull(), F.format_string(f"%+.{digits}f%%", x)).otherwise("–")


def url_parameter(url: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(url, f"[?&]{name}=([^&#]*)", 1), F.lit(""))


def csv_text(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, '"', "'"), "[\\r\\n]+", " ")


def csv_quoted(x: Column) -> Column:
    """A text in quotes, those inside made single ones, line feeds blanks, and carriage returns left out; null is an empty text."""
    return F.concat(F.lit('"'), F.coalesce(F.translate(x, '"\n\r', "' "), F.lit("")), F.lit('"'))


def csv_number(x: Column, digits: int) -> Column:
    """A number with fixed digits, halves to even; nothing for zero and null."""
    shown = F.call_function("format_number", x.cast("double"), F.lit("0" + ("." + "0" * digits if digits else "")))
    return F.when(F.coalesce(x, F.lit(0.0)) == 0, "").otherwise(shown)


def csv_flag(x: Column) -> Column:
    """Yes in the users' language, nothing for no and null."""
    return F.when(F.coalesce(x, F.lit(False)), "بله").otherwise("")


def compact_number(x: Column) -> Column:
    """Thousands, millions, billions, trillions with one digit."""
    size = F.abs(x)
    out = F.format_string("%.0f", x)
    for power, mark in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        out = F.when(size >= power, F.format_string(f"%.1f{mark}", x / power)).otherwise(out)
    return out
