"""Numbers, dates and periods as they are written in Argentina (and in English), as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# How a number with a currency looks, and the short month names of labels.
NUMBER_TEXT = r"(?i)^[-+]?(?:\$|ars|usd|u\$s)?\s*[-+]?[\d.,]+\s*%?$"
MONTHS = ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sept", "oct", "nov", "dic")

DAY, MONTH, YEAR = "dia", "mes", "anio"


def parse_number(cell: Column) -> Column:
    """'$ 1.250.000', '1.250,50', '1,250.50', '15%' -> double; null if it is no number.

    With both separators the last is the decimal one; one comma is decimal, many are thousands; dots are thousands if
    there are many, or exactly three digits follow.
    """
    text = F.regexp_replace(F.trim(cell.cast("string")), r"\s+", " ")

    def read(d: Column) -> Column:
        dot, comma = F.length(d) - F.locate(".", F.reverse(d)), F.length(d) - F.locate(",", F.reverse(d))
        has_dot, has_comma = d.contains("."), d.contains(",")
        both = F.when(comma > dot, F.replace(F.replace(d, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(d, F.lit(","), F.lit("")))
        commas = F.when(d.rlike(",.*,"), F.replace(d, F.lit(","), F.lit(""))).otherwise(F.replace(d, F.lit(","), F.lit(".")))
        dots = F.when(d.rlike(r"\..*\.") | d.rlike(r"\.[^.]{3}$"), F.replace(d, F.lit("."), F.lit(""))).otherwise(d)
        plain = F.when(has_dot & has_comma, both).when(has_comma, commas).when(has_dot, dots).otherwise(d)
        return F.when(plain.rlike(r"^-?(?:\d+\.?\d*|\.\d+)$"), plain.try_cast("double"))

    return F.when(text.rlike(NUMBER_TEXT), let(F.regexp_replace(text, r"[^\d.,\-]", ""), read))


def parse_amount(cell: Column) -> Column:
    """The simpler reading of amounts: a comma is decimal, dots before three digits are thousands."""

    def read(s: Column) -> Column:
        plain = F.when(s.contains(","), F.regexp_replace(F.replace(s, F.lit("."), F.lit("")), "^([^,]*),", "$1.")).otherwise(F.regexp_replace(s, r"\.(?=\d{3}(\D|$))", ""))
        return F.when(plain.rlike(r"^(?:\d+\.?\d*|\.\d+)$"), plain.try_cast("double"))

    return let(F.regexp_replace(cell.cast("string"), r"[^\d.,]", ""), read)


def parse_date(cell: Column) -> Column:
    """'2025-03-15', '15/03/2025', '15/3/25' -> date; null if impossible or outside 1900 to 2100."""
    s = F.trim(cell.cast("string"))
    iso, local = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ].*)?$", r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})$"
    part = lambda rx, k: F.regexp_extract(s, rx, k).try_cast("int")

    def made(y: Column, m: Column, d: Column) -> Column:
        text = F.format_string("%04d-%02d-%02d", y, m, d)
        date = F.try_to_date(text, "yyyy-MM-dd")
        return F.when(y.between(1900, 2100), date)

    year = part(local, 3)
    return F.when(s.rlike(iso), made(part(iso, 1), part(iso, 2), part(iso, 3))).when(s.rlike(local), made(F.when(year < 100, year + 2000).otherwise(year), part(local, 2), part(local, 1)))


def local_number(n: Column) -> Column:
    """1250000 -> '1.250.000'."""
    return F.translate(F.format_number(n, 0), ",.", ".,")


def format_value(n: Column, money: bool = False) -> Column:
    """Two decimals below 10, one below 1000, none above."""
    size = F.abs(n)
    text = F.when(size < 10, _fraction(n, 2)).when(size < 1000, _fraction(n, 1)).otherwise(local_number(n))
    return F.concat(F.lit("$ "), text) if money else text


def _fraction(n: Column, decimals: int) -> Column:
    text = F.translate(F.format_number(n, decimals), ",.", ".,")
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), ",$", "")


def period_key(date: Column, granularity: Column) -> Column:
    return F.when(granularity == YEAR, F.date_format(date, "yyyy")).when(granularity == MONTH, F.date_format(date, "yyyy-MM")).otherwise(F.date_format(date, "yyyy-MM-dd"))


def period_label(date: Column, granularity: Column) -> Column:
    """'15 mar', 'mar 25', '2025'."""
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(date))
    return (
        F.when(granularity == YEAR, F.date_format(date, "yyyy"))
        .when(granularity == MONTH, F.concat(month, F.lit(" "), F.date_format(date, "yy")))
        .otherwise(F.concat(F.dayofmonth(date).cast("string"), F.lit(" "), month))
    )


def granularity(first: Column, last: Column) -> Column:
    """Days up to two months, months up to three years, else years."""
    days = F.datediff(last, first)
    return F.when(days.isNull(), MONTH).when(days <= 62, DAY).when(days <= 1098, MONTH).otherwise(YEAR)


def change_percent(a: Column, b: Column) -> Column:
    """Of b against a; null if a is 0."""
    return F.when(a != 0, (b - a) / F.abs(a) * 100)


def round_half_up(x: Column) -> Column:
    """Towards plus infinity, also below zero."""
    return F.floor(x + 0.5)
