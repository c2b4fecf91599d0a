"""Irreversible replacements that keep what an analysis needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import TOKENS
from .numbers import local_number, parse_amount
from .text import let, only_digits


def mask_email(s: Column) -> Column:
    at = F.instr(s, "@")
    return F.when(at > 1, F.concat(F.lit("***"), F.substring(s, at, F.length(s)))).otherwise(TOKENS["EMAIL"])


def mask_card(s: Column) -> Column:
    return let(only_digits(s), lambda d: F.when(F.length(d) >= 4, F.concat(F.lit("**** "), F.right(d, F.lit(4)))).otherwise(TOKENS["TARJETA"]))


def salary_range(cell: Column) -> Column:
    """853200 -> '$ 800.000 – 900.000'; one digit finer from a million."""

    def bounds(n: Column) -> Column:
        power = F.floor(F.log10(n) + 1e-12) - F.when(n >= 1_000_000, 1).otherwise(0)
        step = F.pow(F.lit(10.0), power.cast("double"))
        low = F.floor(n / step) * step
        return F.when(n > 0, F.concat(F.lit("$ "), local_number(low), F.lit(" – "), local_number(low + step))).otherwise(TOKENS["SALARIO"])

    return F.coalesce(let(parse_amount(cell), bounds), F.lit(TOKENS["SALARIO"]))


def age_range(s: Column) -> Column:
    """45 -> '40-49', '45 años' -> '40-49 años'."""

    def decade(n: Column) -> Column:
        low = (F.floor(n / 10) * 10).cast("int")
        text = F.concat(low.cast("string"), F.lit("-"), (low + 9).cast("string"), F.when(s.contains("años"), " años").otherwise(""))
        return F.when((n > 0) & (n < 120), text).otherwise(TOKENS["EDAD"])

    return F.coalesce(let(only_digits(s).try_cast("int"), decade), F.lit(TOKENS["EDAD"]))


def birth_year(s: Column, serial: bool = False) -> Column:
    """The first year 19xx or 20xx. ``serial``: the cell is a day count of a spreadsheet."""
    if serial:
        n = s.try_cast("double")
        return F.when((n > 0) & (n < 80_000), F.date_format(F.date_add(F.to_date(F.lit("1899-12-30")), n.cast("int")), "yyyy")).otherwise(birth_year(s.cast("string")))
    year = F.regexp_extract(s, r"\b((?:19|20)\d{2})\b", 1)
    return F.when(year != "", year).otherwise(TOKENS["FECHA_NACIMIENTO"])


def anonymize(kind: Column, value: Column) -> Column:
    """By type: masks for e-mails and cards, ranges for ages and salaries, the year of a birth, else the type's token."""
    token = F.lit(None).cast("string")
    for name, text in TOKENS.items():
        token = F.when(kind == name, F.lit(text)).otherwise(token)
    return (
        F.when(kind == "EMAIL", mask_email(value))
        .when(kind == "TARJETA", mask_card(value))
        .when(kind == "FECHA_NACIMIENTO", birth_year(value))
        .when(kind == "EDAD", age_range(value))
        .when(kind == "SALARIO", salary_range(value))
        .otherwise(token)
    )
