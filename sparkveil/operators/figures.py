"""Figures and capitalised runs of a text: found by a plain shape, then decided piece by piece with column functions.

A rule of the scanner takes a loose shape (digit groups, a number with a word beside it, a street word and what follows) and
gives the part of it that counts, or null. What makes a telephone number, an amount or an address is said here by tests of
digits, lists of words and sizes of groups, not by one expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, only_digits
from ..functions.validators import is_phone
from .spans import look_back, matches

# Words that results are compared by.
CURRENCIES = ("$", "u$s", "usd", "ars")
CURRENCY_WORDS = ("$", "pesos", "ars", "usd", "dolares")
NOT_A_DNI_UNITS = ("%", "$", "pesos", "ars", "usd", "u$s", "dolares", "euros", "mil", "millones", "unidades", "habitantes", "personas", "usuarios", "visitas", "kg", "km", "m2", "litros")
NOT_A_SALARY_UNITS = ("%", "años", "meses", "dias", "horas", "empleados", "personas")
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "setiembre", "octubre", "noviembre", "diciembre")
STREETS = ("av", "avda", "avenida", "calle", "bv", "boulevard", "bulevar", "pje", "pasaje", "diag", "diagonal", "ruta")
LINKS = ("de", "del", "la", "los", "las")
COMPANY_LINKS = ("de", "del", "la", "las", "los", "y", "e")
COMPANY_OPENERS = tuple(
    "entre el la los las con por para segun y e en al a de del sr sra señor señora empresa cliente proveedor firma firmamos contrato servicios que su sus".split()
)
SOCIETIES = ("SAU", "SAS", "SRL", "SA")
MOST_NAME_WORDS = 5

#: Digit groups with at most two separators between them.
GROUPS = r"(?<![\w+])[+(]{0,2}\d(?:[ \t.()-]{0,2}\d)*+\)?(?!\w)"
#: A number with the sign or word before and behind it.
BESIDE = r"(?iu)(?:(?<![\p{L}\d.,])[\p{L}$]{1,3}[^\S\n]?)?(?<![\d.,-])\d[\d.]*(?:,\d+)?(?![\d,]*-\d)(?:\s?(?:[%$]|\p{L}[\p{L}\d$]*))?"
#: Days by figures, and by the name of the month.
DAYS = r"(?iu)(?<!\d)(?:\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}|\d{1,2}\s+de\s+\p{L}+(?:\s+del?)?\s+\d{4})(?!\d)"
#: A street word and the rest of its line as far as a number may stand.
_STREET_WORD = rf"(?:{'|'.join(w.capitalize() for w in STREETS)})(?!\p{{L}})"
STREET = rf"(?=[{''.join(sorted({w[0].upper() for w in STREETS}))}])(?<!\p{{L}}){_STREET_WORD}\.?(?:[ \t]+(?!{_STREET_WORD})[\p{{L}}\d.°º]+){{1,8}}"


def _is(word: Column, words: tuple[str, ...]) -> Column:
    return strip_accents_but_enye(F.lower(word)).isin(*words)


def strip_accents_but_enye(text: Column) -> Column:
    """'días' -> 'dias', but 'años' stays."""
    return F.translate(text, "áéíóú", "aeiou")


def telephone(run: Column) -> Column:
    """Of a run of digit groups, the longest part that is a telephone number: ten to thirteen digits (or the eight of a
    local one), at most six groups, the last of four to six digits where groups are parted, not cut within a figure."""
    pieces = F.regexp_extract_all(run, F.lit(r"[+(]{0,2}\d+\)?[ \t.-]*"), F.lit(0))

    def fits(w: Column) -> Column:
        groups = F.regexp_extract_all(w, F.lit(r"\d+"), F.lit(0))
        last = F.length(F.element_at(groups, -1))
        digits = F.length(only_digits(w))
        return (is_phone(w) | (digits == 8)) & (F.size(groups) <= 6) & ((F.size(groups) == 1) | last.between(4, 6) | (last == 8))

    def parts(p: Column) -> Column:
        n = F.size(p)

        def from_(i: Column) -> Column:
            def to(k: Column) -> Column:
                whole = F.array_join(F.slice(p, i, k), "")
                cut = (i + k <= n) & whole.rlike(r"[.-]$")
                return F.when(~cut, F.regexp_replace(F.rtrim(whole), r"[ \t.(-]+$", ""))

            return F.transform(F.sequence(F.least(n - i + 1, F.lit(6)), F.lit(1), F.lit(-1)), to)

        starts = F.sequence(F.lit(1), F.when(run.startswith("+"), 1).otherwise(n))  # a country code is no number of its own
        windows = F.filter(F.flatten(F.transform(starts, from_)), lambda w: w.isNotNull() & fits(w))
        return F.get(F.transform(F.array_sort(F.transform(windows, lambda w, k: F.struct((-F.length(only_digits(w))).alias("d"), k.alias("k"), w.alias("w")))), lambda x: x["w"]), F.lit(0))

    return F.when(F.length(only_digits(run)) >= 8, let(pieces, parts))


def _pieces(m: Column, then: Callable[[Column, Column, Column], Column]) -> Column:
    """The sign or word before a number, the number, and what stands behind it."""
    shape = r"(?u)^([\p{L}$]*)([^\S\n]?)(\d[\d.]*\d|\d)((?:,\d+)?)"
    head, number = F.regexp_extract(m, shape, 1), F.concat(F.regexp_extract(m, shape, 3), F.regexp_extract(m, shape, 4))
    behind = lambda x: F.trim(F.substring(m, F.instr(m, x["number"]) + F.length(x["number"]), F.length(m)))
    return let(F.struct(head.alias("head"), number.alias("number")), lambda x: let(behind(x), lambda b: then(x["head"], x["number"], b)))


def is_amount(number: Column, least_digits: int) -> Column:
    """Points, if any, stand between groups of three digits; plain numbers have so many digits; two decimals at most."""
    whole, cents = F.split_part(number, F.lit(","), F.lit(1)), F.split_part(number, F.lit(","), F.lit(2))
    groups = F.split(whole, r"\.")
    grouped = F.length(groups[0]).between(1, 3) & F.forall(F.slice(groups, F.lit(2), F.greatest(F.size(groups) - 1, F.lit(0))), lambda g: F.length(g) == 3)
    return F.when(F.size(groups) > 1, grouped).otherwise(F.length(whole) >= least_digits) & (F.length(cents) <= 2)


def money(m: Column) -> Column:
    """A number with its currency, before or behind it."""

    def of(head: Column, number: Column, behind: Column) -> Column:
        from_head = F.substring(m, F.lit(1), F.instr(m, number) + F.length(number) - 1)
        start = F.instr(m, number)
        with_unit = F.rtrim(F.substring(m, start, F.length(m)))
        return F.when(is_amount(number, 4), F.when(_is(head, CURRENCIES), from_head).when(_is(behind, CURRENCY_WORDS), with_unit))

    return _pieces(m, of)


def bare_amount(m: Column) -> Column:
    """A number without a currency before it and without a unit that says it is none; a year is no amount."""

    def of(head: Column, number: Column, behind: Column) -> Column:
        year = number.rlike(r"^\d{4}$") & number.try_cast("int").between(1900, 2099)
        return F.when(is_amount(number, 4) & ~head.contains("$") & ~year & ~_is(behind, NOT_A_SALARY_UNITS), number)

    return _pieces(m, of)


def bare_identity(m: Column) -> Column:
    """Seven or eight digits, with points or not, without a unit behind them."""

    def of(head: Column, number: Column, behind: Column) -> Column:
        return F.when(~number.contains(",") & ~head.contains("$") & ~_is(behind, NOT_A_DNI_UNITS), number)

    return _pieces(m, of)


def birthday(m: Column) -> Column:
    """A day of 1900 to 2099, in one of three orders."""
    parts = F.split(m, r"[/.-]|\s+(?:del?\s+)?")
    size = lambda k: F.length(F.get(parts, F.lit(k)))
    year = lambda k: F.get(parts, F.lit(k)).try_cast("int").between(1900, 2099)
    first = (size(0) == 4) & m.contains("-") & year(0) & (size(1) == 2) & (size(2) == 2)
    last = (size(0) <= 2) & (size(2) == 4) & year(2)
    named = (F.size(parts) == 3) & _is(F.get(parts, F.lit(1)), MONTHS) & year(2)
    return F.when(F.size(parts) == 3, F.when(m.rlike(r"\p{L}"), F.when(named, m)).when(first | last, m))


def address(m: Column) -> Column:
    """A street word, one to five words that a street's name may have, and a number, with its sign or not."""
    tokens, spaced = F.split(m, r"[ \t]+"), F.regexp_extract_all(m, F.lit(r"[^ \t]+[ \t]*"), F.lit(0))
    named = lambda w: w.rlike(r"^\p{Lu}[\p{L}.]*$") | w.isin(*LINKS) | w.rlike(r"^\d{1,2}$")
    sign, number = r"^N[°ºo]?\.?$", r"^\d{1,5}$"

    def of(t: Column) -> Column:
        ends = F.sequence(F.lit(3), F.least(F.size(t), F.lit(MOST_NAME_WORDS + 3)))  # of the number, from 1

        def ok(e: Column) -> Column:
            glued = F.element_at(t, e).rlike(r"^N[°ºo]?\.?\d{1,5}\.?$")
            signed = F.element_at(t, e - 1).rlike(sign)
            n = F.when(signed & (e > 3), e - 3).otherwise(e - 2)  # words of the name
            return (glued | F.regexp_replace(F.element_at(t, e), r"\.$", "").rlike(number)) & n.between(1, MOST_NAME_WORDS) & F.forall(F.slice(t, F.lit(2), n), named)

        found = F.filter(ends, ok)
        best = F.array_max(found)
        words = F.rtrim(F.array_join(F.slice(spaced, F.lit(1), best), ""), F.lit(" \t"))
        return F.when(F.size(found) > 0, F.regexp_replace(words, r"\.$", ""))

    return F.when(F.size(tokens) > 2, let(tokens, of))


def _society() -> str:
    """Legal forms, with a point after every letter or after none, so that the point of a sentence stays out."""
    pointed = [r"\s?".join(rf"{c}\." for c in f[:-1]) + rf"\s?{f[-1]}\b\.?" for f in SOCIETIES]
    return rf"(?<=[ \t])(?:{'|'.join([*pointed, *SOCIETIES])})(?!\p{{L}})"


def companies(text: Column) -> Column:
    """Legal forms with the run of capitalised words before each: array<struct<at, m>>. The run goes back word by word, over
    at most five names that single links may join, and doesn't begin with a link or an opener."""
    name = lambda w: w.rlike(r"^\p{Lu}[\p{L}&'-]*$")

    def of(x: Column) -> Column:
        before = F.regexp_extract(look_back(text, x["at"], 240), r"(?:(?<![\p{L}&'-])[\p{L}&'-]+[ \t]+)+$", 0)
        words = F.reverse(F.regexp_extract_all(before, F.lit(r"[\p{L}&'-]+[ \t]+"), F.lit(0)))

        def step(acc: Column, w: Column) -> Column:
            bare = F.rtrim(w, F.lit(" \t"))
            is_name, link = name(bare), bare.isin(*COMPANY_LINKS)
            may = acc["open"] & ((is_name & (acc["names"] < MOST_NAME_WORDS)) | (link & ~acc["link"] & (acc["names"] > 0)))
            return F.struct(may.alias("open"), (acc["names"] + (may & is_name).cast("int")).alias("names"), F.when(may, link & ~is_name).otherwise(acc["link"]).alias("link"), F.when(may, F.concat(acc["kept"], F.array(w))).otherwise(acc["kept"]).alias("kept"))

        start = F.struct(F.lit(True).alias("open"), F.lit(0).alias("names"), F.lit(False).alias("link"), F.array().cast("array<string>").alias("kept"))
        kept = F.reverse(F.aggregate(words, start, step, lambda acc: acc["kept"]))
        opener = lambda w: F.lower(F.rtrim(w, F.lit(" \t"))).isin(*COMPANY_OPENERS)

        def behind(k: Column) -> Column:
            skip = F.coalesce(F.array_min(F.filter(F.transform(k, lambda w, i: F.when(~opener(w) & name(F.rtrim(w, F.lit(" \t"))), i)), lambda i: i.isNotNull())), F.size(k))
            head = F.array_join(F.slice(k, skip + 1, F.greatest(F.size(k) - skip, F.lit(0))), "")
            return F.struct((x["at"] - F.length(head)).alias("at"), F.concat(head, x["m"]).alias("m"), (head != "").alias("named"))

        return let(kept, behind)

    return F.transform(F.filter(F.transform(matches(text, _society()), of), lambda c: c["named"]), lambda c: F.struct(c["at"].alias("at"), c["m"].alias("m")))
