"""Text normalisation as Column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import DIGIT_TYPES


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


@lru_cache
def _accents() -> tuple[str, str]:
    """By rule, from the Unicode tables: letters that are a base letter with marks, and the base letters."""
    pairs = {}
    for code in range(0xA0, min(sys.maxunicode, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(0x300 <= ord(c) <= 0x36F for c in parts[1:]):
            pairs[chr(code)] = parts[0]
    return "".join(pairs), "".join(pairs.values())


#: Combining marks.
MARKS = "".join(map(chr, range(0x300, 0x370)))


def strip_accents(s: Column) -> Column:
    """Precomposed letters become their base letter; lengths and offsets stay."""
    plain = F.length(s) == F.octet_length(s)  # translating goes letter by letter
    return F.when(plain, s).otherwise(F.translate(s, *_accents()))


def fold(s: Column) -> Column:
    """Without accents and in lower case. Combining marks go, so offsets hold for texts in composed form only."""
    return F.lower(F.translate(strip_accents(s), MARKS, ""))


def fold_text(s: str) -> str:
    """``fold`` of a driver-side string (headers, word lists)."""
    return "".join(c for c in unicodedata.normalize("NFD", s) if not 0x300 <= ord(c) <= 0x36F).lower()


def only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def normalize_text(s: Column) -> Column:
    """'Pérez S.A.' -> 'perez sa'."""
    bare = F.translate(fold(s), ".,;:'\"()", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(bare, "[_\\-/]+", " "), "[\\s\\u00a0]+", " "))


def normalize_str(s: str) -> str:
    """``normalize_text`` of a driver-side string."""
    bare = "".join(" " if c in "_-/" else c for c in fold_text(s) if c not in ".,;:'\"()")
    return " ".join(bare.split())


def cell_text(c: Column, kind: str = "string") -> Column:
    """A cell as text: null is empty, dates print as a UTC day, doubles without a needless fraction."""
    if kind in ("date", "timestamp"):
        s = F.date_format(c, "yyyy-MM-dd")
    elif kind in ("double", "float"):
        s = F.when(c == F.floor(c), F.format_string("%.0f", c.cast("double"))).otherwise(c.cast("string"))
    else:
        s = F.trim(c.cast("string"))
    return F.coalesce(s, F.lit(""))


def is_empty(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""


def mask(value: Column) -> Column:
    """For display: '20•••••••••6', 'u•••@d•••'."""
    s = F.trim(value)
    n = F.length(s)
    keep = F.when(n > 8, 2).otherwise(1)
    dots = F.repeat(F.lit("•"), F.least(n - keep * 2, F.lit(10)).cast("int"))
    mail = F.concat(F.substring(F.split_part(s, F.lit("@"), F.lit(1)), 1, 1), F.lit("•••@"), F.substring(F.split_part(s, F.lit("@"), F.lit(2)), 1, 1), F.lit("•••"))
    return F.when(n <= 3, F.repeat(F.lit("•"), n)).when(s.contains("@"), mail).otherwise(F.concat(F.substring(s, F.lit(1), keep), dots, F.right(s, keep)))


def equivalence_key(kind: Column, raw: Column) -> Column:
    """Equal for one value written in different ways."""
    digits = only_digits(raw)
    return (
        F.when(kind.isin(*DIGIT_TYPES) & (F.length(digits) >= 6), digits)
        .when(kind.isin("PATENTE", "PASAPORTE"), F.upper(F.regexp_replace(raw, "[\\s\\-]", "")))
        .otherwise(normalize_text(raw))
    )


def name_words(s: Column) -> Column:
    return F.filter(F.split(fold(s), "[^\\p{L}]+"), lambda w: w != "")


# The markers left by anonymisation, and words that may stand beside a pseudonym.
PSEUDONYM_RE = r"\p{L}[\p{L}\p{N}]*_\d+"
MARKER_RE = r"\[[\p{Lu} ]+\]|\*{3}@\S+|\*{4} \d{4}"
FILLER_RE = "de|del|y|e|o|la|el|los|las|sr|sra|srta|dr|dra|lic|ing|don|doña"


def is_protected(value: Column) -> Column:
    """Nothing but pseudonyms and markers, with titles and connectors at most."""
    gap = "[\\s,;:/()\"'«»]"
    edge = "[¿¡.]*"
    word = f"(?:{edge}(?:{PSEUDONYM_RE}|(?iu:{FILLER_RE}))?[.!?]*)"
    whole = f"^(?:(?:{MARKER_RE})|{word}(?:{gap}+|$|(?=\\[|\\*)))*$"
    return F.coalesce(value.rlike(f"(?:{MARKER_RE})|(?<![\\p{{L}}\\p{{N}}_]){PSEUDONYM_RE}(?![\\p{{L}}\\p{{N}}_])") & value.rlike(whole), F.lit(False))


def slug(title: Column) -> Column:
    """A chart title as a file name of at most 60 characters."""
    s = F.regexp_replace(F.lower(F.translate(strip_accents(title), MARKS, "")), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, 60)
