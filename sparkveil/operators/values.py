"""Tests of whole cells that need word lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import fold, let, strip_accents
from ..functions.validators import has_person_shape
from . import words as W
from .scan import sensitive_spans
from .spans import clean


def is_person_name(s: Column, first_names: tuple[str, ...] = W.FIRST_NAMES) -> Column:
    """'Juan Pérez', 'PEREZ, JUAN': two to five words, one of them an unambiguous given name (or two given names)."""

    def test(w: Column) -> Column:
        low = F.transform(w, fold)
        shaped = F.forall(w, lambda x: x.rlike(r"^\p{L}[\p{L}'’.\-]*$"))
        veto = F.exists(low, lambda x: x.isin(*W.NOT_SURNAME) & ~x.isin(*W.CONNECTORS))
        clear = F.exists(low, lambda x: x.isin(*first_names) & ~x.isin(*W.AMBIGUOUS))
        two = F.size(F.filter(low, lambda x: x.isin(*first_names))) >= 2
        return F.size(w).between(2, 5) & shaped & ~veto & (clear | two)

    words = F.filter(F.split(F.trim(s), r"[\s,]+"), lambda x: x != "")
    return F.coalesce(let(words, test), F.lit(False))


def looks_like_person(s: Column, first_names: tuple[str, ...] = W.FIRST_NAMES) -> Column:
    return has_person_shape(s) | is_person_name(s, first_names)


def mentions_sensitive(s: Column) -> Column:
    t = clean(s)
    return F.size(sensitive_spans(t, strip_accents(t))) > 0
