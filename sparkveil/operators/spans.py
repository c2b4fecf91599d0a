"""Spans of a text as arrays of structs, found and resolved with built-in functions only.

Spark's regular expressions give matches without their places. Here every match is put between two control characters,
the text is cut at them, and the lengths of the parts give the offsets. No Python runs on executors, and a text with
no match costs one pass of the expression.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import MARKS, fold_text, let, strip_accents
from ..types import SPANS

OPEN, CLOSE = "\x01", "\x02"
#: Code points before a match that its rule may look at.
LOOK_BACK = 40


def clean(text: Column) -> Column:
    """``text`` without the two control characters; offsets stay."""
    marked = text.contains(OPEN) | text.contains(CLOSE)  # translating goes letter by letter, and next to no text needs it
    return F.coalesce(F.when(marked, F.translate(text, OPEN + CLOSE, "  ")).otherwise(text), F.lit(""))


def matches(text: Column, pattern: str) -> Column:
    """Non-overlapping matches, left to right: array<struct<at:int,m:string>>. ``text`` must be ``clean``."""
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}")), OPEN, -1)
    none = F.array().cast("array<struct<at:int,m:string>>")

    def gather(p: Column) -> Column:
        def step(acc: Column, part: Column) -> Column:
            found = F.struct(acc["pos"].alias("at"), F.substring_index(part, CLOSE, 1).alias("m"))
            return F.struct((acc["pos"] + F.length(part) - 1).alias("pos"), F.concat(acc["out"], F.array(found)).alias("out"))

        start = F.struct(F.length(p[0]).alias("pos"), none.alias("out"))
        return F.when(F.size(p) > 1, F.aggregate(F.slice(p, F.lit(2), F.size(p) - 1), start, step, lambda acc: acc["out"])).otherwise(none)

    return let(parts, gather)


#: Matches that are placed one after another; more are placed by blocks, so that arrays are copied within a block only.
BLOCK = 128


def many_matches(text: Column, pattern: str) -> Column:
    """``matches`` for texts of very many: its work follows their number."""
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}")), OPEN, -1)
    none = F.array().cast("array<struct<at:int,m:string>>")

    def gather(p: Column) -> Column:
        n = F.size(p) - 1
        blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
        own = lambda b: F.slice(p, b * BLOCK + 2, F.lit(BLOCK))
        total = lambda x, size: F.aggregate(x, F.lit(0), lambda acc, v: acc + size(v))

        def placed(sums: Column) -> Column:
            def of(b: Column) -> Column:
                def step(acc: Column, part: Column) -> Column:
                    found = F.struct(acc["pos"].alias("at"), F.substring_index(part, CLOSE, 1).alias("m"))
                    return F.struct((acc["pos"] + F.length(part) - 1).alias("pos"), F.concat(acc["out"], F.array(found)).alias("out"))

                start = F.length(p[0]) + total(F.slice(sums, F.lit(1), b), lambda v: v)
                return F.aggregate(own(b), F.struct(start.alias("pos"), none.alias("out")), step, lambda acc: acc["out"])

            return F.flatten(F.transform(blocks, of))

        return let(F.transform(blocks, lambda b: total(own(b), lambda v: F.length(v) - 1)), placed)

    return let(parts, gather)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def accept(first: Column, more: Column) -> Column:
    """``first``, and those of ``more``, in their order, that overlap nothing accepted before."""
    take = lambda acc, c: F.when(F.exists(acc, lambda a: overlaps(a, c)), acc).otherwise(F.concat(acc, F.array(c)))
    return F.aggregate(more, first, take)


def by_start(spans: Column) -> Column:
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("k"), s.alias("s")))), lambda x: x["s"])


def merge_spans(priority: Column, rest: Column) -> Column:
    """Spans of both, in reading order; those of ``priority`` win."""
    return by_start(accept(accept(F.array().cast(SPANS), priority), rest))


def replace_spans(text: Column, spans: Column, replacement) -> Column:
    """``text`` with every span (in reading order, not overlapping) replaced by ``replacement(span)``."""

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"])
        return F.struct(F.concat(acc["out"], before, replacement(s)).alias("out"), s["end"].alias("pos"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))


def count_by_type(spans: Column) -> Column:
    """map<type, count> of one text's spans."""
    kinds = F.transform(spans, lambda s: s["type"])
    entry = lambda k: F.struct(k.alias("key"), F.size(F.filter(kinds, lambda x: x == k)).alias("value"))
    return F.map_from_entries(F.transform(F.array_distinct(kinds), entry))


def look_back(text: Column, start: Column, width: int = LOOK_BACK) -> Column:
    return F.substring(text, F.greatest(start - width, F.lit(0)) + 1, F.least(start, F.lit(width)))


@lru_cache(maxsize=1)
def _variants() -> dict[str, str]:
    """Letter -> the characters that fold to it, by rule from the Unicode tables."""
    out: dict[str, str] = {}
    for code in range(0x41, 0x2000):
        c = chr(code)
        if c.isalpha() and len(folded := fold_text(c)) == 1:
            out[folded] = out.get(folded, "") + c
    return out


def _lettered(needles: Iterable[str]) -> str:
    """An expression for any of the folded needles, however they are accented and written, that looks at each letter once;
    the longest needle wins."""
    heads: dict[str, list[str]] = {}
    for n in needles:
        if n:
            heads.setdefault(n[0], []).append(n[1:])

    def one(c: str) -> str:
        written = _variants().get(c, c)
        plain, other = "".join(x for x in written if x.isascii()), "".join(x for x in written if not x.isascii())
        if len(written) == 1:
            return "\\" + c if c.isascii() and not c.isalnum() else c
        # a letter is compared with the accented ones, one after another, only if it isn't ASCII
        return f"[{plain}[\\x{{80}}-\\x{{10FFFF}}&&[{other}]]]" if plain and other else f"[{written}]"

    some = "|".join(one(c) + _lettered(rest) for c, rest in sorted(heads.items()))
    return "" if not heads else f"(?:{some}|)" if "" in needles else f"(?:{some})" if len(heads) > 1 else some


def layers(needles: list[str]) -> list[list[str]]:
    """The needles dealt into few lists in which none can overlap another one or itself."""

    def meet(a: str, b: str) -> bool:
        """Whether ``b`` may begin inside of ``a``; of two whole words neither does."""
        return not (a.isalpha() and b.isalpha()) and (any(b.startswith(a[k : k + len(b)]) for k in range(1, len(a))) or a != b and (b in a or a in b))

    out: list[list[str]] = []
    for n in needles:
        home = next((x for x in out if not any(meet(n, o) or meet(o, n) for o in x)), None)
        home.append(n) if home is not None else out.append([n])
    return out


def find_listed(text: Column, terms: list[tuple[int, str, str]]) -> Column:
    """Whole-word occurrences of a short list of terms (ord, needle, type; needles are folded), by ``ord`` and place. A text is
    read once for each layer of needles, mostly once, whatever their number; nothing but the matches is folded."""
    listed = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(n).alias("needle"), F.lit(t).alias("type")) for o, n, t in terms])
    edge = r"[\p{L}\p{N}]"

    def spans(x: Column) -> Column:
        folded = F.lower(F.translate(strip_accents(x["m"]), MARKS, ""))
        span = lambda t: F.struct(t["type"].alias("type"), x["at"].alias("start"), (x["at"] + F.length(x["m"])).alias("end"), x["m"].alias("value"), F.lit("alta").alias("confidence"), F.lit("termino").alias("source"))
        return let(folded, lambda own: F.transform(F.filter(listed, lambda t: t["needle"] == own), lambda t: F.struct(t["ord"].alias("ord"), x["at"].alias("at"), span(t).alias("s"))))

    hits = [F.flatten(F.transform(many_matches(clean(text), f"(?<!{edge})(?:{_lettered(some)})(?!{edge})"), spans)) for some in layers(sorted({n for _, n, _ in terms}))]
    return F.transform(F.array_sort(F.concat(*hits)), lambda h: h["s"]).cast(SPANS) if hits else F.array().cast(SPANS)


def find_terms(text: Column, terms: Column) -> Column:
    """Whole-word occurrences of ``terms`` (array<struct<value,type>>) whatever the case and accents, term by term."""

    def of(term: Column, folded: Column) -> Column:
        needle = F.lower(F.translate(strip_accents(F.trim(term["value"])), MARKS, ""))
        pieces = F.split(folded, F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)

        def places(p: Column) -> Column:
            size = F.length(needle)

            def step(acc: Column, i: Column) -> Column:
                at = acc["pos"] + F.length(F.get(p, i))
                left, right = F.right(F.get(p, i), F.lit(1)), F.left(F.get(p, i + 1), F.lit(1))
                # what stands directly beside is the needle itself when the part between is empty
                left = F.when((F.length(F.get(p, i)) == 0) & (i > 0), F.right(needle, F.lit(1))).otherwise(left)
                right = F.when((F.length(F.get(p, i + 1)) == 0) & (i + 2 < F.size(p)), F.left(needle, F.lit(1))).otherwise(right)
                whole = ~left.rlike(r"[\p{L}\p{N}]") & ~right.rlike(r"[\p{L}\p{N}]")
                span = F.struct(term["type"].alias("type"), at.alias("start"), (at + size).alias("end"), F.substring(text, at + 1, size).alias("value"), F.lit("alta").alias("confidence"), F.lit("termino").alias("source"))
                return F.struct((at + size).alias("pos"), F.when(whole, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

            start = F.struct(F.lit(0).alias("pos"), F.array().cast(SPANS).alias("out"))
            hits = F.when(F.size(p) > 1, F.sequence(F.lit(0), F.size(p) - 2)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(hits, start, step, lambda acc: acc["out"])

        return F.when(F.length(needle) >= 2, let(pieces, places)).otherwise(F.array().cast(SPANS))

    found = let(F.lower(strip_accents(clean(text))), lambda folded: F.flatten(F.transform(terms, lambda t: of(t, folded))))
    return F.coalesce(found, F.array().cast(SPANS))
