"""Names of persons, by one walk over the words of a text.

The walk goes from left to right with the name that it is in the middle of. A word goes on with the name if its gap, its
capitals and its meaning allow; else the name is closed, and kept or not by what it was begun by and what it holds; then the
word may begin another one: after a title, after a word that announces a person, in an introduction, or as a given name of
the dictionary, with surnames before its comma. So an earlier word decides what a later one is. Words that a kept name holds
announce nothing.

Texts without any word that can begin a name aren't walked, and of others only the parts between signs that end every name.
Everything is built from Spark functions.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let
from . import words as W
from .spans import CLOSE, OPEN, many_matches

TITLE, ANNOUNCED, INTRODUCED, SELF, GIVEN = 1, 2, 3, 4, 5
#: Words of a name that are looked at, and words behind the first in an introduction. Fixed values.
MOST_WORDS, MOST_INTRODUCED = 5, 2

_SPACE = r"^[ \t]+$"


@lru_cache(maxsize=64)
def trie(words: tuple[str, ...]) -> str:
    """An expression for any of the words that looks at each letter once; the longest word wins."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    some = "|".join((r"\s+" if c == " " else c) + trie(tuple(dict.fromkeys(rest))) for c, rest in sorted(heads.items()))
    return "" if not heads else f"(?:{some}|)" if "" in words else f"(?:{some})" if len(heads) > 1 else some


@lru_cache(maxsize=8)
def _beginners(first_names: tuple[str, ...]) -> str:
    words = (*W.TITLES, *W.CONTEXT_SINGLE, *W.CONTEXT_BY, "llamo", "nombre es", "soy", *first_names)
    return rf"(?i)(?<!\p{{L}}){trie(tuple(dict.fromkeys(words)))}(?!\p{{L}})"


@lru_cache(maxsize=8)
def _section_beginners(first_names: tuple[str, ...]) -> str:
    words = (*W.TITLES, *W.CONTEXT_SINGLE, *W.CONTEXT_BY, "llamo", "nombre", "soy", *first_names)
    return rf"(?i{'' if ''.join(first_names).isascii() else 'u'})(?<!\p{{L}}){trie(tuple(dict.fromkeys(words)))}(?!\p{{L}})"


#: A gap that ends every name, and behind which none goes on: with a sign that no gap within a name or before one may hold,
#: or with a point that stands behind no letter, title or place's word. Words that are announced over any gap stay.
_BREAK = (
    rf"(?<![^\p{{L}}'’])(?:(?<!(?<!\p{{L}})(?i:\p{{L}}|{'|'.join((*W.TITLES, *W.PLACE_BEFORE))}))[ \t:,]*+\.|[ \t.:,]*+[^\p{{L}}'’ \t.:,])[^\p{{L}}]*+"
    r"(?!(?i:llamo|nombre|es|por)(?!\p{L}))"
)


def _sections(bare: Column, first_names: tuple[str, ...]) -> Column:
    """The parts of a text between breaks that hold a word that can begin a name: array<struct<at, part>>."""
    none = F.array().cast("array<struct<at:int,part:string>>")
    beginners = _section_beginners(first_names)

    def step(acc: Column, x: Column) -> Column:
        part = F.substring_index(x, CLOSE, -1)
        at = acc["pos"] + F.greatest(F.length(x) - F.length(part) - 1, F.lit(0))
        own = F.array(F.struct(at.alias("at"), part.alias("part")))
        return F.struct((at + F.length(part)).alias("pos"), F.when(part.rlike(beginners), F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    parts = F.split(F.regexp_replace(bare, F.lit(_BREAK), F.lit(f"{OPEN}$0{CLOSE}")), OPEN, -1)
    return F.aggregate(parts, F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda acc: acc["out"])


def _words(bare: Column, first_names: tuple[str, ...]) -> Column:
    """Each word with the gap before it and what it may be by itself; an empty one at the end closes the last name."""
    ambiguous = tuple(x for x in W.AMBIGUOUS if x in first_names)

    def of(x: Column) -> Column:
        gap = F.regexp_extract(x["m"], r"^[^\p{L}]*", 0)
        word = F.substring(x["m"], F.length(gap) + 1, F.length(x["m"]))

        def told(w: Column) -> Column:
            f = F.lower(w)
            at = x["at"] + F.length(gap)
            any_of = lambda words: f.isin(*words) if words else F.lit(False)
            return F.struct(
                at.alias("at"), (at + F.length(w)).alias("end"), f.alias("f"), gap.alias("gap"), F.length(w).alias("size"), w.rlike(r"^\p{Lu}").alias("cap"), ((F.length(w) > 1) & (w == F.upper(w))).alias("upper"),
                any_of(W.NOT_SURNAME).alias("other"), w.isin(*W.CONNECTORS).alias("link"), any_of(first_names).alias("first"), any_of(ambiguous).alias("ambiguous"),
            )

        return let(word, told)

    nothing = F.struct(F.lit(0).alias("at"), F.lit("\n").alias("m"))
    return F.transform(F.concat(many_matches(bare, r"[^\p{L}]*\p{L}[\p{L}'’]*"), F.array(nothing).cast("array<struct<at:int,m:string>>")), of)


def _begun(words: Column, first_names: tuple[str, ...]) -> Column:
    """The words with what a name that begins at each is begun by (0: none), where that word stands, and where the name begins
    with the surnames before a comma."""
    nickname = rf"^{trie(tuple(x for x in first_names if len(x) >= 4))}\p{{L}}"

    def of(w: Column, i: Column) -> Column:
        one, two, three = (F.get(words, i - k) for k in (1, 2, 3))
        yes = lambda c: F.coalesce(c, F.lit(False))
        spaced, person = w["gap"].rlike(_SPACE), w["cap"] & ~w["other"]
        title = person & one["f"].isin(*W.TITLES) & w["gap"].rlike(r"^\.?[ \t]+$")
        by = (one["f"] == "por") & two["f"].isin(*W.CONTEXT_BY) & spaced
        announced = person & ((one["f"].isin(*W.CONTEXT_SINGLE) & w["gap"].rlike(r"^:?[ \t]+$")) | yes(by))
        said = w["gap"].rlike(r"^[ \t]*:?[ \t]+$") & ~w["other"] & ~w["f"].isin(*W.NOT_INTRO_NAME)
        strong = said & (((one["f"] == "llamo") & (two["f"] == "me")) | yes((one["f"] == "es") & (two["f"] == "nombre") & (three["f"] == "mi")))
        known = w["first"] & (w["cap"] | ~w["ambiguous"])
        self_ = said & (one["f"] == "soy") & (known | w["f"].rlike(nickname) | (w["cap"] & ~w["f"].isin(*W.CONTEXT_SINGLE)))
        place = yes(one["f"].isin(*W.PLACE_BEFORE) & w["gap"].rlike(r"^\.?[ \t]+$")) | yes(w["ambiguous"] & spaced & one["f"].isin(*W.PLACE_PREPOSITIONS))
        surname = lambda x: x["cap"] & ~x["first"] & ~x["other"]
        comma = yes(w["gap"].rlike(r"^,[ \t]*$") & surname(one))
        head = F.when(comma & yes(one["gap"].rlike(_SPACE) & surname(two)), two["at"]).when(comma, one["at"])
        kind = F.when(yes(title), TITLE).when(yes(announced), ANNOUNCED).when(yes(strong), INTRODUCED).when(yes(self_), SELF).when(w["cap"] & w["first"] & ~place, GIVEN).otherwise(0)
        # the gap to the word before goes on with a name, also behind an initial's point
        near = spaced | yes((one["size"] == 1) & w["gap"].rlike(r"^\.[ \t]+$"))
        fields = ("at", "end", "cap", "upper", "other", "link", "first", "ambiguous")
        return F.struct(*[w[c].alias(c) for c in fields], spaced.alias("spaced"), near.alias("near"), w["f"].isin(*W.NOT_INTRO_NAME).alias("plain"), kind.alias("kind"), F.coalesce(one["at"], F.lit(-1)).alias("told_at"), head.alias("head"))

    return F.transform(words, of)


_STATE = "struct<out:array<struct<start:int,end:int,confidence:string>>,used:int,kind:int,start:int,end:int,words:int,firsts:int,seen:int,upper:boolean,head:boolean,ambiguous:boolean,known:boolean,done:boolean,again:int,later:int>"


def _step(s: Column, w: Column) -> Column:
    """One word further."""
    # Whether the word goes on with the name that is open.
    intro = s["kind"].isin(INTRODUCED, SELF)
    style = F.when(s["upper"], w["upper"]).otherwise(w["cap"])
    as_link = ~intro & w["near"] & w["link"]
    as_word = F.when(intro, w["spaced"] & ~w["other"] & ~w["plain"] & (w["cap"] | s["known"]) & (s["seen"] <= MOST_INTRODUCED)).otherwise(w["near"] & ~w["link"] & style & ~w["other"])
    open_ = (s["kind"] > 0) & ~s["done"]
    linked, worded = open_ & as_link, open_ & as_word

    # What becomes of it if not.
    surnames = (s["words"] > s["firsts"]) | s["head"]
    sure = F.when(s["kind"] == TITLE, True).when(s["kind"] == ANNOUNCED, (s["words"] > 1) | (s["firsts"] == 1)).when(intro, True).when(s["kind"] == GIVEN, (surnames | (s["firsts"] > 1)) & ~(s["ambiguous"] & ~surnames)).otherwise(False)
    # given names after one that is a word or a place as well may be a name of their own
    rest = (s["kind"] == GIVEN) & ~sure & (s["later"] > 1)
    confidence = F.when((s["kind"] == TITLE) | (s["kind"] == INTRODUCED), "alta").when(s["kind"] == ANNOUNCED, F.when(s["firsts"] > 0, "alta").otherwise("media")).when(s["kind"] == SELF, "media").otherwise(F.when(sure & s["ambiguous"], "baja").otherwise("media"))
    found = F.struct(F.when(sure, s["start"]).otherwise(s["again"]).alias("start"), s["end"].alias("end"), confidence.alias("confidence"))

    def closed(keep: Column) -> Column:
        used = F.when(keep, s["end"]).otherwise(s["used"])
        begins = (w["kind"] > 0) & (w["kind"].isin(GIVEN) | (w["told_at"] >= used))
        kind = F.when(begins, w["kind"]).when((w["kind"] > 0) & w["cap"] & w["first"], GIVEN).otherwise(0)
        return F.struct(
            F.when(keep, F.concat(s["out"], F.array(found))).otherwise(s["out"]).alias("out"), used.alias("used"), kind.alias("kind"), F.when(kind == GIVEN, F.coalesce(w["head"], w["at"])).otherwise(w["at"]).alias("start"), w["end"].alias("end"),
            F.lit(1).alias("words"), w["first"].cast("int").alias("firsts"), F.lit(1).alias("seen"), w["upper"].alias("upper"), ((kind == GIVEN) & w["head"].isNotNull()).alias("head"), w["ambiguous"].alias("ambiguous"), w["first"].alias("known"),
            F.lit(False).alias("done"), F.when(~w["ambiguous"], w["at"]).otherwise(-1).alias("again"), F.when(~w["ambiguous"], 1).otherwise(0).alias("later"),
        ).cast(_STATE)

    begins_again = (s["again"] < 0) & w["first"] & ~w["ambiguous"]
    seen = s["seen"] + 1
    longer = F.struct(
        s["out"].alias("out"), s["used"].alias("used"), s["kind"].alias("kind"), s["start"].alias("start"), F.when(worded, w["end"]).otherwise(s["end"]).alias("end"), (s["words"] + worded.cast("int")).alias("words"), (s["firsts"] + (worded & w["first"]).cast("int")).alias("firsts"),
        seen.alias("seen"), s["upper"].alias("upper"), s["head"].alias("head"), s["ambiguous"].alias("ambiguous"), s["known"].alias("known"), (~intro & worded & (seen > MOST_WORDS)).alias("done"),
        F.when(worded & begins_again, w["at"]).otherwise(s["again"]).alias("again"), (s["later"] + (worded & (begins_again | (s["again"] >= 0))).cast("int")).alias("later"),
    ).cast(_STATE)
    return F.when(linked | worded, longer).otherwise(let((s["kind"] > 0) & (sure | rest), closed))


def names(bare: Column, first_names: tuple[str, ...] = W.FIRST_NAMES) -> Column:
    """array<struct<start, end, confidence>> of the names of a text without accents."""
    none = F.array().cast("array<struct<start:int,end:int,confidence:string>>")
    yes, zero = F.lit(False), F.lit(0)
    start = F.struct(
        none.alias("out"), zero.alias("used"), zero.alias("kind"), zero.alias("start"), zero.alias("end"), zero.alias("words"), zero.alias("firsts"), zero.alias("seen"), yes.alias("upper"), yes.alias("head"), yes.alias("ambiguous"), yes.alias("known"), yes.alias("done"), zero.alias("again"), zero.alias("later"),
    ).cast(_STATE)

    def walked(section: Column) -> Column:
        found = let(_words(section["part"], first_names), lambda words: F.aggregate(_begun(words, first_names), start, _step, lambda s: s["out"]))
        return F.transform(found, lambda n: F.struct((n["start"] + section["at"]).alias("start"), (n["end"] + section["at"]).alias("end"), n["confidence"].alias("confidence")))

    return F.when(bare.rlike(_beginners(first_names)), F.flatten(F.transform(_sections(bare, first_names), walked))).otherwise(none)
