"""Line deduplication by a segment-partition edit join, with Spark expressions only.

Lines are compared with up to ``edits`` edits. A line is split into edits + 1 even segments; whatever the edits, one
segment of the shorter of two matching lines is a substring of the longer, at a place that the lengths bound. So each
line's segments are indexed by length, number and text, and each line probes with the few substrings that may match.
Lines that meet are verified with a banded bit-parallel edit distance. Equal lines, however many, are one entry.

A bucket of the index is never listed as pairs. First each probe meets only the least line of its bucket; what matches
is contracted. Then lines of different components that share a bucket are compared, by signatures of their characters
and neighbouring characters before anything else, so that a family of matching lines costs rows, and a family of lines
that share a segment but don't match costs comparisons of two words of bits, and no rows.

Of each class of equal or matching lines (linked directly or over others) the first stays: that with the least
document key, then text hash, then line number. Lines shorter than ``least`` code points are compared for equality
only. Lines without a letter or digit (blank ones, braces, rules) are layout, and stay.

Defined cases: a null text stays null, and an empty one empty; a text all of whose lines go becomes empty; rows equal in
key and text count as one document and are treated alike, rows of one key and different texts are documents of their
own; a null key sorts first; an empty table gives no rows; extra columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import among, drop_materialized, fresh, let, marked, materialize
from .graph import components

EDITS, LEAST = 2, 24

def _places(edits: int) -> list[tuple[int, int, int]]:
    """Substrings of a line that may equal a segment of a line that is shorter by ``less``: (less, number of the segment, how
    far it has moved). With the first i segments hit by an edit each at least, the segment has moved by i at most; the same
    holds from the right end. The line's own segments are among them."""
    return [(less, i, move) for less in range(edits + 1) for i in range(edits + 1) for move in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)]


def _keys(places: list[tuple[int, int, int]], edits: int) -> Column:
    """Hashes of these substrings, with the shorter line's length and the segment's number. A line has edits + 1 even segments,
    of which the longer ones come last. Many places are one function over a list: as an expression for each, the code that
    Spark makes is too long for the JVM to compile. Lines of ASCII (``bytes``) are cut without counting characters."""
    parts = edits + 1

    def of(less: Column, i: Column, move: Column) -> Column:
        other = F.col("length") - less
        small, short = F.floor(other / parts).cast("int"), parts - other % parts  # short: segments of the smaller size
        start = (i * small + F.greatest(i - short, F.lit(0)) + 1 + move).cast("int")
        size = (small + (i >= short).cast("int")).cast("int")
        key = lambda x: F.xxhash64(other.cast("int"), i, F.substring(x, start, size))
        return F.when(F.col("bytes").isNotNull(), key("bytes")).otherwise(key("line"))

    if len(places) <= parts:
        return F.array(*[of(*map(F.lit, p)) for p in places])
    listed = F.array(*[F.struct(F.lit(a).alias("less"), F.lit(i).alias("i"), F.lit(m).alias("move")) for a, i, m in places])
    return F.transform(listed, lambda p: of(p["less"], p["i"], p["move"]))


def _signatures(line: Column) -> Column:
    """Struct of two words of bits: whether the characters of each of 64 buckets occur an odd number of times, and the
    same for neighbouring characters. One edit changes 2 bits of the first at most, and 4 of the second."""
    flip = lambda acc, c: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), c.cast("int")))  # noqa: E731  a shift counts modulo 64
    word = lambda items: F.aggregate(items, F.lit(0).cast("long"), flip)
    both = lambda codes: F.struct(word(codes).alias("one"), word(F.transform(codes, lambda c, i: c * 7 + 31 * F.coalesce(F.get(codes, i + 1), F.lit(0)))).alias("two"))
    return let(F.transform(F.split(line, ""), lambda c: F.ascii(c)), both)


def _may_match(a: Column, b: Column, edits: int) -> Column:
    return (F.bit_count(a["one"].bitwiseXOR(b["one"])) <= 2 * edits) & (F.bit_count(a["two"].bitwiseXOR(b["two"])) <= 4 * edits)


def _common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix, by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])
    most = F.least(F.length(a), F.length(b))
    longer = lambda at, step: (at + step <= most) & (F.substring(a, at + 1, step) == F.substring(b, at + 1, step))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(longer(at, step), at + step).otherwise(at))


def _bit_parallel(a: Column, b: Column, edits: int) -> Column:
    """Whether two character arrays are within ``edits`` edits. Bit d of state e stands for the diagonal d - edits of the
    matrix and says that its cell in the current row is reached with e edits; a row is a few shifts and ors."""
    width = 2 * edits + 1
    band = (1 << width) - 1

    def closed(states: list[Column]) -> list[Column]:
        """With insertions: one more edit, the next diagonal."""
        for e in range(1, edits + 1):
            states[e] = states[e].bitwiseOR(F.shiftleft(states[e - 1], 1).bitwiseAND(F.lit(band)))
        return states

    start = [sum(1 << (edits + k) for k in range(e + 1)) for e in range(edits + 1)]

    def row(states: Column, i: Column) -> Column:
        here = F.get(a, i)
        equal = [F.when(F.get(b, i + (d - edits)) == here, F.lit(1 << d)).otherwise(F.lit(0)) for d in range(width)]
        match = equal[0]
        for x in equal[1:]:
            match = match.bitwiseOR(x)

        def step(m: Column) -> Column:
            old = [F.get(states, F.lit(e)) for e in range(edits + 1)]
            new = [old[0].bitwiseAND(m)]
            for e in range(1, edits + 1):
                new.append(old[e].bitwiseAND(m).bitwiseOR(old[e - 1]).bitwiseOR(F.shiftright(old[e - 1], 1)))
            return F.array(*closed(new))

        return let(match, step)

    rows = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))
    last = F.aggregate(rows, F.array(*[F.lit(x) for x in start]), row)
    diagonal = F.size(b) - F.size(a) + edits
    reached = let(last, lambda s: F.exists(s, lambda x: F.getbit(x, F.greatest(diagonal, F.lit(0)).cast("int")) == 1))
    return (F.abs(F.size(b) - F.size(a)) <= edits) & reached


def _near(a: Column, b: Column, edits: int) -> Column:
    """Whether two lines are within ``edits`` edits: what they share at both ends is cut first. Every part is bound by
    ``let``: as columns of their own, Spark would copy them into each use, and compute them as often."""
    rest = lambda x, p: F.reverse(F.substring(x, p + 1, F.length(x)))
    chars = lambda x, s: let(F.substring(x, s + 1, F.length(x)), lambda y: F.when(y == "", F.array().cast("array<string>")).otherwise(F.split(y, "")))
    cut = lambda r, s: F.struct(chars(r["a"], s).alias("a"), chars(r["b"], s).alias("b"))
    inner = lambda r: let(_common_prefix(r["a"], r["b"]), lambda s: let(cut(r, s), lambda c: _bit_parallel(c["a"], c["b"], edits)))
    return let(_common_prefix(a, b), lambda p: let(F.struct(rest(a, p).alias("a"), rest(b, p).alias("b")), inner))


def _within(pairs: DataFrame, edits: int) -> DataFrame:
    """Pairs (line_a, line_b) within ``edits`` edits."""
    return pairs.where(_near(F.col("line_a"), F.col("line_b"), edits))


def _id(line: Column) -> Column:
    """128 bits that stand for a line, of which the first 64 (``h``) do in the join of segments: lines that share those are
    told apart when they are verified."""
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g"))


def matching_lines(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """Distinct lines (line) of more than ``edits`` code points -> edges (a, b) between ids of lines, different and within
    ``edits`` edits. Every matching pair is an edge or lies in a component of edges."""
    known = lines.select(F.xxhash64("line").alias("h"), "line")
    places = _places(edits)
    own = [(0, i, 0) for i in range(edits + 1)]
    cut = known.select("h", "line", F.length("line").alias("length"), F.when(F.octet_length("line") == F.length("line"), F.col("line").cast("binary")).alias("bytes"))
    hubs = cut.select("h", F.explode(_keys(own, edits)).alias("k")).groupBy("k").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    probe = cut.select("h", F.posexplode(_keys(places, edits)).alias("p", "k"))
    is_own = F.col("p").isin([places.index(x) for x in own])
    met = hubs.hint("merge").join(probe, "k").where("low <> h or high <> h").select("k", "h", "low", (F.col("low") < F.col("high")).alias("many"), is_own.alias("own"))
    met = materialize(met)
    texts = materialize(among(known, met.select("h").union(met.select("low"))))
    side = lambda name, out: texts.select(F.col("h").alias(name), F.col("line").alias(out))
    edge = lambda df: df.select(_id(F.col("line_a")).alias("a"), _id(F.col("line_b")).alias("b"))
    first = met.where("low <> h").select(F.least("low", "h").alias("x"), F.greatest("low", "h").alias("y")).distinct()
    first = first.hint("merge").join(side("x", "line_a"), "x").hint("merge").join(side("y", "line_b"), "y")
    edges = materialize(edge(_within(first, edits)))
    roots = components(edges)

    # Buckets of several lines: members and probes of different components.
    wide = met.where("many").select("k", "h", "own").distinct()
    asked = texts.hint("merge").join(wide.select("h").distinct(), "h", "left_semi").select("h", "line", _id(F.col("line")).alias("id"), _signatures(F.col("line")).alias("s"))
    asked = asked.join(roots, asked["id"] == roots["node"], "left").select("h", "line", "s", F.coalesce("root", "id").alias("c"))
    rows = materialize(wide.hint("merge").join(asked, "h"))
    a = rows.where("own").select("k", F.col("line").alias("line_a"), F.col("s").alias("s_a"), F.col("c").alias("c_a"))
    b = rows.select("k", F.col("line").alias("line_b"), F.col("s").alias("s_b"), F.col("c").alias("c_b"))
    apart = a.hint("merge").join(b, "k").where((F.col("c_a") != F.col("c_b")) & _may_match(F.col("s_a"), F.col("s_b"), edits))
    more = materialize(edge(_within(apart.select("line_a", "line_b"), edits)))
    drop_materialized(met, texts, rows)
    return edges.union(more)


def _explode(docs: DataFrame) -> DataFrame:
    """Documents (key, th, text) -> places (key, th, at, line, h, g)."""
    rows = docs.select("key", "th", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return rows.where(F.col("line").rlike(r"[\p{L}\p{N}]")).select("*", _id(F.col("line")).alias("id_")).select("key", "th", "at", "line", "id_.*")


def dropped_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """Documents (key, th: a hash of the text, text) -> (key, th, gone: array of line numbers from 0), of those that lose lines."""
    least = max(least, edits + 1)
    places = _explode(docs)
    groups = materialize(places.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("key", "th", "at")).alias("first")))
    # Lines that occur once need no shuffle to be distinct.
    long = marked(places.where(F.length("line") >= least).select("line", "h"), groups.where("n > 1").select("h"), "again")
    distinct = long.where(~F.col("again")).select("line").union(long.where("again").select("line").distinct())
    edges = matching_lines(distinct, edits)
    roots = components(edges).select(F.col("node.h").alias("h"), F.col("node.g").alias("g"), "root")
    roots = materialize(roots)
    paired = marked(groups, roots, "paired").where("n > 1 or paired").drop("paired")
    classed = materialize(paired.join(roots, ["h", "g"], "left").where("n > 1 or root is not null").select("h", "g", "first", F.coalesce("root", F.struct("h", "g")).alias("root")))
    firsts = classed.groupBy("root").agg(F.min("first").alias("first"))
    of = materialize(classed.select("h", "g", "root").join(firsts, "root").select("h", "g", "first"))
    drop_materialized(groups, roots, classed)
    here = among(places.select("key", "th", "at", "h", "g"), of.select("h"))
    gone = here.join(of, ["h", "g"]).where(~F.struct("key", "th", "at").eqNullSafe(F.col("first")))
    return materialize(gone.groupBy("key", "th").agg(F.collect_set("at").alias("gone")))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``."""
    k, h, g = fresh(docs, "sv_key", "sv_hash", "sv_gone")
    gone = dropped_lines(docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("text")), edits, least)
    gone = gone.select(F.col("key").alias(k), F.col("th").alias(h), F.col("gone").alias(g))
    # What goes grows with the documents, so it is never broadcast, however small it is here.
    joined = docs.join(gone.hint("merge"), docs[key].eqNullSafe(gone[k]) & (F.xxhash64(docs[text]) == gone[h]), "left")
    parts = F.split(F.col(text), "\n")
    keep = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(g)), lambda i: F.get(x, i))
    cleaned = F.when(F.col(g).isNull(), F.col(text)).otherwise(F.array_join(let(parts, keep), "\n"))
    return joined.withColumn(text, cleaned).select(*[F.col(c) for c in docs.columns])


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What ``dedup_lines`` left of each document."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key), F.size(F.split(t, "\n")).cast("long").alias("n_lines_kept"), F.length(t).cast("long").alias("n_chars_kept"), F.sha2(t.cast("binary"), 256).alias("kept_sha256"))
