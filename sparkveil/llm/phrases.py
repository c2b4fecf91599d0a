"""Phrase collocations by contiguous pattern growth.

A phrase is a row of words within a piece of text. What is frequent enough grows to the right: the occurrence pointers of a
frequent word are projected onto the words behind it as long as the next two and three words together are frequent as well
(bitmaps of a size that follows their number, up to 16 MB, say so; a bit that lets more through costs work, not rightness).
Each pointer's window, up to five words, is counted where it is found, so a phrase in a third of all texts is few windows.
Windows travel as sorted runs. The projections of each language and first word are put in the order of the words behind
it, and one task walks each depth first: a prefix's count is the sum over its windows, and those of a longer prefix lie
among them. Prefixes are dealt out by ranges, so one that is too large for a task goes on in another, and the counts of
those at a cut are added.

A phrase of two words or more is scored by its weakest cut into two parts: floor(scale * f(phrase) * n / (f(left) *
f(right))), n being all words of the language. It goes if a longer phrase around it is as frequent (``cover`` percent).

Defined cases: a null text is empty, a null language is ``und``, and so is the language of that name; ids aren't read, and
repeated rows count each; ties follow the phrase's bytes; phrases are equal if their words are, whatever the space between
them; an empty table gives no rows; a word holds any characters but space and tab, control characters included.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_materialized, materialize

LEAST, LONGEST, COVER, TOP, SCALE, UNKNOWN = 100, 5, 100, 2000, 1000, "und"
#: Words that a task counts at once, and the most bits of a filter.
CHUNK, FILTER_BITS = 1 << 19, 1 << 27
#: Windows of a range, every how many'th window of a run is a sample, and the most samples and ranges that there are.
RANGE, SAMPLED, MOST_SAMPLES, MOST_RANGES = 100_000, 1000, 200_000, 100_000
#: What ends a piece of text.
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Words -> their numbers in a chunk, by first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


@dataclass
class _Chunk:
    """Texts as one row of word numbers, -1 behind each piece, with the hash of each phrase by its first word's place."""

    words: list[bytes]
    langs: list[bytes]
    ids: np.ndarray
    lang: np.ndarray

    def hashes(self, longest: int) -> list[np.ndarray]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        of = np.fromiter((digest(w) for w in self.words), np.uint64, len(self.words))
        out = [np.fromiter((digest(x, 7) for x in self.langs), np.uint64, len(self.langs))[self.lang]]
        of = np.append(of, np.uint64(0))[self.ids]
        with np.errstate(over="ignore"):
            for k in range(longest):
                x = (out[-1] ^ (out[-1] >> np.uint64(29))) * _MIX + np.append(of[k:], np.zeros(k, np.uint64))
                out.append((x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9))
        return out

    def inside(self, longest: int) -> list[np.ndarray]:
        """For k from 0: whether k words begin here."""
        word, out = self.ids >= 0, [np.ones(len(self.ids), bool)]
        for k in range(longest):
            out.append(out[-1] & np.append(word[k:], np.zeros(k, bool)))
        return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    """Of batches (lang, text)."""
    words, langs = _Words(), _Words()
    ids: list[np.ndarray] = []
    lang: list[tuple[int, int]] = []
    held = 0

    def taken() -> _Chunk:
        return _Chunk(list(words), list(langs), np.concatenate(ids), np.repeat(np.array([x[0] for x in lang]), np.array([x[1] for x in lang])))

    for batch in batches:
        for name, text in zip(batch.column(0), batch.column(1), strict=True):
            name, found = (name.as_py() if name.is_valid else UNKNOWN).encode(), []
            for piece in (text.as_py() or "").encode().lower().translate(_ENDS).split(b"\n"):
                if some := piece.split():
                    found.extend(map(words.__getitem__, some))
                    found.append(-1)
            if found:
                ids.append(np.array(found, np.int32))
                lang.append((langs[name], len(found)))
                held += len(found)
            if held >= CHUNK:
                yield taken()
                words, langs, ids, lang, held = _Words(), _Words(), [], [], 0
    if held:
        yield taken()


def _hit(filter_: Broadcast, hashes: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(filter_.value, np.uint8)
    at = (hashes & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _later(x: np.ndarray, k: int) -> np.ndarray:
    return np.append(x[k:], np.zeros(min(k, len(x)), x.dtype))


def _counter(lengths: tuple[int, ...], pairs: Broadcast | None = None):
    """Texts -> (k, g, c): counts of the phrases of so many words; those of three only where both pairs are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            hashes, inside = chunk.hashes(max(lengths)), chunk.inside(max(lengths))
            for k in lengths:
                fine = inside[k]
                if pairs is not None:
                    hit = _hit(pairs, hashes[2]) & inside[2]
                    fine = fine & hit & _later(hit, 1)
                g, c = np.unique(hashes[k][fine], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k, np.int8)), pa.array(g.view(np.int64)), pa.array(c.astype(np.int64))], names=["k", "g", "c"])

    return run


def _escaped(word: bytes) -> bytes:
    """So that NUL can part words: no other byte sorts before it."""
    return word.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01") if b"\x00" in word or b"\x01" in word else word


def _projector(longest: int, frequent: list[Broadcast]):
    """Texts -> (n, some, run), one a chunk: its sorted windows (path, c), packed, their number and some paths. Windows begin
    at frequent words and grow while two and three words together are frequent; a path is the language and the words, and the language alone counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            hashes, inside = chunk.hashes(longest), chunk.inside(longest)
            size = np.zeros(len(chunk.ids), np.int64)
            grows = inside[1]
            for k in range(1, longest + 1):
                last = min(k, 3)  # the last words of the window are frequent together
                grows = grows & inside[k] & _later(_hit(frequent[last - 1], hashes[last]) & inside[last], k - last)
                size[grows] = k
            words, langs = [_escaped(w) for w in chunk.words], [_escaped(x) for x in chunk.langs]
            paths, counts = [], []
            for k in range(longest + 1):
                at = np.flatnonzero((size == k) & inside[1])
                _, first, c = np.unique(hashes[k][at], return_index=True, return_counts=True)
                for i in at[first].tolist():
                    paths.append(b"\x00".join([langs[chunk.lang[i]], *[words[w] for w in chunk.ids[i : i + k]]]))
                counts.append(c)
            run_ = pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), pa.array(np.concatenate(counts).astype(np.int64))], names=["path", "c"]).sort_by("path")
            some = run_.column(0).take(pa.array(np.arange(0, len(paths), SAMPLED)))
            yield pa.RecordBatch.from_arrays([pa.array([len(paths)]), pa.array([some.to_pylist()], pa.list_(pa.binary())), pa.array([_packed(run_)], pa.binary())], names=["n", "some", "run"])

    return run


def _packed(run: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, run.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_batch(run)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: pa.BinaryScalar) -> pa.Table:
    with pa.ipc.open_stream(raw.as_buffer()) as stream:
        return stream.read_all()


def _cutter(bounds: list[bytes]):
    """Sorted runs -> (part, run): the pieces of each range of paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                whole = _unpacked(raw).combine_chunks().to_batches()[0]
                paths = whole.column(0).to_pylist()
                cuts = [0, *(bisect_left(paths, b) for b in bounds), len(paths)]
                parts = [k for k in range(len(cuts) - 1) if cuts[k] < cuts[k + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([_packed(whole.slice(cuts[k], cuts[k + 1] - cuts[k])) for k in parts], pa.binary())], names=["part", "run"])

    return run


def _walk(windows: list[tuple[bytes, int]], least: int) -> tuple[list[bytes], list[int]]:
    """Sorted windows and counts of a range -> prefixes and counts, depth first: those that are frequent, and those of the
    first and last window, which may go on outside of the range."""
    now: list[bytes] = []
    counts: list[int] = []
    edge: list[bool] = []
    out: tuple[list, list] = ([], [])

    def back(depth: int, last: bool = False) -> None:
        while len(now) > depth:
            if counts[-1] >= least or edge[-1] or last:
                out[0].append(b"\x00".join(now))
                out[1].append(counts[-1])
            c = counts.pop()
            if counts:
                counts[-1] += c
            now.pop()
            edge.pop()

    for k, (path, c) in enumerate(windows):
        steps = path.split(b"\x00")
        same = 0
        for a, b in zip(now, steps):  # noqa: B905  the shorter one ends it
            if a != b:
                break
            same += 1
        back(same)
        for step in steps[same:]:
            now.append(step)
            counts.append(0)
            edge.append(k == 0)
        counts[-1] += c
    back(0, last=True)
    return out


def _grower(least: int):
    """(part, run), sorted by part -> (path, c) of each prefix that is frequent, or may go on in another part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        at = None
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != at and held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(_walk(sorted(held.items()), least), (pa.binary(), pa.int64()), strict=True)], names=["path", "c"])
                    held = {}
                at = part
                piece = _unpacked(raw)
                for path, c in zip(piece["path"].to_pylist(), piece["c"].to_pylist(), strict=True):
                    held[path] = held.get(path, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(_walk(sorted(held.items()), least), (pa.binary(), pa.int64()), strict=True)], names=["path", "c"])

    return run


def _bounds(runs: DataFrame, size: int) -> list[bytes]:
    """Paths that cut all windows into ranges of about ``size``, from the samples of each run; where these are many, from
    those that a hash picks, so that the driver sees a bounded number."""
    total, known = runs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("some")), F.lit(0))).first()
    spread = max(1, known // MOST_SAMPLES)
    some = runs.select(F.explode("some").alias("path")).where(F.pmod(F.xxhash64("path"), F.lit(spread)) == 0)
    found = sorted(bytes(r["path"]) for r in some.collect())
    ranges = min(-(-total // size), MOST_RANGES)
    return sorted({found[k * len(found) // ranges] for k in range(1, ranges)}) if found else []


def _filter(found: DataFrame) -> Broadcast:
    """A bitmap of frequent hashes (g): 64 bits for each, rounded up to a power of two, ``FILTER_BITS`` at most."""
    bits = 1 << 15
    n = found.count()
    while bits < min(64 * n, FILTER_BITS):
        bits *= 2
    at = F.col("g").bitwiseAND(F.lit(bits - 1))
    maps = found.groupBy(F.shiftright(at, 15).cast("int").alias("x")).agg(F.call_function("bitmap_construct_agg", at.bitwiseAND(F.lit((1 << 15) - 1))).alias("b"))
    out = bytearray(bits // 8)
    for row in maps.toLocalIterator():
        out[row["x"] << 12 : (row["x"] + 1) << 12] = row["b"]
    return found.sparkSession.sparkContext.broadcast(bytes(out))


def frequent_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(path, c): each phrase of up to ``longest`` words that occurs so often in a language, and each language with its
    number of words. A path is the language and the words, parted by NUL."""
    texts = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    frequent = lambda *a: texts.mapInArrow(_counter(*a), "k byte, g long, c long").groupBy("k", "g").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select("k", "g")
    counted = materialize(frequent((1, 2)))
    filters = [_filter(counted.where(f"k = {k}").select("g")) for k in (1, 2)]
    drop_materialized(counted)
    counted = materialize(frequent((3,), filters[1]))
    filters.append(_filter(counted.select("g")))
    drop_materialized(counted)
    projected = materialize(texts.mapInArrow(_projector(longest, filters), "n long, some array<binary>, run binary"))
    pieces = projected.select("run").mapInArrow(_cutter(_bounds(projected, RANGE)), "part int, run binary")
    grown = pieces.repartition(F.col("part")).sortWithinPartitions("part").mapInArrow(_grower(least), "path binary, c long")
    out = materialize(grown.groupBy("path").agg(F.sum("c").alias("c")))
    drop_materialized(projected)
    for f in filters:
        f.unpersist()
    steps = F.split(F.col("path").cast("string"), "\x00")
    return out.select(steps.alias("steps"), "c").where((F.size("steps") == 1) | (F.col("c") >= least))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, cover: int = COVER, top: int = TOP, scale: int = SCALE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases."""
    found = materialize(frequent_phrases(docs, lang, text, least, longest).select(F.col("steps")[0].alias("lang"), F.slice("steps", 2, longest).alias("w"), "c"))
    totals = found.where(F.size("w") == 0).select("lang", F.col("c").alias("n"))
    phrases = found.where(F.size("w") > 0)
    candidates = phrases.where(F.size("w") > 1)
    # A longer phrase that is as frequent is one word longer, or holds one of those that is as frequent.
    inner = candidates.where(F.size("w") > 2).select("lang", F.explode(F.array(F.expr("slice(w, 1, size(w) - 1)"), F.expr("slice(w, 2, size(w) - 1)"))).alias("w"), "c")
    around = inner.groupBy("lang", "w").agg(F.max("c").alias("around"))
    stay = candidates.hint("merge").join(around, ["lang", "w"], "left").where(F.coalesce(100 * F.col("around") < cover * F.col("c"), F.lit(True))).select("lang", "w", "c")
    cuts = stay.select("lang", "w", F.col("c").alias("a"), F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    part = lambda name, count: phrases.select("lang", F.col("w").alias(name), F.col("c").alias(count))
    cuts = cuts.withColumns({"left": F.expr("slice(w, 1, k)"), "right": F.expr("slice(w, k + 1, size(w) - k)")})
    cuts = cuts.hint("merge").join(part("left", "l"), ["lang", "left"]).hint("merge").join(part("right", "r"), ["lang", "right"])
    cuts = cuts.hint("merge").join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("product", wide("a") * wide("n")).withColumn("parts", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr(f"cast(product * cast({scale} as decimal(10,0)) as decimal(38,0)) div parts"))
    weakest = cuts.groupBy("lang", "w", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    plain = lambda c: F.replace(F.replace(c, F.lit("\x01\x01"), F.lit("\x00")), F.lit("\x01\x02"), F.lit("\x01"))
    rows = weakest.select(plain(F.col("lang")).alias("lang"), plain(F.array_join("w", " ")).alias("phrase"), "a", "m.l", "m.r", "n", "m.score")
    return _ranked(rows, top)


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    rank: Column = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_OP12 = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, w[i : i + k - 1] AS g FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k))),
f AS (SELECT lang, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, g, f FROM f WHERE len(g) > 1),
inner_phrases AS (
  SELECT lang, g[i : i + k - 1] AS g, max(f) AS f FROM (
    SELECT lang, g, f, k, unnest(range(1, len(g) - k + 2)) AS i FROM c, (SELECT unnest(range(2, 5)) AS k) WHERE k < len(g)) GROUP BY ALL),
s AS (SELECT c.* FROM c LEFT JOIN inner_phrases i ON c.lang = i.lang AND c.g = i.g WHERE i.f IS NULL OR 100 * i.f < 100 * c.f),
cuts AS (
  SELECT s.lang, s.g, s.f AS a, s.k, l.f AS l, r.f AS r, n.n, ((1000::HUGEINT * s.f * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT lang, g, f, unnest(range(1, len(g))) AS k FROM s) s
  JOIN f l ON l.lang = s.lang AND l.g = s.g[1 : s.k] JOIN f r ON r.lang = s.lang AND r.g = s.g[s.k + 1 : ] JOIN n ON n.lang = s.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS best FROM cuts),
x AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM b WHERE best = 1),
y AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM x)
SELECT lang, rank, phrase, a, l, r, n, score FROM y WHERE rank <= 2000
"""
