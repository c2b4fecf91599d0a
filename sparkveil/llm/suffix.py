"""Removal of long repeated byte strings by refining buckets of sampled suffixes.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts elsewhere. Instead of one bucket pointer per
byte, which alone would be many times the text, suffixes are sampled at the least q-gram of every window (leftmost on
ties): equal windows choose the same place, so a window has a partner only among the suffixes of its sample's bucket.

1. Initial buckets: samples by a q-gram at the sample that any shared window must contain (one reaching right for
   windows that lie mostly right of the sample, one reaching left for the others). Buckets of one sample are done.
2. Samples that agree on the text of all their windows are repeats; one stands for all of them, and nothing else of
   theirs is looked at. Buckets that still hold a sample without such a partner are refined.
3. Bucket pointers: around each open sample, the blocks on a grid from the sample are put into buckets, first by their
   bytes. A bucket's pointer is the least place in it. Each round refines the buckets by sorting on the pointers of the
   block and of the one just behind it, so the text that a pointer stands for doubles; the new pointers are written
   back, and are what the next round sorts on. Places alone in their bucket leave.
4. A sample's windows are split into parts. Two strings are equal if their pointers at a few later offsets are, and the
   few bytes left at both ends. Parts whose text has a partner end as repeats, parts whose common text has none end as
   unique, and only the others are split again, down to single windows.

Buckets of many samples are never listed: each refinement is a sum per bucket.

Defined cases: null text is empty; rows equal in id and text are two documents and repeat each other; texts shorter
than ``LENGTH`` bytes lose nothing; empty tables give no rows; other columns of the input are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import among, drop_materialized, marked, materialize

LENGTH, QGRAM = 400, 32
#: Widths of the parts of a sample's range, from coarse to a single window.
GRID = (64, 8, 1)
#: Blocks in the text that a final bucket pointer stands for, as a power of two.
DOUBLINGS = 3
#: Bytes of a text that are sampled at once.
CHUNK = 1 << 22

_MIX = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _qgram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q bytes (a power of two) from each place, by doubling."""
    h, step, factor = _MIX[data], 1, np.uint64(0x9E3779B97F4A7C15)
    while step < q:
        h = h[:-step] * factor + h[step:]
        factor = factor * factor
        step *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def samples(raw: bytes, length: int = LENGTH, q: int = QGRAM) -> list[tuple[int, int, int]]:
    """(place, least, most): the sample at ``place`` stands for the windows that start ``least`` to ``most`` before it."""
    out: list[tuple[int, int, int]] = []
    if len(raw) < length:
        return out
    with np.errstate(over="ignore"):
        for at in range(0, len(raw) - length + 1, CHUNK):
            data = np.frombuffer(raw, np.uint8)[at : at + CHUNK + length - 1]
            place = np.arange(len(data) - q + 1, dtype=np.uint64)
            keyed = (_qgram_hashes(data, q) >> np.uint64(24) << np.uint64(24)) | place
            chosen = (_window_min(keyed, length - q + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
            last = np.concatenate((first[1:] - 1, [len(chosen) - 1]))
            where = chosen[first]
            out += zip((where + at).tolist(), (where - last).tolist(), (where - first).tolist(), strict=True)
    return out


def _sampler(length: int, q: int):
    half = (length - q) // 2  # windows that start at most this far before a sample reach far to its right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        short, full = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_intdigest
        sign = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for row, text in enumerate(batch.column(2)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                found = samples(raw, length, q)
                for a, least, most in found:
                    body = full(raw[a - most : a - least + length])
                    right = sign(short(raw[a : a + length - half], 1)) if least <= half else None
                    left = sign(short(raw[a - half - 1 : a + q], 2)) if most > half else None
                    for c, v in zip(cols, (row, a, least, most, right, left, sign(body >> 64), sign(body & (1 << 64) - 1)), strict=True):
                        c.append(v)
                if len(cols[0]) > 50_000:
                    yield _sample_batch(batch, cols)
                    cols = [[] for _ in range(8)]
            yield _sample_batch(batch, cols)

    return run


def _sample_batch(batch: pa.RecordBatch, cols: list[list]) -> pa.RecordBatch:
    rows = pa.array(cols[0], pa.int64())
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))], names=["key", "th", "a", "least", "most", "right", "left", "c1", "c2"])


def _contexts(length: int):
    """Texts with their open samples -> the text of all windows of each sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = (batch.column(2)[i].as_py() or "").encode("utf-8", "surrogatepass")
                found = batch.column(3)[i].as_py()
                n = len(found)
                rows = pa.array([i] * n, pa.int64())
                get = lambda k, kind: pa.array([x[k] for x in found], kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), get("a", pa.int64()), get("least", pa.int32()), get("most", pa.int32()), get("n", pa.int64()), pa.array([raw[x["a"] - x["most"] : x["a"] - x["least"] + length] for x in found], pa.binary())], names=["key", "th", "a", "least", "most", "n", "ctx"])

    return run


def _grid(length: int) -> tuple[list[int], int]:
    """Widths of the parts, and bytes of a block, so that every string that is compared holds a whole pointer's text."""
    widths = [w for w in GRID if 2 * w <= length or w == 1]
    block = 1
    while length - widths[0] + 1 - 2 * (2 * block - 1) >= 2 * block << DOUBLINGS:
        block *= 2
    if length - widths[0] + 1 - 2 * (block - 1) < block << DOUBLINGS:
        raise ValueError(f"windows of {length} bytes are too short to be refined; {3 << DOUBLINGS} will do")
    return widths, block


def _pointers(contexts: DataFrame, block: int) -> DataFrame:
    """(sid, most, ctx) -> (sid, ptr: of each block's number on the grid the pointer of the ``block << DOUBLINGS`` bytes from
    there). Blocks whose text stands at no other place have none."""
    first = F.col("most") % block
    count = F.floor((F.length("ctx") - first) / block).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("ctx"), first + 1 + i * block, F.lit(block)))
    rows = contexts.where(count > 0).select("sid", F.posexplode(cut).alias("i", "x")).withColumn("y", F.lit(0).cast("long"))
    before, state = None, None
    for k in range(DOUBLINGS + 1):
        if k:
            before, step = state, 1 << (k - 1)
            rows = before.select("sid", "ptr", F.explode(F.map_keys("ptr")).alias("i")).select("sid", "i", F.col("ptr")[F.col("i")].alias("x"), F.try_element_at("ptr", F.col("i") + step).alias("y")).where("y is not null")
        buckets = rows.groupBy("x", "y").agg(F.min(F.col("sid") * 256 + F.col("i")).alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
        refined = rows.join(buckets.hint("merge"), ["x", "y"])
        state = materialize(refined.groupBy("sid").agg(F.map_from_entries(F.collect_list(F.struct("i", "b"))).alias("ptr")))
        if before is not None:
            drop_materialized(before)
    return state


def _named(start: Column, end: Column, block: int, ends: bool) -> Column:
    """What stands for the bytes from ``start`` to ``end`` of a context: pointers at later offsets and, with ``ends``, the
    bytes outside their grid. Null if the text stands at no other place."""
    first = F.col("most") % block
    low = F.ceil((start - first) / block).cast("int")
    high = F.floor((end - first) / block).cast("int") - (1 << DOUBLINGS)
    steps = F.array_append(F.sequence(low, high, F.lit(1 << DOUBLINGS)), high)
    ids = F.transform(steps, lambda i: F.try_element_at("ptr", i))
    cut = lambda a, b: F.col("ctx").substr((a + 1).cast("int"), (b - a).cast("int"))
    head, tail = cut(start, first + low * block), cut(first + (high + (1 << DOUBLINGS)) * block, end)
    name = F.struct(ids.alias("ids"), head.alias("head"), tail.alias("tail")) if ends else F.struct(ids.alias("ids"))
    return F.when(F.forall(ids, lambda x: x.isNotNull()), name)


def _refine(open_: DataFrame, length: int) -> DataFrame:
    """Samples with their context (sid, key, th, a, least, most, n, ctx) -> repeats (key, th, start, end) among the samples
    that stand alone (n = 1)."""
    widths, block = _grid(length)
    pointed = materialize(open_.join(_pointers(open_, block).hint("merge"), "sid"))
    repeats: list[DataFrame] = []
    alive: DataFrame | None = None  # (sid, parts: the open parts of the coarser grid, lone: no repeat yet)
    coarser = None
    for width in widths:
        if alive is None:
            base = pointed.withColumn("part", F.explode(F.sequence((F.col("least") / width).cast("int"), (F.col("most") / width).cast("int")))).withColumn("lone", F.col("n") == 1)
        else:
            finer = coarser // width
            base = pointed.join(alive.hint("merge"), "sid").withColumn("p", F.explode("parts"))
            base = base.withColumn("part", F.explode(F.sequence(F.col("p.part") * finer, F.col("p.part") * finer + (finer - 1)))).withColumn("lone", F.col("p.lone"))
        low, high = F.greatest(F.col("least"), F.col("part") * width), F.least(F.col("most"), F.col("part") * width + (width - 1))
        rows = base.withColumn("low", low).withColumn("high", high).where("low <= high")
        whole = _named(F.col("most") - F.col("high"), F.col("most") - F.col("low") + length, block, True)
        # Common to all windows of the part: from its last start to its first end.
        inner = F.greatest(F.lit(0), F.col("most") - F.col("part") * width)
        outer = F.least(F.length("ctx"), F.col("most") - F.col("part") * width - (width - 1) + length)
        shared = _named(inner, outer, block, width == 1)
        named = materialize(rows.select("sid", "key", "th", "a", "n", "low", "high", "part", "lone", whole.alias("whole"), shared.alias("shared")).where("shared is not null"))
        by = ["low", "high", "whole"]
        again = named.where("whole is not null").groupBy(*by).agg(F.sum("n").alias("m")).where("m > 1").select(*by, F.lit(True).alias("again"))
        matched = materialize(named.join(again.hint("merge"), by, "left").withColumn("again", F.coalesce("again", F.lit(False))).drop("whole"))
        repeats.append(matched.where("lone and again").select("key", "th", (F.col("a") - F.col("high")).alias("start"), (F.col("a") - F.col("low") + length).alias("end")))
        if width > 1:
            left = matched.withColumn("lone", F.col("lone") & ~F.col("again"))
            buckets = left.groupBy("part", "shared").agg(F.sum("n").alias("m"), F.max("lone").alias("any")).where("m > 1 and any").select("part", "shared")
            alive = materialize(left.join(buckets.hint("merge"), ["part", "shared"], "left_semi").groupBy("sid").agg(F.collect_set(F.struct("part", "lone")).alias("parts")))
            coarser = width
        drop_materialized(named)
    out = repeats[0]
    for r in repeats[1:]:
        out = out.union(r)
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, q: int = QGRAM) -> DataFrame:
    """(key, th: a hash of the text, text), no nulls in the first two -> (key, th, spans: array of (start, end)), for rows with repeats. Spans may overlap."""
    kind = docs.schema["key"].dataType.simpleString()
    found = materialize(docs.mapInArrow(_sampler(length, q), f"key {kind}, th long, a long, least int, most int, right long, left long, c1 long, c2 long"))
    keyed = found.withColumn("h", F.explode(F.array("right", "left"))).where("h is not null")
    live = materialize(keyed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    # Buckets of one sample that the filter lets through do no harm below.
    classes = among(keyed, live).groupBy(F.col("h").alias("bucket"), "c1", "c2", "least", "most").agg(F.count("*").alias("n"), F.min(F.struct("key", "th", "a")).alias("first"))
    classes = materialize(classes)
    # Samples that agree on all their windows.
    same = ["c1", "c2", "least", "most"]
    again = materialize(classes.where("n > 1").select(*same).distinct())
    spans = among(found.withColumn("h", F.col("c1")), again.select(F.col("c1").alias("h"))).join(again.hint("merge"), same, "left_semi")
    spans = spans.select("key", "th", (F.col("a") - F.col("most")).alias("start"), (F.col("a") - F.col("least") + length).alias("end"))
    spans = materialize(spans.groupBy("key", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    # Buckets with more than one class, one of a single sample: one sample of each class goes on.
    open_ = classes.groupBy("bucket").agg(F.count("*").alias("m"), F.min("n").alias("few")).where("m > 1 and few = 1").select("bucket")
    chosen = classes.join(open_.hint("merge"), "bucket", "left_semi").select("first.*", "least", "most", F.least("n", F.lit(2)).alias("n")).distinct()
    per_doc = materialize(chosen.groupBy("key", "th").agg(F.collect_list(F.struct("a", "least", "most", "n")).alias("found")))
    drop_materialized(found, live, classes)
    texts = among(docs.withColumn("h", F.col("th")), per_doc.select(F.col("th").alias("h"))).drop("h")
    texts = texts.join(per_doc.hint("merge"), ["key", "th"]).select("key", "th", "text", "found").dropDuplicates(["key", "th"])
    contexts = texts.mapInArrow(_contexts(length), f"key {kind}, th long, a long, least int, most int, n long, ctx binary")
    contexts = materialize(contexts.withColumn("sid", F.monotonically_increasing_id()))
    more = _refine(contexts, length).groupBy("key", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return spans.union(more)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sizes, cut, kept = [], [], []
            for text, lists in zip(part.column(2), part.column(3), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                runs: list[list[int]] = []
                for a, b in sorted((x["start"], x["end"]) for some in lists.as_py() or () for x in some):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                ends = [0, *(b for _, b in runs)]
                sizes.append(len(raw))
                cut.append([{"start": a, "end": b} for a, b in runs])
                kept.append(b"".join(raw[e:a] for e, a in zip(ends, [*(a for a, _ in runs), len(raw)], strict=True)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(cut, kind), pa.array(kept, pa.binary())], names=["key", "n_bytes", "removed", "kept"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, q: int = QGRAM) -> DataFrame:
    """One row per document: key, n_bytes, removed (maximal runs of bytes), kept (the bytes that remain)."""
    kind = docs.schema[key].dataType.simpleString()
    # Rows of one id and text share their spans, so a null id may go by any value.
    named = docs.select(F.col(key).alias("given"), F.coalesce(F.col(key), F.lit(0).cast(kind)).alias("key"), F.xxhash64(F.lit(7), F.col(text).cast("string")).alias("th"), F.col(text).cast("string").alias("text"))
    spans = repeated_spans(named.select("key", "th", "text"), length, q).groupBy("key", "th").agg(F.collect_list("spans").alias("lists"))
    spans = materialize(spans)
    # Texts without repeats stay where they are.
    split = marked(named.withColumn("h", F.col("th")), spans.select(F.col("th").alias("h")), "hit").drop("h")
    joined = split.where("hit").join(spans.hint("merge"), ["key", "th"], "left").select("given", "th", "text", "lists")
    joined = joined.union(split.where("not hit").select("given", "th", "text", F.lit(None).alias("lists")))
    return joined.mapInArrow(_remove, f"key {kind}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    """Sizes and a checksum of what was taken out and kept; ``n_kept`` bytes remain, and ``changed`` says whether any went."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return removed.select("key", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.length("kept").cast("long").alias("n_kept"), (F.size("removed") > 0).alias("changed"))


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The same by looking at every window of every text; for small fixtures."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    seen: dict[bytes, int] = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        n = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), n, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out
