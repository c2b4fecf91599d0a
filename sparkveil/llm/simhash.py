"""SimHash near-duplicates with anchor-point covering.

Fingerprints within a few bits of each other are found without comparing all pairs. The anchors are the words of a
covering code: the product of perfect codes (binary Golay, Hamming) over blocks of a fingerprint's bits, so every
fingerprint lies within the covering radius of one anchor, its home. Each fingerprint is replicated to every anchor
within covering radius plus threshold, block by block; two fingerprints that differ in at most the threshold then meet
at the home of one of them, and are compared there.

``near_duplicates`` links fingerprints, exactly. ``near_copies`` links texts by similarity: a long SimHash of five-word
shingles is cut into projections, each with an anchor covering of its own, so that copies of 0.8 meet at some anchor; who
meets is compared by the whole SimHash, then by the exact similarity of the shingle sets. Whether a pair of similarity s
meets is a matter of chance: with the defaults 86 % do at 0.8, 97 % at 0.85, over 99 % at 0.9 and above. Buckets are never
listed as pairs: an entry first meets the least of each of its buckets, then what matches is contracted, and only entries
of different components are compared further.

Defined cases: a null or blank text has fingerprint zero and links like any other; rows with equal ids or texts are
kept; a null id never names a component unless all its ids are null; an empty table gives no rows. Columns of the input
keep their names and values, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, drop_materialized, fresh, materialize
from .graph import components

SHINGLE, THRESHOLD = 3, 2


def _words(text: str | None) -> list[bytes]:
    """Of the bytes, so that only A-Z are lowered and only the six ASCII white-space characters end a word."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _shingles(found: list[bytes], width: int) -> bytes:
    """The XXH64 (seed 42) of each shingle of one word or more, one after another."""
    import xxhash

    joined = b" ".join(found)
    if len(found) <= width:
        return xxhash.xxh64_digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a:b], 42) for a, b in zip(starts[: len(found) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)])


def _majority(rows: np.ndarray) -> np.ndarray:
    """Bytes of hashes, one a row -> the bits that are set in over half of them, as bytes."""
    total = np.zeros(8 * rows.shape[1], np.int64)
    for k in range(0, len(rows), 255):  # sums of bytes, which don't overflow
        total += np.add.reduce(np.unpackbits(rows[k : k + 255], axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(rows))


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    found = _words(text)
    if not found:
        return 0
    return int.from_bytes(_majority(np.frombuffer(_shingles(found, width), np.uint8).reshape(-1, 8)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["key", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) per row; fp is the fingerprint's 64 bits as a signed integer."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_fingerprints, f"key {kind}, fp long")


def _parity_checks(kind: str) -> tuple[int, np.ndarray]:
    """Length of a perfect code, and the syndrome of each of its single-bit errors."""
    if kind == "golay":  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 divides x^23 + 1
        out, rest = [], 1
        for _ in range(23):
            out.append(rest)
            rest <<= 1
            if rest >> 11:
                rest ^= 0b101011100011
        return 23, np.array(out)
    return 15, np.arange(1, 16)  # Hamming


RADIUS = {"golay": 3, "hamming": 1}


@lru_cache
def _near(kind: str, threshold: int) -> tuple[int, np.ndarray, list[list[np.ndarray]]]:
    """Length, syndromes of single bits, and for t to threshold and each syndrome the errors of at most radius + t bits:
    the word xor these errors are the anchors within that distance."""
    n, single = _parity_checks(kind)
    by: list[list[np.ndarray]] = []
    errors = [(0, 0, 0)]
    for weight in range(1, RADIUS[kind] + threshold + 1):
        for bits in combinations(range(n), weight):
            errors.append((weight, int(np.bitwise_xor.reduce(single[list(bits)])), sum(1 << b for b in bits)))
    size = 1 << int(single.max()).bit_length()
    for t in range(threshold + 1):
        lists: list[list[int]] = [[] for _ in range(size)]
        for weight, syndrome, error in errors:
            if weight <= RADIUS[kind] + t:
                lists[syndrome].append(error)
        by.append([np.array(x, np.int64) for x in lists])
    return n, single, by


def _splits(total: int, parts: int) -> Iterator[tuple[int, ...]]:
    if parts == 1:
        yield (total,)
        return
    for first in range(total + 1):
        for rest in _splits(total - first, parts - 1):
            yield (first, *rest)


def anchors(fp: int, code: tuple[str, ...], threshold: int) -> np.ndarray:
    """Anchors of a fingerprint (its unsigned bits) within covering radius plus ``threshold``; 0 gives the home only."""
    words, at = [], 0
    for kind in code:
        n, single, by = _near(kind, threshold)
        bits = fp >> at & (1 << n) - 1
        syndrome = 0
        for k in range(n):
            if bits >> k & 1:
                syndrome ^= int(single[k])
        words.append([(bits ^ by[t][syndrome]) << at for t in range(threshold + 1)])
        at += n
    found = []
    for split in _splits(threshold, len(code)):
        some = words[0][split[0]]
        for w, t in zip(words[1:], split[1:], strict=True):
            some = (some[:, None] | w[t][None, :]).ravel()
        found.append(some)
    return np.unique(np.concatenate(found))


def _replicas(code: tuple[str, ...], threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                prints = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                lists = [anchors(int(x), code, threshold) for x in prints.astype(np.int64).view(np.uint64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), pa.array(np.repeat(prints, [len(x) for x in lists]))], names=["anchor", "fp"])

    return run


def near_pairs(prints: DataFrame, threshold: int = THRESHOLD, code: tuple[str, ...] = ("golay", "golay")) -> DataFrame:
    """Distinct fingerprints (fp) -> pairs (a, b), a < b, that differ in at most ``threshold`` bits. From some 30 million
    fingerprints on, a third block ("hamming") makes buckets smaller; the pairs are the same."""
    home = prints.select("fp").mapInArrow(_replicas(code, 0), "anchor long, fp long").select("anchor", F.col("fp").alias("a"))
    near = prints.select("fp").mapInArrow(_replicas(code, threshold), "anchor long, fp long").select("anchor", F.col("fp").alias("b"))
    within = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    # Spark sizes both sides by the few bytes of ``prints``, but each fingerprint has some 60 replicas: never broadcast.
    return home.hint("merge").join(near, "anchor").where(within).select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: key, fp, fingerprint (hex), component_id (least key reachable)."""
    prints = materialize(fingerprints(docs, key, text))
    distinct = materialize(prints.groupBy("fp").agg(F.min("key").alias("least")))
    pairs = materialize(near_pairs(distinct, threshold))
    roots = components(pairs)
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialize(named)
    drop_materialized(pairs, distinct)
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(groups, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("key", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Words of a shingle, and the least similarity (shared over all shingles), of copies.
COPY_SHINGLE, SIMILARITY = 5, 0.8
#: Anchor coverings, each over two Golay blocks of bits of its own.
PROJECTIONS = 24
_BLOCK, _ROOM = 23, 1
#: Words of 64 bits in a long SimHash: one that is compared first, then the blocks.
_LONG = 1 + -(-2 * _BLOCK * PROJECTIONS // 64)


def _bits_apart(similarity: float, spread: float, bits: int) -> int:
    """Bits in which SimHashes of so similar shingle sets may differ, ``spread`` standard deviations above the mean."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return round(p * bits + spread * (p * (1 - p) * bits) ** 0.5)


def long_simhash(text: str | None, width: int = COPY_SHINGLE) -> tuple[int, np.ndarray]:
    """A hash of the words, and ``_LONG`` words of SimHash bits, of which the first is ``fingerprint``."""
    import xxhash

    found = _words(text)
    name = xxhash.xxh3_64_intdigest(b" ".join(found))
    if not found:
        return name, np.zeros(_LONG, np.uint64)
    h = np.frombuffer(_shingles(found, width), ">u8").astype(np.uint64)
    total = np.zeros(64 * _LONG, np.int64)
    with np.errstate(over="ignore"):
        step = np.arange(_LONG, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(0, len(h), 255):
            x = h[k : k + 255, None] + step[None, :]
            x[:, 1:] ^= x[:, 1:] >> np.uint64(30)
            x[:, 1:] *= np.uint64(0xBF58476D1CE4E5B9)
            x[:, 1:] ^= x[:, 1:] >> np.uint64(27)
            x[:, 1:] *= np.uint64(0x94D049BB133111EB)
            x[:, 1:] ^= x[:, 1:] >> np.uint64(31)
            total += np.add.reduce(np.unpackbits(x.astype(">u8").view(np.uint8).reshape(len(x), -1), axis=1), axis=0, dtype=np.uint8)
    return name, np.packbits(2 * total > len(h)).view(">u8").astype(np.uint64)


def _long_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [long_simhash(t.as_py()) for t in batch.column(3)]
        names = np.fromiter((x[0] for x in found), np.uint64, len(found)).view(np.int64)
        bits = np.concatenate([x[1] for x in found] or [np.zeros(0, np.uint64)]).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * _LONG), pa.array(bits))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(names), lists], names=["key", "r1", "r2", "h", "sig"])


@lru_cache
def _golay(room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of all words of a block; and by syndrome, the error to the home, the place and number of the errors to
    the anchors within covering radius plus ``room`` in a list, and that list."""
    n, single, by = _near("golay", room)
    syndrome = np.zeros(1 << n, np.int16)
    for b in range(n):
        syndrome[1 << b : 1 << b + 1] = syndrome[: 1 << b] ^ single[b]
    home = np.array([x[0] for x in by[0]])
    return syndrome, home, np.array([len(x) for x in by[room]]), np.concatenate(by[room])


def _blocks(sig: np.ndarray) -> np.ndarray:
    """Long SimHashes, one a row -> their blocks (row, projection, 2), as integers."""
    bits = np.unpackbits(sig.astype(">u8").view(np.uint8).reshape(len(sig), -1), axis=1)[:, 64 : 64 + 2 * _BLOCK * PROJECTIONS]
    return bits.reshape(len(sig), PROJECTIONS, 2, _BLOCK) @ (1 << np.arange(_BLOCK))


def _projected(room: int):
    """Entries (h, sig) -> (anchor, h, own): each projection's anchors within radius plus ``room`` of an entry, split
    between the two blocks; own is its home. Without room only the home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        syndrome, home, counts, errors = _golay(_ROOM)
        offsets = np.concatenate(([0], np.cumsum(counts)[:-1]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                names = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                x = _blocks(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, _LONG))
                s = syndrome[x]
                homes = (x ^ home[s]) >> 11  # the upper 12 bits are the word's information, and name it
                base = np.broadcast_to(np.arange(PROJECTIONS)[None, :] << 24, homes.shape[:2])
                anchor, who, own = [(base | homes[:, :, 0] << 12 | homes[:, :, 1]).ravel()], [np.repeat(names, PROJECTIONS)], [np.ones(base.size, bool)]
                for k in (0, 1) if room else ():
                    n = counts[s[:, :, k]].ravel()
                    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    word = (np.repeat(x[:, :, k].ravel(), n) ^ errors[np.repeat(offsets[s[:, :, k]].ravel(), n) + inside]) >> 11
                    other = np.repeat(homes[:, :, 1 - k].ravel(), n)
                    mine = word == np.repeat(homes[:, :, k].ravel(), n)
                    found = np.repeat(base.ravel(), n) | (word << 12 | other if k == 0 else other << 12 | word)
                    anchor.append(found[~mine])
                    who.append(np.repeat(np.repeat(names, PROJECTIONS), n)[~mine])
                    own.append(np.zeros(len(anchor[-1]), bool))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchor).astype(np.int32)), pa.array(np.concatenate(who)), pa.array(np.concatenate(own))], names=["anchor", "h", "own"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [np.unique(np.frombuffer(_shingles(w, COPY_SHINGLE), np.uint64)).tobytes() if (w := _words(t.as_py())) else b"" for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["h", "set"])


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= least * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Documents (key, r1, r2: hashes that tell rows apart, text) -> one row per distinct sequence of words: h (its hash),
    least (struct of key, r1, r2: the first row that has it), root (the least h of its component of copies)."""
    kind = docs.schema["key"].dataType.simpleString()
    prints = materialize(docs.select("key", "r1", "r2", "text").mapInArrow(_long_prints, f"key {kind}, r1 long, r2 long, h long, sig array<long>"))
    nodes = materialize(prints.groupBy("h").agg(F.min(F.struct("key", "r1", "r2")).alias("least"), F.first("sig").alias("sig")))
    drop_materialized(prints)
    place = lambda room: nodes.select("h", "sig").mapInArrow(_projected(room), "anchor int, h long, own boolean")
    hubs = place(0).groupBy("anchor").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    met = hubs.hint("merge").join(place(_ROOM), "anchor").where("low <> h or high <> h")
    met = materialize(met.select("anchor", "h", "low", "own", (F.col("low") < F.col("high")).alias("many")))
    apart = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, d: n + d)
    far = [_bits_apart(similarity, *x) for x in ((3.0, 64), (2.5, 64 + 2 * _BLOCK * PROJECTIONS))]
    alike = lambda x, y: (F.bit_count(x[0].bitwiseXOR(y[0])) <= far[0]) & (apart(x, y) <= far[1])
    sigs = lambda name, out: nodes.select(F.col("h").alias(name), F.col("sig").alias(out))

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) that are as similar."""
        wanted = nodes.hint("merge").join(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "h").select("h", "least.r1", "least.r2")
        texts = among(docs.select("r1", "r2", F.col("r1").alias("h"), "text"), wanted.select(F.col("r1").alias("h"))).drop("h").hint("merge").join(wanted, ["r1", "r2"])
        sets = materialize(texts.select("h", "text").dropDuplicates(["h"]).mapInArrow(_sets, "h long, set binary"))
        side = lambda name, out: sets.select(F.col("h").alias(name), F.col("set").alias(out))
        both = pairs.hint("merge").join(side("a", "set_a"), "a").hint("merge").join(side("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
        out = materialize(both.mapInArrow(_similar(similarity), "a long, b long"))
        drop_materialized(sets)
        return out

    def across(pairs: DataFrame, edges: DataFrame) -> DataFrame:
        """Pairs whose ends lie in different components so far."""
        roots = materialize(components(edges))
        root = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
        joined = pairs.hint("merge").join(root("a"), "a", "left").hint("merge").join(root("b"), "b", "left")
        return joined.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")

    # Each entry with the nearest of the hubs it meets, then with the others, then all entries of a bucket.
    pairs = met.where("low <> h").select(F.least("low", "h").alias("a"), F.greatest("low", "h").alias("b")).distinct()
    pairs = pairs.hint("merge").join(sigs("a", "x"), "a").hint("merge").join(sigs("b", "y"), "b").where(alike(F.col("x"), F.col("y")))
    pairs = materialize(pairs.select("a", "b", apart(F.col("x"), F.col("y")).alias("d")))
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    nearest = both.groupBy("a").agg(F.min(F.struct("d", "b")).alias("n")).select(F.least("a", "n.b").alias("a"), F.greatest("a", "n.b").alias("b")).distinct()
    edges = verified(materialize(nearest))
    edges = edges.union(verified(materialize(across(pairs.select("a", "b"), edges))))
    roots = materialize(components(edges))
    rows = met.where("many").select("anchor", "h", "own").distinct().hint("merge").join(nodes.select("h", "sig"), "h")
    rows = materialize(rows.hint("merge").join(roots, rows["h"] == roots["node"], "left").select("anchor", "h", "own", "sig", F.coalesce("root", "h").alias("root")))
    a = rows.where("own").select("anchor", F.col("h").alias("a"), F.col("sig").alias("x"), F.col("root").alias("root_a"))
    b = rows.select("anchor", F.col("h").alias("b"), F.col("sig").alias("y"), F.col("root").alias("root_b"))
    rest = a.hint("merge").join(b, "anchor").where((F.col("root_a") != F.col("root_b")) & alike(F.col("x"), F.col("y")))
    rest = materialize(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    edges = materialize(edges.union(verified(rest)))
    drop_materialized(met, rows, pairs, rest)
    roots = components(edges)
    named = nodes.hint("merge").join(roots, nodes["h"] == roots["node"], "left")
    return named.select("h", "least", F.coalesce("root", "h").alias("root"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of copies, that with the least key. Rows are told apart by key and text, so rows
    of one key, or of none, and different texts are documents of their own; of rows equal in both, one stays."""
    r1, r2 = fresh(docs, "sv_r1", "sv_r2")
    name = lambda seed: F.xxhash64(F.lit(seed), docs[key].isNull(), docs[key], docs[text].isNull(), docs[text])
    rows = docs.withColumns({r1: name(1), r2: name(2)})
    found = near_copies(rows.select(F.col(key).alias("key"), F.col(r1).alias("r1"), F.col(r2).alias("r2"), F.col(text).cast("string").alias("text")), similarity)
    kept = materialize(found.groupBy("root").agg(F.min("least").alias("l")).select(F.col("l.r1").alias(r1), F.col("l.r2").alias(r2)))
    return rows.join(kept.hint("merge"), [r1, r2], "left_semi").dropDuplicates([r1, r2]).select(*docs.columns)
