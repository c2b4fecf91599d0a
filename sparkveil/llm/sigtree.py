"""Jaccard join of word shingle sets by signature trees.

A signature tree holds sets at its leaves; every node has the OR of its sets' token bitmaps, the range of their sizes and
the most tokens that a bitmap lost to shared bits. Two trees are walked together: a pair of nodes is left out when no set
below the one can share enough tokens with a set below the other, so that few pairs of sets are met.

Trees stand under top nodes, which Spark deals out. The tokens of a set are put into one global order (frequent ones last);
two sets that are similar enough share one of their first ``n - need + 1`` tokens, and their sizes lie in one size class or
in two adjacent ones. A top node is such a token with such a class, and a large one is cut into blocks of which every two
make a tree. Three steps keep the work near the number of sets:

1. Sets that agree in the two first tokens of one of some other orders meet with their whole tokens and are linked, which
   contracts nearly all groups.
2. Trees of bitmaps under all top nodes whose sets aren't linked yet tell which sets have a possible partner; those that
   have one meet again with bitmaps that follow their sizes.
3. These sets meet once more, by pairs or under the same top nodes, with their whole tokens.

Links are exact: a pair is linked when its tokens (64-bit hashes of shingles) say so, and only links that join two
components are looked at. Equal sets are one entry.

Defined cases: a document without words (null, blank) has an empty set and stays alone; rows with equal ids or texts are
kept, each with its row; a null id never names a component unless all ids of it are null; an empty table gives no rows;
other columns are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, drop_materialized, marked, materialize
from .graph import components
from .simhash import _shingles, _words

SHINGLE, PERCENT = 3, 90
#: Bits of a bitmap, sets below a node, members of a block.
BITS, FAN, BLOCK = 2048, 8, 256
#: Possible pairs for each set of a top node up to which each becomes a group of its own.
PAIRS = 4
#: Other orders by which sets meet first.
ORDERS = 4
#: So many of the tokens that most sets have among their first come last in the order: this changes the cost alone.
FREQUENT, FREQUENT_FROM = 65_536, 32


def need(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` shares, at least, with one that is similar enough."""
    return -(-n * percent // 100)


def size_classes(most: int, percent: int) -> np.ndarray:
    """First sizes of the classes: sets that are similar enough lie in one class or in adjacent ones."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out, np.int64)


def token_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    found = _words(text)
    return np.unique(np.frombuffer(_shingles(found, width), ">u8").astype(np.uint64)) if found else np.zeros(0, np.uint64)


def _sets(width: int):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = [token_set(t.as_py(), width) for t in part.column(2)]
                raw = [s.tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(r) if r else None for r in raw], pa.binary()), pa.array(raw, pa.binary())], names=["key", "rid", "n", "h", "set"])

    return run


def bitmap(tokens: np.ndarray, bits: int = BITS) -> np.ndarray:
    seen = np.zeros(bits, bool)
    seen[(tokens >> np.uint64(7)) % np.uint64(bits)] = True
    return np.packbits(seen).view(np.uint64)


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps, whose sizes are powers of two, at the size of the smallest, one a row."""
    words = min(map(len, maps)) // 8
    return np.stack([np.bitwise_or.reduce(np.frombuffer(m, np.uint64).reshape(-1, words), axis=0) for m in maps])


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, n, set) -> (rid, n, sig): bitmaps of at least two bits a token."""
    for batch in batches:
        maps = [bitmap(np.frombuffer(raw.as_buffer(), np.uint64), max(BITS, 1 << (2 * n - 1).bit_length())).tobytes() for raw, n in zip(batch.column(2), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], names=["rid", "n", "sig"])


def _heads(percent: int, frequent: np.ndarray):
    """(rid, n, set) -> the first tokens in the order, the size class, the bitmap, and hashes of the first tokens in other
    orders."""
    odd = np.arange(1, ORDERS + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                heads, maps, meet = [], [], []
                n = part.column(1).to_numpy()
                for raw, size in zip(part.column(2), n, strict=True):
                    tokens = np.frombuffer(raw.as_buffer(), np.uint64)
                    if len(frequent):
                        late = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
                        ordered = np.concatenate((tokens[~late], tokens[late]))
                        early = tokens[~late] if (~late).sum() > 1 else tokens
                    else:
                        ordered = early = tokens
                    with np.errstate(over="ignore"):
                        first = np.sort(np.partition(early[None, :] * odd, min(1, len(early) - 1), axis=1)[:, :2], axis=1)
                        meet.append((first[:, 0] * odd[0] ^ first[:, -1]).view(np.int64))
                    heads.append(ordered[: size - need(int(size), percent) + 1].view(np.int64))
                    maps.append(bitmap(tokens).tobytes())
                steps = size_classes(int(n.max(initial=1)), percent)
                band = np.searchsorted(steps, n, side="right") - 1
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(heads, pa.list_(pa.int64())), pa.array(band.astype(np.int32)), pa.array(maps, pa.binary()), pa.array(meet, pa.list_(pa.int64()))], names=["rid", "n", "head", "band", "sig", "meet"])

    return run


class Tree:
    """Sets (bitmaps, sizes, component so far, whether at home here) in the order of component and size."""

    def __init__(self, sig: np.ndarray, n: np.ndarray, root: np.ndarray, home: np.ndarray) -> None:
        self.order = np.lexsort((n, root))
        sig, n, root, home = (x[self.order] for x in (sig, n, root, home))
        lost = n - np.bitwise_count(sig).sum(1, dtype=np.int64)
        self.levels = [(sig, n, n, lost, root, root, home)]
        while len(self.levels[-1][1]) > 1:
            at = np.arange(0, len(self.levels[-1][1]), FAN)
            how = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum, np.logical_or)
            self.levels.append(tuple(f.reduceat(x, at) for f, x in zip(how, self.levels[-1], strict=True)))

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (of places in the input) that may be similar enough and are of different components."""
        x = y = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            x, y = self._possible(self.levels[depth], x, y, percent, depth == 0)
            if depth == 0 or not len(x):
                break
            below = len(self.levels[depth - 1][1])
            i, j = (k.ravel() for k in np.meshgrid(np.arange(FAN), np.arange(FAN)))
            x, y = (x[:, None] * FAN + i).ravel(), (y[:, None] * FAN + j).ravel()
            fine = (x < below) & (y < below) & (x <= y)
            x, y = x[fine], y[fine]
        return self.order[x], self.order[y]

    @staticmethod
    def _possible(level: tuple, x: np.ndarray, y: np.ndarray, percent: int, leaf: bool) -> tuple[np.ndarray, np.ndarray]:
        sig, low, high, lost, first, last, home = level
        fine = (home[x] | home[y]) & ~((first[x] == last[x]) & (first[x] == first[y]) & (first[y] == last[y]))
        fine &= (percent * low[x] <= 100 * high[y]) & (percent * low[y] <= 100 * high[x])
        if leaf:
            fine &= x < y
        x, y = x[fine], y[fine]
        shared = np.empty(len(x), np.int64)
        for at in range(0, len(x), 65_536):
            s = slice(at, at + 65_536)
            shared[s] = np.bitwise_count(sig[x[s]] & sig[y[s]]).sum(1)
        # Of a set's tokens at most those are in the other one whose bits are, and those that share a bit with another token.
        most = np.minimum(np.minimum(lost[x], lost[y]) + shared, np.minimum(high[x], high[y]))
        fine = (100 + percent) * most >= percent * (low[x] + low[y])
        return x[fine], y[fine]


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column, one table for each value of it."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(0).to_numpy()
        if rest and rest[-1].column(0)[-1].as_py() != g[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        cuts = np.flatnonzero(g[1:] != g[:-1]) + 1
        at = 0
        for cut in cuts.tolist():
            yield pa.Table.from_batches([*rest, batch.slice(at, cut - at)])
            rest, at = [], cut
        rest.append(batch.slice(at))
    if rest:
        yield pa.Table.from_batches(rest)


def _possible_members(percent: int):
    """(g, rid, n, root, home, sig), sorted by g -> (g, rid) of sets with a possible partner: a group for each pair, or
    for all of the top node's sets that have one if there are more than ``PAIRS`` pairs for each set. Groups of the same
    sets under several top nodes have one name."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list] = ([], [])
        for t in _by_group(batches):
            if t.num_rows < 2:
                continue
            rid, n, root = (t[c].to_numpy() for c in ("rid", "n", "root"))
            x, y = Tree(folded(t["sig"].to_pylist()), n, root, t["home"].to_numpy(zero_copy_only=False).astype(bool)).pairs(percent)
            if 0 < len(x) <= PAIRS * len(n):
                a, b = np.minimum(rid[x], rid[y]), np.maximum(rid[x], rid[y])
                with np.errstate(over="ignore"):
                    pair = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
                out[0].append(np.tile((pair ^ (pair >> np.uint64(31))).view(np.int64), 2))
                out[1].append(np.concatenate((a, b)))
            elif len(x):
                found = np.unique(np.concatenate((rid[x], rid[y])))
                out[0].append(np.full(len(found), np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64)))
                out[1].append(found)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0])), pa.array(np.concatenate(out[1]))], names=["g", "rid"])

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _links(percent: int):
    """(g, rid, root, set), sorted by g -> links (a, b) that join the components of each group: fewer than it has sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for t in _by_group(batches):
            if t.num_rows < 2:
                continue
            rid, root = t["rid"].to_numpy(), t["root"].to_numpy()
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in t["set"]]
            of: dict[int, int] = {}

            def top(k: int, of: dict[int, int] = of) -> int:
                while (up := of.get(k, k)) != k:
                    of[k] = of.get(up, up)
                    k = up
                return k

            n = np.fromiter(map(len, sets), np.int64, len(sets))
            for x, y in zip(*(k.tolist() for k in Tree(np.stack([bitmap(s) for s in sets]), n, root, np.ones(len(n), bool)).pairs(percent)), strict=True):
                a, b = top(int(root[x])), top(int(root[y]))
                if a != b and similar(sets[x], sets[y], percent):
                    of[max(a, b)] = min(a, b)
                    found.append((int(rid[x]), int(rid[y])))
            if len(found) > 50_000:
                yield _edges(found)
                found = []
        yield _edges(found)

    return run


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], names=["a", "b"])


def _grouped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` over the rows of each ``g``, as they stream by."""
    return df.repartition(F.col("g")).sortWithinPartitions("g").mapInArrow(run, schema)


def _linked(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Groups (g, rid, root) with their whole sets -> links."""
    wanted = among(sets.withColumn("h", F.col("rid")), members.select(F.col("rid").alias("h"))).select("rid", "set")
    return _grouped(members.hint("merge").join(wanted, "rid").select("g", "rid", "root", "set"), _links(percent), "a long, b long")


def _blocks(sized: DataFrame) -> DataFrame:
    """(g, c, ...): groups of more than a block become one group for each two of their blocks."""
    cuts = F.ceil(F.col("c") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(5), "rid"), cuts).cast("int")
    other = F.explode(F.when(cuts > 1, F.sequence(F.lit(0), cuts - 1)).otherwise(F.array(F.lit(0))))
    at = sized.withColumn("mine", mine).withColumn("other", other)
    both = F.xxhash64("g", F.least("mine", "other"), F.greatest("mine", "other"))
    return at.withColumn("g", F.when(F.col("c") > BLOCK, both).otherwise(F.col("g"))).drop("mine", "other", "c")


def near_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = SHINGLE, frequent_from: int = FREQUENT_FROM) -> DataFrame:
    """One row per document: key, n_shingles, component_id (least key reachable by links)."""
    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("rid"), F.col(text).cast("string").alias("text"))
    rows = materialize(named.mapInArrow(_sets(width), f"key {kind}, rid long, n long, h binary, set binary"))
    # Each distinct set stands once, for its least row.
    once = materialize(rows.where("n > 0").groupBy("h").agg(F.min("rid").alias("rid"), F.min("key").alias("least")))
    sets = rows.where("n > 0").select("rid", "n", "set")
    with_heads = lambda late: sets.mapInArrow(_heads(percent, late), "rid long, n long, head array<long>, band int, sig binary, meet array<long>").hint("merge").join(once.select("rid"), "rid")
    heads = materialize(with_heads(np.zeros(0, np.uint64)))
    counted = heads.select(F.explode("head").alias("t")).groupBy("t").count().where(F.col("count") >= frequent_from)
    late = np.sort(np.array([r["t"] for r in counted.orderBy(F.desc("count"), "t").limit(FREQUENT).collect()], np.int64).view(np.uint64))
    if len(late):
        drop_materialized(heads)
        heads = materialize(with_heads(late))

    # 1: sets that agree in first tokens, in blocks that the least of them joins. Of groups of equal sets one is enough.
    first = heads.select("rid", F.explode("meet").alias("g"))
    hubs = first.groupBy("g").agg(F.count("*").alias("c"), F.min("rid").alias("hub"), F.bit_xor(F.xxhash64("rid")).alias("who")).where("c > 1")
    hubs = hubs.groupBy("c", "hub", "who").agg(F.min("g").alias("g")).drop("who")
    cut = F.pmod(F.xxhash64(F.lit(3), "rid"), F.ceil(F.col("c") / BLOCK)).cast("int")
    hubs = materialize(hubs)
    members = among(first.withColumn("h", F.col("g")), hubs.select(F.col("g").alias("h"))).drop("h").hint("merge").join(hubs, "g").where("rid <> hub").select("g", "rid", cut.alias("cut"))
    every = hubs.select("g", F.col("hub").alias("rid"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("c") / BLOCK).cast("int") - 1)).alias("cut"))
    members = materialize(members.union(every).select(F.xxhash64("g", "cut").alias("g"), "rid", F.col("rid").alias("root")))
    edges = materialize(_linked(members, sets, percent))
    drop_materialized(members, hubs)
    roots = components(edges)
    known = materialize(heads.hint("merge").join(roots.withColumnRenamed("node", "rid"), "rid", "left").select("rid", "n", "head", "band", "sig", F.coalesce("root", "rid").alias("root")))
    drop_materialized(heads)

    # 2: top nodes are a token and a size class; sets of the next class visit. Of top nodes of the same sets one is enough.
    at_home = F.explode(F.array(F.struct(F.col("band").alias("band"), F.lit(True).alias("home")), F.struct((F.col("band") - 1).alias("band"), F.lit(False).alias("home")))).alias("v")
    places = lambda *more: known.select("rid", "root", "head", *more, at_home).select("rid", "root", *more, "v.band", "v.home", F.explode("head").alias("t")).select(F.xxhash64("t", "band").alias("g"), "rid", "root", "home", *more)
    who = F.bit_xor(F.xxhash64("rid", "home")).alias("who")
    tops = places().groupBy("g").agg(F.count("*").alias("c"), F.bool_or("home").alias("home"), F.min("root").alias("low"), F.max("root").alias("high"), who)
    tops = materialize(tops.where("home and low < high").groupBy("c", "low", "high", "who").agg(F.min("g").alias("g")).select("g", "c"))
    standing = marked(places("n", "sig").withColumn("h", F.col("g")), tops.select(F.col("g").alias("h")), "alive").where("alive").drop("h", "alive")
    standing = _blocks(standing.hint("merge").join(tops, "g")).select("g", "rid", "n", "root", "home", "sig")
    rooted = lambda groups: groups.hint("merge").join(known.select("rid", "root"), "rid").select("g", "rid", "root")
    possible = materialize(_grouped(standing, _possible_members(percent), "g long, rid long").distinct())
    # Long texts fill such bitmaps, so what has a partner is looked at again with bitmaps of its own size.
    wide = among(sets.withColumn("h", F.col("rid")), possible.select(F.col("rid").alias("h"))).select("rid", "n", "set").mapInArrow(_wide, "rid long, n long, sig binary")
    again = rooted(possible).hint("merge").join(wide, "rid").select("g", "rid", "n", "root", F.lit(True).alias("home"), "sig")
    narrow, possible = possible, materialize(_grouped(again, _possible_members(percent), "g long, rid long").distinct())

    # 3: sets with a possible partner, by pairs or under the same top nodes.
    edges = materialize(edges.union(_linked(rooted(possible), sets, percent)))
    named = materialize(rows.select("key", "n", "h"))
    drop_materialized(known, tops, narrow, possible, rows)
    roots = components(edges)
    of = materialize(once.hint("merge").join(roots.withColumnRenamed("node", "rid"), "rid", "left").select("h", "least", F.coalesce("root", "rid").alias("root")))
    groups = of.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.hint("merge").join(of.join(groups, "root").select("h", "component_id"), "h", "left")
    return found.select("key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))


ORACLE_OP11 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
d AS (SELECT list_sort(s) AS s, min(doc_id) AS id, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY ALL),
t AS (SELECT id, n, unnest(s) AS t FROM d),
p AS (
  SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.t = b.t AND a.id < b.id AND 90 * a.n <= 100 * b.n AND 90 * b.n <= 100 * a.n
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(id, root) AS (SELECT id, id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a WHERE r.root < e.b),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.root, s.doc_id) AS component_id
FROM s LEFT JOIN d ON list_sort(s.s) = d.s LEFT JOIN c ON c.id = d.id
"""
