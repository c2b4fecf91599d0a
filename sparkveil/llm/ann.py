"""Approximate nearest neighbours by inner product with a hash-prefix forest.

Each tree gives a vector a string of sign bits of random directions; a tree is the sorted array of its strings. A query
descends to the longest prefix it shares with entries of each tree, then all trees ascend together, one bit at a time,
until the entries below the common prefix number ``candidates`` over all trees, or ``SHARE`` for each distinct vector if
that is more, so that the searched part doesn't shrink as a table grows. Of these entries, in each tree, those whose whole
strings (the tree's and those of the next two) differ from the query's in fewest bits are scored exactly: ``SCORED`` of the
distinct vectors over all trees at most (or 8 for each neighbour asked for, in a tree, if that is more). Where the strings
can't tell entries apart, since they lie in a group that is tight as seen from the middle of all, all of them are scored.
The best of all trees are merged. The forest's roots are the prefixes of a few bits, so that an array is cut into shards; a shard
that is much larger than planned is cut again by a hash, and so are a shard's queries. Equal vectors are one entry, with
its least ids. A query whose roots hold fewer entries than it is due is scored against all entries, block by block.

Strings are made of vectors less the mean of all, which changes no order of inner products, and along that mean vectors are
stretched, and queries shortened, to the spread of the other directions, which changes no product: queries that all lie
around the mean then differ in their strings. To serve inner products, vectors get one more component that makes all norms of a band (a factor of the square root of
two) equal, so that a long vector doesn't flatten the labels of the others; a query's is zero.

Defined cases: vectors that are null, empty, all zero, or hold null or non-finite components take no part, nor do rows
without an id; rows with one id are candidates each, but never of a query with that id; only vectors of one length are
compared; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

TREES, BITS = 14, 60
#: Entries over all trees that a query compares at least, for each neighbour asked for.
CANDIDATES = 112
#: Candidates over all trees for each distinct vector, at least: 9 % of the table in a tree.
SHARE = 1.28
#: Part of the distinct vectors that is scored for a query, over all trees, at most.
SCORED = 0.045
#: Bits by which distances to a query's strings vary at least (standard deviation) where strings tell entries apart: of 180
#: bits by chance alone they vary by 6.7.
APART = 5.0
#: Columns of the strings that are compared.
STRINGS = ("label", "more1", "more2")
#: Vectors of a shard that one task handles at once, and its queries.
SHARD, ASKING = 32_768, 8_192


def _valid(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def _planes(dim: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, dim)).standard_normal((trees, BITS, dim + 1))


def _strings(bits: np.ndarray, trees: int) -> np.ndarray:
    """Signs of all directions, a vector a row -> its string in each tree, as an integer."""
    packed = np.packbits(bits.reshape(len(bits), trees, BITS), axis=2)
    return (packed.view(">u8")[:, :, 0] >> np.uint64(64 - BITS)).astype(np.int64)


def _labeller(trees: int, seed: int, roofs: dict[int, float], frames: dict[int, Frame]):
    """Entries -> their label in each tree, as data (with the rest to their band's largest squared norm) and as query."""

    def run(batches):
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(1)])
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                part = batch.take(pa.array(rows))
                x = np.array(part.column(1).to_pylist(), float)
                roof = np.array([roofs[b] for b in part.column(2).to_pylist()])
                y, q = frames[int(dim)].of_data(x), frames[int(dim)].of_query(x)
                rest = np.sqrt(np.maximum(0, roof - (y * y).sum(1)))
                planes = _planes(int(dim), trees, seed).reshape(trees * BITS, -1)
                strings = [_strings(y @ planes[:, :-1].T + rest[:, None] * planes[None, :, -1] > 0, trees), _strings(q @ planes[:, :-1].T > 0, trees)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.repeat(int(dim), len(rows)), pa.int32()), *(pa.array(list(s), pa.list_(pa.int64())) for s in strings)], names=["cid", "dim", "data", "query"])

    return run


def _ranges(labels: np.ndarray, asked: np.ndarray, depth: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Where the entries that share ``depth`` leading bits lie in a sorted array."""
    low = asked >> (BITS - depth) << (BITS - depth)
    return np.searchsorted(labels, low), np.searchsorted(labels, low + (np.int64(1) << (BITS - np.asarray(depth, np.int64))))


def _counter(root: int):
    """Queries of a shard and its sorted labels -> entries at each depth."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        labels, asked = np.sort(left["label"].to_numpy()), right["label"].to_numpy()
        columns = []
        for depth in range(root, BITS + 1):
            a, b = _ranges(labels, asked, depth)
            columns.append(pa.array(b - a, pa.int64()))
        return pa.Table.from_arrays([right["cid"].combine_chunks(), *columns], names=["cid", *(f"d{d}" for d in range(root, BITS + 1))])

    return run


def _searcher(best: int, scored: int):
    """Entries of a shard and its queries with their depth -> the best candidates of each, of the ``scored`` whose strings
    are nearest."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            labels = left["label"].to_numpy()
            order = np.argsort(labels, kind="stable")
            flat = lambda t: np.stack(t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)).astype(float)
            x, q = flat(left)[order], flat(right)
            cids, least, qids = left["cid"].to_numpy(zero_copy_only=False)[order], left["least"].to_numpy()[order], right["cid"].to_pylist()
            low, high = _ranges(labels[order], right["label"].to_numpy(), right["depth"].to_numpy())
            strings = lambda t: [t[c].to_numpy() for c in STRINGS]
            mine, asked = [c[order] for c in strings(left)], strings(right)
            whole = right["tree"].to_numpy() < 0
            for k, qid in enumerate(qids):
                a, b = int(low[k]), int(high[k])
                if a == b:
                    continue
                near = np.arange(a, b)
                if b - a > scored and not whole[k]:
                    apart = sum(np.bitwise_count(m[a:b] ^ q_[k]) for m, q_ in zip(mine, asked, strict=True))
                    if apart.std() >= APART:
                        near = a + np.argpartition(apart, scored - 1)[:scored]
                scores = x[near] @ q[k]
                top = np.arange(len(near))
                if len(near) > best:
                    edge = np.partition(scores, len(near) - best)[len(near) - best]
                    top = np.flatnonzero(scores >= edge)
                top = top[np.lexsort((least[near][top], -scores[top]))][:best]
                out[0] += [qid] * len(top)
                out[1] += cids[near][top].tolist()
                out[2] += scores[top].tolist()
        return pa.Table.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["qid", "cid", "score"])

    return run


def _sums(batches):
    """Vectors -> (dim, k, s, n): the sum of each component by vector length."""
    sums: dict[int, tuple[np.ndarray, int]] = {}
    for batch in batches:
        sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes).tolist():
            x = batch.column(0).filter(pa.array(sizes == dim)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            s, n = sums.get(dim, (0.0, 0))
            sums[dim] = (s + x.sum(0), n + len(x))
    for dim, (s, n) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(s), pa.array(np.full(dim, n, np.int64))], names=["dim", "k", "s", "n"])


def means_of(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Vector length -> mean, zero where it is beyond numbers; ``vectors`` has one column, of arrays."""
    out: dict[int, list] = {}
    for r in vectors.mapInArrow(_sums, "dim int, k int, s double, n long").groupBy("dim", "k").agg((F.sum("s") / F.sum("n")).alias("m")).orderBy("dim", "k").collect():
        out.setdefault(r["dim"], []).append(r["m"])
    return {dim: np.nan_to_num(np.array(m), nan=0.0, posinf=0.0, neginf=0.0) for dim, m in out.items()}


@dataclass
class Frame:
    """The mean of vectors of one length, its direction, and by how much vectors are stretched along it."""

    mean: np.ndarray
    along: np.ndarray
    stretch: float = 1.0

    def of_data(self, x: np.ndarray) -> np.ndarray:
        y = x - self.mean
        return y + (self.stretch - 1) * np.outer(y @ self.along, self.along)

    def of_query(self, x: np.ndarray) -> np.ndarray:
        return x + (1 / self.stretch - 1) * np.outer(x @ self.along, self.along)

    def norm2(self, v: Column) -> Column:
        """Of a vector's ``of_data``."""
        y = F.zip_with(v, F.array(*map(F.lit, self.mean.tolist())), lambda x, c: x - c)
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        side = total(F.zip_with(y, F.array(*map(F.lit, self.along.tolist())), lambda x, c: x * c))
        return total(F.transform(y, lambda x: x * x)) + (self.stretch**2 - 1) * side * side


def frames_of(vectors: DataFrame) -> dict[int, Frame]:
    """By vector length; ``vectors`` has one column, of arrays."""
    out = {}
    for dim, mean in means_of(vectors).items():
        size = float(np.sqrt((mean * mean).sum()))
        out[dim] = Frame(mean, mean / size if 0 < size < np.inf else np.zeros(dim))
    # By quartiles, which few vectors far off don't move.
    quarter = F.percentile_approx("side", F.array(*map(F.lit, (0.25, 0.5, 0.75))), 1000).alias("side")
    for r in vectors.mapInArrow(_spreads(out), "dim int, side double, rest double").groupBy("dim").agg(quarter, F.percentile_approx("rest", 0.5, 1000).alias("rest")).collect():
        low, middle, high = r["side"]
        if np.isfinite(middle) and low < high and 0 < r["rest"] < np.inf:
            frame = out[r["dim"]]
            frame.mean = frame.mean + middle * frame.along
            frame.stretch = float(np.clip(np.sqrt(r["rest"]) * 1.349 / (high - low), 1e-3, 1e3))  # of a normal spread
    return out


def _spreads(frames: dict[int, Frame]):
    """Vectors -> (dim, side, rest): the component along the mean, and the mean square of the other directions."""

    def run(batches):
        for batch in batches:
            sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                y = batch.column(0).filter(pa.array(sizes == dim)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) - frames[dim].mean
                side = y @ frames[dim].along
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), dim, np.int32)), pa.array(side), pa.array(((y * y).sum(1) - side**2) / max(1, dim - 1))], names=["dim", "side", "rest"])

    return run


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", trees: int = TREES, candidates: int | None = None, scored: float = SCORED, seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query row's ``k`` nearest other rows."""
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), is_query.alias("asks"), F.col(vector).cast("array<double>").alias("v")).where(_valid(F.col("v")))
    rows = rows.withColumn("cid", F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "v"))))
    rows = materialize(rows)
    # Distinct vectors, with the ids that a result could name: k, and one for the query itself.
    ranked = rows.select("cid", "id", F.row_number().over(W.partitionBy("cid").orderBy("id")).alias("r")).where(F.col("r") <= k + 1)
    members = ranked.groupBy("cid").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = rows.groupBy("cid").agg(F.first("v").alias("v"), F.max("asks").alias("asks"))
    entries = materialize(entries.join(members, "cid").withColumn("least", F.col("ids")[0]))
    frames = frames_of(entries.select("v"))
    entries = entries.withColumn("norm2", F.coalesce(*[F.when(F.size("v") == d, f.norm2(F.col("v"))) for d, f in frames.items()], F.lit(0.0)))
    entries = materialize(entries.withColumn("band", F.coalesce(F.floor(F.log2("norm2")), F.lit(-(1 << 11))).cast("int")))
    bands = entries.groupBy("band").agg(F.count("*").alias("n"), F.max("norm2").alias("roof")).collect()  # some 2,000 at most
    n, roofs = sum(b["n"] for b in bands), {b["band"]: b["roof"] for b in bands}
    # A tree holds an entry once, so trees * (k + 1) candidates are k and the query itself at least.
    candidates = max(CANDIDATES * (k + 1) if candidates is None else candidates, math.ceil(SHARE * n), trees * (k + 1))
    root = max(0, min(BITS - 1, int(math.log2(max(1, trees * n / candidates))) - 1))

    per_tree = max(8 * (k + 1), math.ceil(scored * n / trees))

    labelled = entries.select("cid", "v", "band").mapInArrow(_labeller(trees, seed, roofs, frames), "cid string, dim int, data array<long>, query array<long>")
    after = lambda c, n: F.concat(F.slice(c, n % trees + 1, trees), F.slice(c, 1, n % trees)).alias(f"{c}{n}")
    zipped = F.posexplode(F.arrays_zip("data", "query", *(after(c, n) for c in ("data", "query") for n in (1, 2)))).alias("tree", "l")
    labels = materialize(labelled.select("cid", "dim", zipped).select("cid", "dim", "tree", "l.*"))
    shard = lambda c: F.shiftright(c, BITS - root).cast("int")
    where = ["dim", "tree", "shard"]
    asks = entries.where("asks").select("cid")
    data = labels.select("cid", "dim", "tree", F.col("data").alias("label"), F.col("data1").alias("more1"), F.col("data2").alias("more2"), shard("data").alias("shard"))
    query = labels.join(asks, "cid", "left_semi").select("cid", "dim", "tree", F.col("query").alias("label"), F.col("query1").alias("more1"), F.col("query2").alias("more2"), shard("query").alias("shard"))
    # A task sees one cut of a shard's entries and one part of its queries.
    parts_of = lambda df, most, name: df.groupBy(*where).agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    sizes = materialize(parts_of(data, SHARD, "cuts").join(parts_of(query, ASKING, "parts"), where))
    each, one = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)), lambda c: F.pmod(F.xxhash64("cid"), c).cast("int")
    data = data.join(sizes, where).withColumn("cut", one("cuts")).withColumn("part", each("parts"))
    query = query.join(sizes, where).withColumn("cut", each("cuts")).withColumn("part", one("parts"))
    at = [*where, "cut", "part"]
    query, data = materialize(query.drop("cuts", "parts")), materialize(data.drop("cuts", "parts"))
    depths = [f"d{d}" for d in range(root, BITS + 1)]
    counted = data.groupBy(*at).cogroup(query.groupBy(*at)).applyInArrow(_counter(root), "cid string, " + ", ".join(f"{d} long" for d in depths))
    summed = counted.groupBy("cid").agg(*[F.sum(d).alias(d) for d in depths])
    depth = F.coalesce(*[F.when(F.col(f"d{d}") >= candidates, F.lit(d)) for d in range(BITS, root, -1)], F.lit(root))
    # Queries whose roots hold too few, or nothing at all, are scored against all entries.
    due = F.col(f"d{root}") >= candidates
    depth = materialize(summed.where(due).select("cid", depth.alias("depth")))
    short = materialize(entries.where("asks").join(depth, "cid", "left_anti").select("cid", F.size("v").alias("dim"), "v"))
    n_short = short.count()

    asked = query.join(depth, "cid").join(entries.select("cid", "v"), "cid")
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # names of its own beside ``held``
    held = data.join(entries.select("cid", "v", "least"), "cid")
    if n_short:
        # A grid of blocks of entries and parts of queries; at depth 0 a range is the whole block.
        blocks, parts = -(-n // SHARD), -(-n_short // SHARD)
        every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        mine = lambda count: F.pmod(F.xxhash64("cid"), F.lit(count)).cast("int")
        zero = F.lit(0).cast("int")
        none = F.lit(0).cast("long")
        whole = entries.select("cid", F.size("v").alias("dim"), F.lit(-1).alias("tree"), *(none.alias(c) for c in STRINGS), every(parts).alias("shard"), mine(blocks).alias("cut"), zero.alias("part"), "v", "least")
        rest = short.select("cid", "dim", F.lit(-1).alias("tree"), *(none.alias(c) for c in STRINGS), mine(parts).alias("shard"), every(blocks).alias("cut"), zero.alias("part"), zero.alias("depth"), "v")
        held = held.select(*whole.columns).unionByName(whole)
        asked = asked.select(*rest.columns).unionByName(rest)
    found = held.groupBy(*at).cogroup(asked.groupBy(*at)).applyInArrow(_searcher(k + 1, per_tree), "qid string, cid string, score double")
    found = found.groupBy("qid", "cid").agg(F.max("score").alias("score")).join(entries.select("cid", "ids", "least"), "cid")
    top = found.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "least"))).where(F.col("r") <= k + 1)
    one = top.select("qid", "score", F.explode("ids").alias("id"))
    one = one.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k + 1)
    lists = materialize(one.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("list")))
    answers = rows.where("asks").select("id", "cid").join(lists, F.col("cid") == F.col("qid"))
    others = F.slice(F.filter("list", lambda x: x["id"] != F.col("id")), 1, k)
    return answers.select(F.col("id").alias("query_id"), F.posexplode(others).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
