"""Hard negatives: rows of another label that score just below an anchor's positives.

Vectors become integers, and a score is their integer inner product. An orthogonal rotation onto the principal axes of all
rows puts most of a product into few leading components. The products of these are summed axis block by axis block; what
is left is at most the product of the two residual norms, plus a slack for rounding. A row is discarded as soon as that
bound shows that it can't be among the best, or can't lie between the limits of a window; the rest is verified with
integer products, so results are exact. Rows and anchors are dealt out as a grid of cuts of them (a stated set of anchors
against all rows); only the best of each cut go on.

Defined cases: rows without an id, a label or a vector, or with a null or non-finite component, take no part; vectors of
different lengths are never compared; rows that share an id are rows of their own, but never partners of an anchor of that
id; an anchor without a positive, or a positive without a negative, gives no row; ties go to the smaller id; an empty table
gives no rows; columns of other names are not read. Scores beyond 64 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_materialized, materialize

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
#: Rows and anchors of a cut, and the cells of a product that a task holds at once.
ROWS, ANCHORS, CELLS = 8192, 8192, 1 << 20


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the products of components, by vector length."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, x in _by_length(batch.column(0)):
            x = x.astype(float)
            sums[dim] = sums.get(dim, 0) + x.T @ x
    for dim, m in sums.items():
        k = np.arange(m.size, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, dim, np.int32)), pa.array(k), pa.array(m.ravel())], names=["dim", "k", "s"])


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        if dim:
            yield dim, column.filter(pa.array(sizes == dim)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Vector length -> principal axes as columns, those of most weight first. ``vectors`` has one column, of arrays."""
    out = {}
    summed = vectors.mapInArrow(_moments, "dim int, k long, s double").groupBy("dim", "k").agg(F.sum("s").alias("s")).orderBy("dim", "k")
    cells: dict[int, list] = {}
    for r in summed.toLocalIterator():
        cells.setdefault(r["dim"], []).append(r["s"])
    for dim, s in cells.items():
        m = np.array(s).reshape(dim, dim)
        top = np.abs(m).max()
        out[dim] = np.linalg.eigh(m / top if 0 < top < np.inf else np.eye(dim))[1][:, ::-1].copy()
    return out


class Rotated:
    """Integer vectors with their rotated components and the norms of what is behind each step."""

    def __init__(self, x: np.ndarray, axes: np.ndarray) -> None:
        dim = x.shape[1]
        self.x, self.z = x, x.astype(float) @ axes
        self.steps = sorted({0, *(dim >> s for s in (3, 2, 1)), dim})
        square = self.z**2
        self.rest = {m: np.sqrt(square[:, m:].sum(1)) * (1 + 1e-9) for m in self.steps}
        self.norm = np.sqrt((x.astype(float) ** 2).sum(1))

    def take(self, at: np.ndarray | slice) -> Rotated:
        out = object.__new__(Rotated)
        out.x, out.z, out.steps, out.norm = self.x[at], self.z[at], self.steps, self.norm[at]
        out.rest = {m: r[at] for m, r in self.rest.items()}
        return out


def survivors(anchors: Rotated, rows: Rotated, of: np.ndarray, fits: np.ndarray, low: np.ndarray, high: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each asker q (its anchor ``of[q]``; ``fits[q, row]``: may be a partner; scores from ``low[q]`` to ``high[q]``):
    pairs (asker, row, score) that hold its ``best`` partners, verified with integer products."""
    dim = rows.x.shape[1]
    if not len(of) or not len(rows.x):
        return (np.zeros(0, np.int64),) * 3
    if float(anchors.norm.max()) * float(rows.norm.max()) >= 2.0**62:
        raise OverflowError("inner products don't fit 64 bits")
    slack = 8 * (dim + 4) ** 2 * np.finfo(float).eps
    alive, at = fits, np.arange(len(rows.x))
    part = np.zeros((len(anchors.x), len(at)))
    for done, m in zip(rows.steps, rows.steps[1:], strict=False):
        part += anchors.z[:, done:m] @ rows.z[at, done:m].T
        room = np.outer(anchors.rest[m], rows.rest[m][at]) + slack * np.outer(anchors.norm, rows.norm[at]) + slack
        up, down = (part + room)[of], (part - room)[of]
        alive = alive & (up >= low[:, None]) & (down <= high[:, None])
        if alive.shape[1] > best:
            sure = np.where(alive & (up <= high[:, None]) & (down >= low[:, None]), down, -np.inf)
            edge = np.partition(sure, -best, axis=1)[:, -best]
            alive &= up >= edge[:, None]
        some = alive.any(0)
        if not some.all():
            at, part, alive = at[some], part[:, some], alive[:, some]
    q, k = np.nonzero(alive)
    score = np.empty(len(q), np.int64)
    for i in range(0, len(q), CELLS):
        s = slice(i, i + CELLS)
        score[s] = np.einsum("ij,ij->i", anchors.x[of[q[s]]], rows.x[at[k[s]]])
    fine = (score >= low[q]) & (score <= high[q])
    return q[fine], at[k[fine]], score[fine]


def _first(asker: np.ndarray, score: np.ndarray, ident: np.ndarray, best: int) -> np.ndarray:
    """Places of each asker's best, ties by the smaller id."""
    order = np.lexsort((ident, -score, asker))
    a = asker[order]
    start = np.concatenate(([0], np.flatnonzero(a[1:] != a[:-1]) + 1)) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    return order[rank < best]


def _table(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
    return t["id"].to_numpy(), t["label"].to_numpy(), x


def _positives(axes: dict[int, np.ndarray], best: int):
    """A cut of rows, a cut of anchors -> each anchor's best rows of its label."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            (ids, labels, x), (aids, alabels, ax) = _table(left), _table(right)
            rids = right["rid"].to_numpy()
            rows, anchors = Rotated(x, axes[x.shape[1]]), Rotated(ax, axes[x.shape[1]])
            for label in np.unique(alabels):
                mine, them = np.flatnonzero(labels == label), np.flatnonzero(alabels == label)
                some = rows.take(mine)
                step = max(1, CELLS // max(1, len(mine)))
                for k in range(0, len(them), step):
                    who = them[k : k + step]
                    low, high = (np.full(len(who), v, np.int64) for v in (-(2**62), 2**62))
                    q, r, s = survivors(anchors.take(who), some, np.arange(len(who)), aids[who][:, None] != ids[mine][None, :], low, high, best)
                    keep = _first(q, s, ids[mine][r], best)
                    for o, v in zip(out, (rids[who][q[keep]], ids[mine][r[keep]], s[keep]), strict=True):
                        o.append(v)
        return pa.Table.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *o])) for o in out], names=["rid", "positive_id", "score"])

    return run


def _negatives(axes: dict[int, np.ndarray], best: int, low: int, high: int):
    """A cut of rows, a cut of anchors with the scores of their positives -> the best rows of other labels in each window."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            (ids, labels, x), (aids, alabels, ax) = _table(left), _table(right)
            rids, scores = right["rid"].to_numpy(), right["scores"].combine_chunks()
            number, flat = scores.value_lengths().to_numpy(zero_copy_only=False), scores.flatten().to_numpy()
            start = np.concatenate(([0], np.cumsum(number)))
            rows, anchors = Rotated(x, axes[x.shape[1]]), Rotated(ax, axes[x.shape[1]])
            step = max(1, CELLS // (len(ids) * int(number.max(initial=1))))
            for k in range(0, len(aids), step):
                who = np.arange(k, min(k + step, len(aids)))
                of, ps = np.repeat(np.arange(len(who)), number[who]), flat[start[k] : start[who[-1] + 1]]
                fits = (alabels[who][:, None] != labels[None, :]) & (aids[who][:, None] != ids[None, :])
                q, r, s = survivors(anchors.take(who), rows, of, fits[of], -(-low * ps // 100), high * ps // 100, best)
                keep = _first(q, s, ids[r], best)
                for o, v in zip(out, (rids[who][of[q[keep]]], ps[q[keep]], ids[r[keep]], s[keep]), strict=True):
                    o.append(v)
        return pa.Table.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *o])) for o in out], names=["rid", "positive_score", "negative_id", "negative_score"])

    return run


def _best(df: DataFrame, by: list[str], score: str, ident: str, best: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), ident))
    return df.withColumn("rank", rank).where(F.col("rank") <= best)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, key: str = "vec_id", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor's ``positives`` best rows
    of its label, the ``negatives`` best rows of another one at ``low`` to ``high`` percent of the positive's score."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & label.isNotNull() & fine)
    whole = F.transform(v, lambda x: F.floor(x * scale).cast("long"))
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), is_anchor.alias("anchor"), whole.alias("x"), F.size(vector).alias("dim"))
    rows = materialize(rows.where("dim > 0"))
    axes = rotations(rows.select("x"))
    n, asked = rows.agg(F.count("*"), F.count_if("anchor")).first()
    cuts, parts = max(1, -(-n // ROWS)), max(1, -(-asked // ANCHORS))
    own = lambda number: F.pmod(F.xxhash64("rid"), F.lit(number)).cast("int")
    every = lambda number: F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    at = ["dim", "cut", "part"]
    grid = rows.select("id", "label", "x", "dim", own(cuts).alias("cut"), every(parts).alias("part"))
    anchors = rows.where("anchor").select(*[F.col(c).alias(c) for c in ("rid", "id", "label", "x", "dim")], own(parts).alias("part"))  # names of its own beside ``grid``
    asking = anchors.withColumn("cut", every(cuts))
    found = grid.groupBy(*at).cogroup(asking.groupBy(*at)).applyInArrow(_positives(axes, positives), "rid long, positive_id long, score long")
    of = materialize(_best(found, ["rid"], "score", "positive_id", positives).select("rid", "positive_id", F.col("score").alias("positive_score")))
    scores = of.groupBy("rid").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))  # five numbers at most
    asking = anchors.hint("merge").join(scores, "rid").withColumn("cut", every(cuts))
    found = grid.groupBy(*at).cogroup(asking.groupBy(*at)).applyInArrow(_negatives(axes, negatives, low, high), "rid long, positive_score long, negative_id long, negative_score long")
    best = _best(found, ["rid", "positive_score"], "negative_score", "negative_id", negatives)
    out = of.hint("merge").join(best, ["rid", "positive_score"]).hint("merge").join(anchors.select("rid", F.col("id").alias("anchor_id")), "rid")
    out = materialize(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
    drop_materialized(rows, of)
    return out


ORACLE_OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS k FROM s WHERE same),
c AS (
  SELECT p.anchor_id, p.other AS positive_id, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) AS rank
  FROM p JOIN s n ON p.k <= 5 AND n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM c WHERE rank <= 10
"""
