import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkveil.llm import ann


def brute(rows, k=20):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in fine:
        if i % 20 == 0:
            scored = sorted((-float(v @ q), j) for j, v in fine if j != i and len(v) == len(q))
            out.setdefault(i, []).append([(j, -s) for s, j in scored[:k]])
    return out


def search(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, cid int")
    got = {}
    for r in ann.neighbours(df, F.col("vec_id") % 20 == 0, **options).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    return got


def floats(a):
    return [float(np.float32(x)) for x in a]


def test_odd_rows_of_a_small_table(spark):
    rng = np.random.default_rng(1)
    rows = [(i, floats(rng.standard_normal(8) * rng.uniform(0.5, 3))) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2000, None), (2020, [0.0] * 8), (2040, [1.0, None] + [0.0] * 6), (2060, [float("nan")] * 8), (2080, [float("inf")] + [0.0] * 7), (2100, []), (None, rows[5][1]), (2120, [1.0, 2.0]), (2121, [2.0, 2.0])]
    got, want = search(spark, rows), brute(rows)
    assert set(got) == set(want)
    for i, (w,) in want.items():
        g, all_ = [got[i][r] for r in sorted(got[i])], dict(brute(rows, 10_000)[i][0])
        assert len({x for x, _ in g} & {x for x, _ in w}) >= 0.9 * len(w) and sorted(got[i]) == list(range(1, len(w) + 1))
        assert g == sorted(g, key=lambda x: (-x[1], x[0])) and np.allclose([s for _, s in g], [all_[x] for x, _ in g])


def test_a_tiny_table_is_searched_whole(spark):
    rng = np.random.default_rng(1)
    rows = [(i, floats(rng.standard_normal(8) * rng.uniform(0.5, 3))) for i in range(120)]
    got, want = search(spark, rows), brute(rows)
    assert all([x for x, _ in w] == [got[i][r][0] for r in sorted(got[i])] for i, (w,) in want.items())


@pytest.mark.parametrize(("n", "centres", "noise"), [(2000, 2, 0.003), (2000, 0, 0.0), (6000, 4, 0.01), (6000, 20, 0.03), (6000, 1, 0.01), (20_000, 4, 0.01)])
def test_recall_where_vectors_are_clustered(spark, n, centres, noise):
    """Unit vectors around few centres, tight and less so, and without any."""
    rng = np.random.default_rng(n + centres)
    x = rng.standard_normal((n, 64)) * (noise if centres else 1)
    if centres:
        c = rng.standard_normal((centres, 64))
        x += (c / np.linalg.norm(c, axis=1, keepdims=True))[rng.integers(0, centres, n)]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame(spark.sparkContext.parallelize([(i, v.tolist()) for i, v in enumerate(x)], 4), "vec_id long, embedding array<float>")
    every = n // 50
    got = {}
    for r in ann.neighbours(df, F.col("vec_id") % every == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits, y = 0, x.astype(float)
    for i in range(0, n, every):
        scores = y @ y[i]
        scores[i] = -2
        hits += len(got[i] & set(np.argsort(-scores)[:20].tolist()))
    print("recall", n, centres, noise, hits / 20 / 50)
    assert hits >= 0.9 * 20 * 50


def test_recall_of_the_forest(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 16))
    rows = [(i, floats(v / np.linalg.norm(v))) for i, v in enumerate(x)]
    got, want = search(spark, rows, candidates=6000), brute(rows)
    hits = sum(len({j for j, _ in w} & {j for j, _ in got[i].values()}) for i, (w,) in want.items())
    assert hits >= 0.9 * 20 * len(want)


def test_recall_where_few_vectors_are_scored(spark):
    """30,000 directions without any structure: at most 14 * 168 of them, 8 %, and of 60,000 4 %, are scored for a query."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((30_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame(spark.sparkContext.parallelize([(i, v.tolist()) for i, v in enumerate(x)], 4), "vec_id long, embedding array<float>")
    got = {}
    for r in ann.neighbours(df, F.col("vec_id") % 600 == 0, scored=0.04).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i in range(0, len(x), 600):
        scores = x @ x[i]
        scores[i] = -2
        hits += len(got[i] & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.9 * 20 * 50


def test_candidates_follow_the_table(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 64))
    rows = [(i, floats(v / np.linalg.norm(v))) for i, v in enumerate(x)]
    got, want = search(spark, rows, candidates=300), brute(rows)
    hits = sum(len({j for j, _ in w} & {j for j, _ in got.get(i, {}).values()}) for i, (w,) in want.items())
    assert hits >= 0.9 * 20 * len(want)


def test_query_away_from_all_shards(spark):
    """All vectors lie around one direction and query 0 points the other way, so that its roots may hold no data."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal(32) + rng.standard_normal((1500, 32)) * 0.01
    x[0] = -x[2]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, floats(v)) for i, v in enumerate(x)]
    got, want = search(spark, rows, candidates=300), brute(rows)
    assert [i for i in want if len(got.get(i, {})) < 20] == []
    hits = sum(len({j for j, _ in w} & {j for j, _ in got[i].values()}) for i, (w,) in want.items())
    assert hits >= 0.9 * 20 * len(want)


def test_no_rows(spark):
    assert search(spark, []) == {}
