import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkveil.llm import negatives, registry


def plain(rows, every=10, positives=5, best=10):
    good = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, alab, av in good:
        if a % every:
            continue
        s = [(-sum(p * q for p, q in zip(av, v, strict=True)), i, lab) for i, lab, v in good if i != a and len(v) == len(av)]
        for ps, p, _ in sorted(x for x in s if x[2] == alab)[:positives]:
            fits = sorted(x for x in s if x[2] != alab and 30 * -ps <= 100 * -x[0] <= 90 * -ps)[:best]
            out += [(a, p, r, n, -ps, -ns) for r, (ns, n, _) in enumerate(fits, 1)]
    return sorted(out)


def check(spark, rows, every=10):
    df = spark.createDataFrame([(*r, "z", 1.5) for r in rows], "vec_id long, label int, embedding array<double>, rid string, x double")
    got = negatives.hard_negatives(df.repartition(3), F.col("vec_id") % every == 0, F.col("label"))
    got = sorted(map(tuple, got.collect()))
    assert got == plain(rows, every)
    return got


@pytest.mark.parametrize("kind", ["isotropic", "few axes", "ties", "long"])
def test_equals_all_products(spark, monkeypatch, kind):
    monkeypatch.setattr(negatives, "ROWS", 70)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "CELLS", 500)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 24))
    if kind == "few axes":
        x = x[:, :3] @ rng.standard_normal((3, 24)) + 0.05 * x + 1
    if kind == "ties":
        x = np.round(x[:, :2])
    if kind == "long":
        x[::9] *= 1e5
    rows = [(k, int(rng.integers(0, 3)), v.tolist()) for k, v in enumerate(x)]
    assert len(check(spark, rows)) > 100


def test_defined_cases(spark):
    rng = random.Random(2)
    v = lambda: [rng.random() for _ in range(4)]
    rows = [(k, k % 2, v()) for k in range(40)]
    rows += [(50, None, v()), (60, 1, None), (70, 1, [1.0, None, 1.0, 1.0]), (80, 1, [1.0, math.nan, 1.0, 1.0]), (90, 1, [math.inf] * 4), (None, 1, v()), (100, 1, []), (110, 1, [1.0, 2.0]), (111, 1, [1.0, 2.0]), (112, 0, [0.5, 1.0]), (120, 7, v()), (130, 1, [0.0] * 4), (10, 0, v()), (3, 1, rows[3][2])]
    check(spark, rows)
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<double>")
    assert negatives.hard_negatives(empty, F.col("vec_id") % 10 == 0, F.col("label")).count() == 0


def test_leading_components_discard_most():
    rng = np.random.default_rng(8)
    x = np.floor(256 * (rng.standard_normal((4000, 4)) @ rng.standard_normal((4, 64)) + 0.01 * rng.standard_normal((4000, 64)))).astype(np.int64)
    axes = np.linalg.eigh(x.T.astype(float) @ x)[1][:, ::-1]
    rows, some = negatives.Rotated(x, axes), negatives.Rotated(x[:20], axes)
    low, high = (np.full(20, k, np.int64) for k in (-(2**62), 2**62))
    q, r, s = negatives.survivors(some, rows, np.arange(20), np.ones((20, 4000), bool), low, high, 5)
    exact = x[:20] @ x.T
    for k in range(20):
        assert set(np.sort(exact[k])[-5:]) <= set(s[q == k])
    assert len(q) < 0.02 * 20 * 4000


def test_query_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.execute(negatives.ORACLE_OP13).fetchall()
    assert sorted(map(tuple, registry.QUERIES["op13_pca_negatives"](spark, sf).collect())) == sorted(want) and len(want) > 50
