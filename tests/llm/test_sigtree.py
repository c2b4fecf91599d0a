import random

import numpy as np
import pytest

from sparkveil.llm import sigtree


def shingles(text, width=3):
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return frozenset() if not w else frozenset(" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def plain(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[top(i)] = top(j)
    out = []
    for k, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(k) and rows[j][0] is not None] if sets[k] else [key]
        out.append((key, len(sets[k]), min(ids) if ids and ids != [None] else None))
    return out


def check(spark, rows, **options):
    docs = spark.createDataFrame([(k, t, 1, "q") for k, t in rows], "doc_id long, text string, rid int, h string")
    got = [tuple(r) for r in sigtree.near_sets(docs, **options).collect()]
    order = lambda x: tuple((v is None, v) for v in x)
    want = plain(rows, options.get("percent", 90))
    assert sorted(got, key=order) == sorted(want, key=order)
    return want


def corpus(seed, n=150, words=100):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows, base = [], [rng.choices(vocab, k=words) for _ in range(6)]
    for k in range(n):
        t = list(rng.choice(base)) if rng.random() < 0.7 else rng.choices(vocab, k=rng.randint(1, words))
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        rows.append((k, " ".join(t)))
    return rows


@pytest.mark.parametrize(("seed", "percent"), [(1, 90), (2, 75)])
def test_equals_all_pairs(spark, seed, percent):
    want = check(spark, corpus(seed), percent=percent)
    assert 3 < len({w[2] for w in want}) < 120


def test_blocks_and_frequent_tokens_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(sigtree, "BLOCK", 5)
    monkeypatch.setattr(sigtree, "PAIRS", 0.2)
    rng = random.Random(3)
    rows = corpus(5)
    head = " ".join(f"h{k}" for k in range(50))  # one passage in a third of all rows, with other words behind
    rows += [(200 + k, head + " " + " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(0, 9)))) for k in range(75)]
    check(spark, rows, frequent_from=1000)
    check(spark, rows, frequent_from=3)


def test_defined_cases(spark):
    long = " ".join(f"x{k}" for k in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "A"), (6, "a b"), (7, "b a"), (None, "A\tB"), (None, "z z z z"), (8, long), (9, long + " tail"), (9, long), (10, "é É"), (11, "É é")]
    rows += [(20, " ".join("abcdefghijk")), (19, " ".join("abcdefghijkl")), (20, " ".join("abcdefghijk"))]  # 9 and 10 shingles, at the threshold
    want = check(spark, rows)
    assert {w[2] for w in want if w[0] in (19, 20)} == {19}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sigtree.near_sets(empty).count() == 0


def test_pairs_of_a_tree_lose_nothing_and_prune():
    rng = np.random.default_rng(1)
    base = [rng.integers(0, 1 << 62, 200, dtype=np.uint64) for _ in range(30)]
    sets = []
    for k in range(300):
        s = base[k % 30].copy()
        s[: rng.integers(0, 30)] = rng.integers(0, 1 << 62, 1, dtype=np.uint64)
        sets.append(np.unique(s))
    n = np.array([len(s) for s in sets])
    tree = sigtree.Tree(np.stack([sigtree.bitmap(s) for s in sets]), n, np.arange(300), np.ones(300, bool))
    found = {tuple(sorted(p)) for p in zip(*(x.tolist() for x in tree.pairs(90)), strict=True)}
    true = {(i, j) for i in range(300) for j in range(i + 1, 300) if sigtree.similar(sets[i], sets[j], 90)}
    assert true <= found and len(found) < 2 * len(true) < 300 * 299 / 4


def test_similar_sizes_lie_in_adjacent_classes():
    for percent in (75, 90, 95):
        steps = sigtree.size_classes(3000, percent)
        band = np.searchsorted(steps, np.arange(1, 3001), side="right") - 1
        for n in range(1, 2000):
            assert band[n * 100 // percent - 1 if n * 100 // percent <= 3000 else -1] - band[n - 1] <= 1


def test_query_equals_sql(spark):
    import duckdb

    from sparkveil.llm import registry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(sigtree.ORACLE_OP11).fetchall()
    got = registry.QUERIES["op11_signature_trees"](spark, sf).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(r[0] != r[2] for r in want)
