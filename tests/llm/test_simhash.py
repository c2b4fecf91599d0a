import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sparkveil.llm import simhash
from sparkveil.llm.graph import components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    """(doc_id, fp) -> {doc_id: component}, comparing all pairs."""
    prints = sorted({fp for _, fp in rows})
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, p in rows:
        least[find(p)] = min(d, least.get(find(p), d))
    return [(d, least[find(p)]) for d, p in rows]


def test_fingerprint_matches_the_definition():
    texts = [None, "", " \n", "One", "one two", "a b c", "Ä B c d e", "x " * 50, "a b c\x1cd e f", "w " * 70000 + "end"]
    rng = random.Random(1)
    texts += [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 40))) for _ in range(50)]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_anchor_covering_finds_every_pair():
    rng = np.random.default_rng(3)
    for code in (("golay", "golay"), ("golay", "golay", "hamming")):
        for _ in range(150):
            a = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
            b = a
            for bit in rng.choice(64, 2, replace=False):
                b ^= 1 << int(bit)
            home = simhash.anchors(a, code, 0)
            assert len(home) == 1 and home[0] in simhash.anchors(b, code, 2)


def test_near_duplicates_match_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(20)]
    rows = []
    for k in range(300):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((1000 - k, " ".join(t)))
    rows += [(5000, None), (5001, ""), (5002, "  "), (7, rows[0][1]), (7, rows[0][1])]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, key int")
    got = simhash.near_duplicates(docs).collect()
    want = brute([(d, simhash.fingerprint(t)) for d, t in rows])
    assert sorted((r.key, r.component_id) for r in got) == sorted(want)
    assert all(int(r.fingerprint, 16) == r.fp % (1 << 64) and len(r.fingerprint) == 16 for r in got)


def shingle_set(text, width=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def similar_groups(texts):
    """{text: least text of its component}, comparing all pairs by the similarity of their five-word shingles."""
    known = sorted({" ".join((t or "").lower().split()) for t in texts})
    sets = {t: shingle_set(t) for t in known}
    root = {t: t for t in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
                root[find(b)] = find(a)
    return {t: find(" ".join((t or "").lower().split())) for t in texts}


def survivors(rows):
    """The rows (key, text) that stay if one of each group does, that with the least key; ties of keys are not told apart."""
    group = similar_groups([t for _, t in rows])
    least = {}
    for k, t in rows:
        least[group[t]] = min(least.get(group[t], (k is not None, k or 0)), (k is not None, k or 0))
    return group, least


def planted(rng, words=400, copies=20):
    """Texts, and copies with so many words replaced that the similarity is 0.82 and above."""
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for b in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(100, words))]
        rows.append((1000 * b + 1000, " ".join(base)))
        for c in range(rng.randint(0, copies)):
            t = list(base)
            for _ in range(rng.randint(0, len(base) // 55)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((1000 * b + 1001 + c, " ".join(t)))
    return rows


def test_copies_are_found_and_nothing_else(spark):
    rng = random.Random(12)
    rows = planted(rng) + [(90_001, None), (90_002, ""), (90_003, " \n"), (90_004, "one two"), (90_005, "One  two"), (90_006, "one three")]
    rows += [(None, "first text of no id " * 3), (None, " ".join(f"x{i}" for i in range(90))), (5, "a text under a repeated id"), (5, "another text under it"), (5, "another text under it")]
    rows += [(6, " ".join(f"v{i}" for i in range(20_000))), (8, " ".join(f"v{i}" for i in range(19_990)) + " end")]
    docs = spark.createDataFrame([(k, t, "x", 1, "y") for k, t in rows], "doc_id long, text string, h string, sv_r1 int, key string")
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    group, least = survivors(rows)
    assert {group[t] for _, t in kept} == set(least), "each group keeps a row"
    for k, t in kept:
        assert (k is not None, k or 0) >= least[group[t]]
    assert len(kept) - len(least) <= 0.02 * (len(rows) - len(least)), "copies that stay beside the first"
    assert sorted(t for k, t in kept if k in (None, 5)) == sorted({t for k, t in rows if k in (None, 5)})


def test_a_large_family_of_copies_costs_rows_not_pairs(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for k in range(1500):
        t = list(base)
        for _ in range(2):
            t[rng.randrange(len(t))] = f"n{k}"
        rows.append((k, " ".join(t)))
    sizes = []
    write = simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df: (out := write(df), sizes.append((out.count(), out.columns)))[0])
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in kept] == [0]
    assert max(n for n, _ in sizes) <= 231 * len(rows), "an entry has some 231 anchors, and one hub at each"


def test_the_replicated_side_is_never_broadcast(spark):
    prints = spark.range(30_000).select((F.xxhash64("id")).alias("fp"))
    plan = simhash.near_pairs(prints)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0


def test_components_of_chain_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(500, 500), (7, 7), (3, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}
