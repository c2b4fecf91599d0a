import random

import xxhash
from pyspark.sql import functions as F

from sparkveil.llm import lines


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def text_order(text):
    """Spark's xxhash64 of a string, by which texts of one key are ordered."""
    return xxhash.xxh64_intdigest(text.encode(), 42) + (1 << 63) & (1 << 64) - 1


def brute(rows, edits, least):
    places = [(k, t, i, x) for k, t in rows if t is not None for i, x in enumerate(t.split("\n")) if any(c.isalnum() for c in x)]
    known = sorted({x for *_, x in places})
    root = {x: x for x in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= edits and edit_distance(a, b) <= edits:
                root[find(a)] = find(b)
    first = {}
    order = lambda k, t, i: (k is not None, k or 0, text_order(t), i)
    for k, t, i, x in places:
        first[find(x)] = min(first.get(find(x), order(k, t, i)), order(k, t, i))
    gone = {(k, t, i) for k, t, i, x in places if first[find(x)] != order(k, t, i)}
    return [(k, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (k, t, i) not in gone)) for k, t in rows]


def mutate(rng, s, n):
    for _ in range(n):
        i, c = rng.randrange(len(s) + 1), rng.choice("abcé ")
        s = rng.choice([s[:i] + c + s[i:], s[:i] + s[i + 1 :], s[:i] + c + s[i + 1 :]])
    return s


def test_matches_all_pairs(spark):
    rng = random.Random(8)
    pool = ["".join(rng.choices("abcdé ", k=rng.randint(24, 60))) for _ in range(25)]
    rows = []
    for k in range(60):
        rows.append((200 - k, "\n".join(rng.choice([mutate(rng, rng.choice(pool), rng.randint(0, 4)), "}", "", "short line", rng.choice(pool)]) for _ in range(rng.randint(0, 7)))))
    rows += [(300, None), (301, ""), (302, "\n\n"), (None, pool[0] + "\n" + pool[1]), (7, pool[2] + "\n" + pool[2]), (7, pool[4] + "\nown line of seven"), (None, pool[3] + "\n" + pool[5]), (None, "one more text\n" + pool[6]), (8, "x" * 500 + "\n" + "x" * 502)]
    docs = spark.createDataFrame([(k, t, "p", 1) for k, t in rows], "doc_id long, text string, sv_key string, line int")
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    order = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=order) == sorted(brute(rows, 2, 24), key=order)


def test_edit_check_is_exact(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choices("ab", k=rng.randint(0, 12)))
        pairs.append((a, mutate(rng, a, rng.randint(0, 5))))
    df = spark.createDataFrame(pairs, "line_a string, line_b string").withColumn("n", F.monotonically_increasing_id())
    for edits in (1, 2, 3):
        got = sorted((r.line_a, r.line_b) for r in lines._within(df, edits).collect())
        assert got == sorted((a, b) for a, b in pairs if edit_distance(a, b) <= edits)


def test_query_and_stage_drop_copies_of_short_lines(spark, tmp_path):
    import corpus_pipeline
    from sparkveil.llm import registry

    rows = [(1, "All rights reserved.\n}\n\nshort line"), (2, "own words\nAll rights reserved.\n}\n\n--"), (3, "short line\nshort lime\n--")]
    want = {1: rows[0][1], 2: "own words\n}\n\n--", 3: "short lime\n--"}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()} == want
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n_chars_kept for r in registry.op6_segment_lines(spark, str(tmp_path)).collect()}
    assert got == {k: len(t) for k, t in want.items()}


def test_a_family_of_matching_lines_costs_rows_not_pairs(spark, monkeypatch):
    rng = random.Random(3)
    base = "".join(rng.choices("abcdefgh ", k=90))
    family = sorted({base[:i] + c + base[i + 1 :] for i in range(90) for c in "abcdefghijklmnopqrstuvwxyz"})[:2000]
    other = ["".join(rng.choices("abcdefgh ", k=90)) for _ in range(30)]
    known = spark.createDataFrame([(x,) for x in [*family, *other]], "line string")
    sizes = []
    write = lines.materialize
    monkeypatch.setattr(lines, "materialize", lambda df: (out := write(df), sizes.append(out.count()))[0])
    edges = lines.matching_lines(known)
    found = {r.node for r in lines.components(edges).collect()}
    assert len(found) == 2000
    assert max(sizes) <= 40 * len(family)


def test_no_rows(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
