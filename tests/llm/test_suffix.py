import random

from sparkveil.llm import suffix


def check(spark, rows, length=suffix.LENGTH, q=suffix.QGRAM):
    docs = spark.createDataFrame([(k, t, "z", 0) for k, t in rows], "doc_id long, text string, key string, a int")
    got = suffix.digest(suffix.remove_repeats(docs, length=length, q=q)).collect()
    want = suffix.brute_force([t for _, t in rows], length)
    order = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.key, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.n_kept == r.n_bytes - r.n_removed and r.changed == (r.n_removed > 0)), key=order) == sorted(((k, *w) for (k, _), w in zip(rows, want, strict=True)), key=order)
    return want


def test_planted_repeats_match_every_window(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij é", k=rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(90), prose(160), prose(70)]
    rows = []
    for k in range(60):
        t = prose(rng.randint(0, 200))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            cut = rng.randint(0, 120)
            t += rng.choice(["", " "]) + (p[cut:] if rng.random() < 0.5 else p[: len(p) - cut]) + prose(rng.randint(0, 60))
        rows.append((k, t))
    near = prose(500)
    for k in range(60, 80):
        t = list(near)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = "#"
        rows.append((k, "".join(t)))
    rows += [(100, None), (101, ""), (102, near), (103, "x" * 3000), (104, "xy" * 700), (105, "x" * 399), (106, "y" * 400), (107, ("abc" * 30 + "d") * 12), (60, rows[0][1]), (60, rows[0][1]), (None, near)]
    want = check(spark, rows)
    assert sum(w[1] for w in want) > 20_000


def test_short_windows_and_edges(spark):
    rng = random.Random(4)
    rows = [(k, "".join(rng.choices("ab", k=rng.randint(0, 90)))) for k in range(40)]
    check(spark, rows, length=24, q=8)
    base = "".join(rng.choices("abcdefgh", k=900))
    check(spark, [(1, base), (2, base[:399] + "#"), (3, base[500:]), (4, base[499:]), (5, "q" + base[100:500] + "q"), (6, base[101:500])])


def test_samples_stand_for_every_window_once():
    rng = random.Random(9)
    raw = bytes(rng.choices(b"abcd", k=5000))
    seen = [a - d for a, least, most in suffix.samples(raw) for d in range(least, most + 1)]
    assert seen == sorted(seen) or sorted(seen) == list(range(len(raw) - 399))
    assert sorted(seen) == list(range(len(raw) - 399))


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.digest(suffix.remove_repeats(docs)).count() == 0
