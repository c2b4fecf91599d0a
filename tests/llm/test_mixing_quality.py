import pytest

from sparkveil.llm import mixing, quality


def fill(sizes, weights=(5, 2, 1)):
    """Targets by repeated dealing, as stated."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        t = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > 2 * sizes[s]]
        if not over:
            return capped | t
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_targets_and_taken(spark):
    rows = [(i, "w " * (i % 40 + 1), ["a", "b", "c", None, "d"][i % 5 if i % 3 else 0]) for i in range(3000)] + [(9999, None, "a"), (9998, "", "e")]
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, source string, size int, hash string")
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(rows)
    size, taken, target = {}, {}, {}
    src = {r[0]: r[2] for r in rows}
    for r in got:
        s = src[r.key]
        size[s] = size.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert r.taken <= 2 * r.size
    want = fill(size)
    for s in size:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 20.5
    again = mixing.mix_plan(docs.repartition(7)).collect()
    assert sorted((r.key, r.taken) for r in got) == sorted((r.key, r.taken) for r in again)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.taken // r.size for r in got if r.taken)


def test_rows_without_or_with_equal_ids_are_decided_one_by_one(spark, monkeypatch):
    rows = [(None, f"text {i} " * (i % 9 + 1), "a" if i % 3 else "b") for i in range(600)] + [(7, f"text {i}", "a" if i % 3 else "b") for i in range(40)]
    names = "sv_source sv_size sv_hash sv_copies sv_copy sv_l_source t_source below"
    docs = spark.createDataFrame([(*r, *range(8)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names.split()))
    outs = []
    for few in (100, 0):  # limits broadcast, or salted and joined
        monkeypatch.setattr(mixing, "FEW_SOURCES", few)
        mixed = mixing.mix_documents(docs)
        assert mixed.columns == docs.columns
        outs.append(sorted(tuple(r) for r in mixed.collect() if r.doc_id is None) + sorted(tuple(r) for r in mixed.collect() if r.doc_id is not None))
    assert outs[0] == outs[1]
    words = {}
    for r in mixed.collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    for s, target in fill(size).items():
        assert abs(words[s] - target) <= 60, s


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_plan(docs).count() == 0
    blank = spark.createDataFrame([(1, None, None), (1, "", "a")], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix_plan(blank).collect()] == [0, 0]


def plain_quality(text):
    t = text or ""
    for c in "\t\x0b\f\r":
        t = t.replace(c, " ")
    w = [x for x in t.replace("\n", " ").split(" ") if x]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_counts_match_a_plain_version(spark):
    texts = [None, "", "\n \t", "a", "a b c a b c", "a a a a a", "x y\nx y\n\nz\nx y ", "é è #1 **\x0b<b>|", "the and of " * 400, "one two three " * 2 + "four five"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(1, "", 1)], "doc_id long, text string, q int").drop("q")
    for r in quality.judge(docs).collect():
        q = r.q
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == plain_quality(r.text)
        assert r.base_failed == (q.n_words < 50 or 2 * q.n_repeat_words > q.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.judge(docs.limit(0)).count() == 0
    clash = quality.judge(docs.selectExpr("*", "1 as sv_w", "2 as sv_l", "3 as sv_q", "4 as sv_h", "5 as kept"))
    assert clash.columns == ["doc_id", "text", "sv_w", "sv_l", "sv_q", "sv_h", "kept", "q", "base_failed"] and clash.where("sv_w = 1 and sv_h = 4 and not kept").count() == len(texts) + 1


def test_very_long_texts(spark):
    long = "the river and a hill of " * 40_000
    row = quality.judge(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert row.q.n_words == 240_000 and row.base_failed
    got = mixing.mix_plan(spark.createDataFrame([(1, long, "a"), (2, "short", "a")], "doc_id long, text string, source string")).collect()
    assert {r.key: r.size for r in got} == {1: 240_000, 2: 1}


def test_rules_keep_prose_and_drop_junk(spark):
    prose = "The house of the river is old and the people who live in it say that winter comes early. "
    good = prose + " ".join(f"The {a} of {b} went to the {c} with a {d}." for a, b, c, d in zip("dog cat owl fox hen".split(), "rome oslo bern lima kyiv".split(), "lake hill wood farm mill".split(), "pipe drum bell harp lute".split(), strict=True))
    junk = " ".join(f"w{i}{'###' if i % 2 else '$$$'}" for i in range(200))
    bars = " | ".join(f"item{i}" for i in range(200))
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame([(1, good), (2, junk), (3, bars)], "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False}
