import random
import re
from collections import Counter

import pytest

from sparkveil.llm import phrases


def plain(rows, least, cover, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    kept = {p: c for p, c in f.items() if len(p) > 2 and c >= least}
    covered = set()
    for p, c in kept.items():
        w = p[1:]
        covered |= {q for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * c >= cover * kept[q := (p[0], *w[i : i + k])]}
    out = []
    for lang in n:
        mine = []
        for p, a in kept.items():
            if p[0] == lang and p not in covered:
                cuts = [(1000 * a * n[lang] // (f[p[: k + 1]] * f[(lang, *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
                score, k = min(cuts)
                mine.append((-score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(lang, *p[k + 1 :])]))
        out += [(lang, r, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for r, x in enumerate(sorted(mine)[:top], 1)]
    return sorted(out)


def check(spark, rows, least=5, cover=100, top=2000):
    docs = spark.createDataFrame([(None, lang, text, 3) for lang, text in rows], "doc_id long, lang string, text string, c int")
    got = sorted(map(tuple, phrases.collocations(docs.repartition(3), least=least, cover=cover, top=top).collect()))
    assert got == plain(rows, least, cover, top)
    return got


def corpus(seed, n=200):
    rng = random.Random(seed)
    word = lambda: rng.choice(["New", "york", "CITY", "of", "the", "é", "É", "a", "b", "x1", "zz"])
    return [(rng.choice(["en", "en", "de", None, "und"]), "".join(rng.choice([" ", " ", "\t ", ". ", "\n", ";"]) + word() for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("cover", [100, 80])
def test_equals_plain_counting(spark, cover):
    rows = corpus(1) + [("en", "one two three four five six " * 3)] * 7 + [("de", "drei Worte hier.")] * 6
    got = check(spark, rows, cover=cover)
    assert {len(r[2].split(" ")) for r in got} >= {2, 3, 5} and {r[0] for r in got} == {"en", "de", "und"}
    check(spark, rows, top=4)


def test_prefixes_cut_between_tasks_are_added(spark, monkeypatch):
    for name, value in (("CHUNK", 50), ("RANGE", 40), ("SAMPLED", 3), ("MOST_SAMPLES", 60)):
        monkeypatch.setattr(phrases, name, value)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = check(spark, corpus(2, 300) + [("en", "hot word pair here")] * 200)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert any(r[2] == "hot word pair here" for r in got)


def test_defined_cases(spark):
    rows = [(None, None), ("en", ""), ("en", "..,,\n"), ("", "q w " * 9), ("a b", "q w " * 9), ("en", "\x00 \x01 x\x00y \x01\x01 " * 8), ("en", "long " * 30_000), ("fr", "tie one, tie two, " * 6)]
    got = check(spark, rows)
    assert any("\x00" in r[2] for r in got)
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_products_beyond_64_bits_are_exact(spark):
    big = 3_000_000_000_001
    rows = [(["en"], big), (["en", "a"], big - 5), (["en", "b"], 7), (["en", "a", "b"], 7)]
    found = spark.createDataFrame(rows, "steps array<string>, c long")
    real = phrases.frequent_phrases
    phrases.frequent_phrases = lambda *a, **k: found
    try:
        (row,) = phrases.collocations(found).collect()
    finally:
        phrases.frequent_phrases = real
    assert row["score"] == 1000 * 7 * big // ((big - 5) * 7)


def test_query_equals_sql(spark):
    import duckdb

    from sparkveil.llm import registry

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(phrases.ORACLE_OP12).fetchall()
    assert sorted(map(tuple, registry.QUERIES["op12_prefix_growth"](spark, sf).collect())) == sorted(want) and len(want) > 20
