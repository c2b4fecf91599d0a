import random
from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from sparkveil.llm import counts, langid

SYLLABLES = {"aa": "ka ta mo ri so ne lu".split(), "bb": "sch ung eit ber mit und auf".split(), "cc": "tion eux que oir ent les eau".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def test_forward_sums_all_segmentations():
    lat = langid.lattice()
    rng = np.random.default_rng(1)
    probs = rng.uniform(1e-6, 1e-3, (lat.size + 1, 2))
    probs[-1] = langid.UNKNOWN
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=langid.public_path(langid.VOCABULARY))
    ids = {model.id_to_piece(i): i for i in range(model.get_piece_size())}
    for w in ["the", "hello", "über", "x", "q7ž漢字", "aaaa"]:
        s = langid.MARK + w
        total = np.zeros(2)
        for cuts in product([0, 1], repeat=len(s) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(s)]
            p = np.ones(2)
            for a, b in zip(at, at[1:], strict=False):
                piece = s[a:b]
                p = p * (probs[ids[piece]] if piece in ids else probs[-1] if b - a == 1 else 0)
            total += p
        assert np.allclose(lat.log_likelihood([w], langid._padded(probs))[0], np.log(total))
    long = "internationalization" * 9 + "x" * 40
    table = langid._padded(probs)
    whole = lat._long(langid.MARK + long, table)
    alpha = [np.ones(2)]
    s = langid.MARK + long
    for j in range(1, len(s) + 1):
        alpha.append(sum(alpha[i] * (probs[ids[s[i:j]]] if s[i:j] in ids else probs[-1] if j - i == 1 else 0) * 10.0 ** (j - i) for i in range(max(0, j - 40), j)))
    assert np.allclose(whole, np.log(alpha[-1]) - len(s) * np.log(10.0)) and np.allclose(lat.log_likelihood([long], table)[0], whole)
    assert np.allclose(lat._long(langid.MARK + "hello", table), lat.log_likelihood(["hello"], table)[0])
    expected = lat.expected(["the", "the"], np.array([2.0, 3.0]), langid._padded(probs[:, :1]))
    assert abs(sum(expected[i] * len(p) for p, i in ids.items()) - 5 * 4) < 1e-6


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(3, 40)), lang if rng.random() < 0.8 else None, lang) for i in range(400)]
    rows += [(900, None, "aa", "und"), (901, "", "bb", "und"), (902, "123 456", "bb", "und"), (903, text(rng, "bb", 5000), None, "bb"), (904, "ung" * 4000, None, "bb"), (None, text(rng, "cc", 20), "cc", "cc")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, truth string, key int")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {r[0]: r[3] for r in rows}
    assert sum(r.lang_pred == truth[r.key] for r in got) >= 0.99 * len(rows)
    assert all((r.lang_pred == "und") == (truth[r.key] == "und") for r in got)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.predict(docs, langid.train(docs)).collect()] == ["und"]
    none = docs.limit(0)
    assert langid.predict(none, langid.train(none)).count() == 0


def test_rollup_is_additive_and_idempotent(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, text(rng, "aa", rng.randint(0, 9)), rng.choice(["x", "y", None]), rng.choice(["aa", None]), 1) for i in range(80)] + [(5, None, "x", "aa", 1), (5, "a b", "x", "aa", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, sign int")
    counted = counts.count_documents(docs).cache()
    assert {r.version for r in counted.select("version").distinct().collect()} == {"words/1", "word_bpe_49k/1"}
    roll = counts.Rollup(spark, str(tmp_path / "roll"))
    assert roll.totals().count() == 0

    def totals():
        return {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in roll.totals().collect()}

    def plain(some):
        c, n = Counter(), Counter()
        for r in some:
            c[r.source, r.lang, r.version] += 1
            n[r.source, r.lang, r.version] += r.n_tokens
        return {k: (c[k], n[k]) for k in c}

    for b in range(3):
        assert roll.commit(b, counts.inserts(counted.where(counts.part_of(F.col("key"), 3) == b)))
    every = counted.collect()
    assert totals() == plain(every)
    assert not roll.commit(1, counts.inserts(counted))
    gone = counted.where("key < 10")
    assert roll.commit(3, counts.deletes(gone))
    assert totals() == plain([r for r in every if r.key >= 10])
    roll.compact(2)
    assert totals() == plain([r for r in every if r.key >= 10])
    assert not roll.commit(2, counts.inserts(counted))
    old = counted.where("key >= 10 and lang is null")
    assert roll.commit(4, counts.revisions(old, old.withColumn("lang", F.lit("und"))))
    assert {k[1] for k in totals()} == {"aa", "und"}
    roll.compact(4)
    assert sum(v[0] for v in totals().values()) == sum(1 for r in every if r.key >= 10)
    assert roll.commit(5, counts.inserts(counted.limit(0)))


def test_a_batch_that_comes_after_its_base_counts(spark, tmp_path):
    roll = counts.Rollup(spark, str(tmp_path / "roll"))
    batch = lambda n: counts.inserts(spark.createDataFrame([("s", "en", "v", n)], "source string, lang string, version string, n_tokens long"))
    tokens = lambda: roll.totals().first()["n_tokens"]
    assert roll.commit(0, batch(5)) and roll.commit(2, batch(7))
    roll.compact(2)
    assert roll.commit(1, batch(100)) and tokens() == 112
    assert not roll.commit(1, batch(100)) and not roll.commit(0, batch(1)) and not roll.commit(2, batch(1)) and tokens() == 112
    roll.compact(9)
    roll.vacuum()
    assert tokens() == 112 and not roll.commit(1, batch(100)) and sorted(p.name for p in (tmp_path / "roll").iterdir()) == ["base=1", "held=1"]
    assert roll.commit(9, batch(1)) and tokens() == 113
    roll.compact(3)
    assert tokens() == 113 and roll.commit(4, batch(1)) and tokens() == 114


def test_words_rollup_equals_sql(spark):
    import duckdb

    from sparkveil.llm import registry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = registry.QUERIES["rollup_words"](spark, sf).select("source", "lang", "version", "n_docs", "n_tokens").collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(counts.ORACLE_WORDS).fetchall(), key=str)


def test_a_rare_language_is_learned(spark):
    rng = random.Random(6)
    rows = [(text(rng, "aa", 4), "aa") for _ in range(3000)] + [(text(rng, "bb", 12), "bb") for _ in range(3)] + [("one common text", "aa")] * 3000
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    langs, probs = langid.train(docs, max_docs=60, rounds=1)
    assert langs == ["aa", "bb"] and probs.shape[1] == 2
