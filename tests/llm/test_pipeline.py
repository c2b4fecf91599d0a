import random

import corpus_pipeline
from tests.llm.test_lines import brute as plain_lines
from tests.llm.test_mixing_quality import fill
from tests.llm.test_simhash import survivors

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept int"


def prose(rng, n):
    stop = "the and of to in that is with for are".split()
    return " ".join(rng.choice(stop) if rng.random() < 0.4 else "".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 9))) for _ in range(n))


def fixture():
    rng = random.Random(21)
    shared = [prose(rng, 14) for _ in range(4)]
    rows = []
    for k in range(70):
        parts = [prose(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 5))]
        if rng.random() < 0.4:
            parts.insert(rng.randint(0, 2), rng.choice(shared))
        rows.append((k, "\n".join(parts), "en", f"s{k % 4}", 0, 1))
    for k in range(70, 90):
        w = rng.choice(rows[:20])[1].replace("\n", " ").split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((k, " ".join(w), "en", None, 0, 1))
    rows += [(200, None, None, "s0", 0, 1), (201, "", "en", "s1", 0, 1), (202, "### " * 100, "en", "s1", 0, 1), (203, rows[3][1], "en", "s2", 0, 1), (204, "a b c " * 90, "en", "s2", 0, 1)]
    return rows


def test_stages_one_by_one(spark, tmp_path):
    rows = fixture()
    now = spark.createDataFrame(rows, COLUMNS)
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        outs[name] = now
        assert name == "vector_packing" or now.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    texts = lambda name: sorted((r.doc_id, r.text) for r in outs[name].collect())
    kept = texts("quality_rules")
    assert {d for d, _ in kept} == {r[0] for r in rows} - {200, 201, 202, 204}
    assert texts("line_dedup") == sorted(plain_lines(kept, 2, 24))
    group, least = survivors(texts("line_dedup"))
    assert texts("simhash_dedup") == [(d, t) for d, t in texts("line_dedup") if least[group[t]] == (True, d)]
    size, source = {}, {r[0]: r[3] for r in rows}
    for d, t in texts("simhash_dedup"):
        size[source[d]] = size.get(source[d], 0) + len(t.split())
    mixed = {}
    for d, t in texts("mix_sources"):
        mixed[source[d]] = mixed.get(source[d], 0) + len(t.split())
    for s, target in fill(size).items():
        assert abs(mixed.get(s, 0) - target) <= 300
    pieces = outs["vector_packing"].collect()
    assert {r.doc_id for r in pieces} == {d for d, _ in texts("mix_sources")}


def test_run_over_a_folder(spark, tmp_path):
    spark.createDataFrame(fixture()[:30], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_rows_without_or_with_equal_ids_and_clashing_columns(spark, tmp_path):
    """Unique texts stay, whatever their ids and whatever else the table holds."""
    rng = random.Random(8)
    own = [prose(rng, 120) for _ in range(12)]
    ids = [None, None, None, 5, 5, 5, 6, 7, 8, 9, 9, None]
    rows = [(i, t, "en", "a", 0) for i, t in zip(ids, own, strict=True)] + [(5, own[4], "en", "a", 0), (None, own[1], "en", "b", 0)]
    names = "kept q sv_w sv_key sv_hash sv_gone sv_r1 sv_r2 sv_source sv_copies h th k".split()
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and docs.where("sv_w <> 2 or th <> 11").count() == 0
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in docs.collect()) == sorted((i is None, i or 0, t) for i, t in zip(ids, own, strict=True))
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == columns and {r.text for r in mixed.collect()} <= set(own)
    assert corpus_pipeline.pack_sequences(spark, mixed, "").count() >= mixed.count()
