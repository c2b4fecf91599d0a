"""What only shows on whole tables, or on larger ones, made small."""

import hashlib
import random
import time

from pyspark.sql import functions as F

from sparkveil.functions.text import strip_accents
from sparkveil.operators import documents as D
from sparkveil.operators import names as N
from sparkveil.operators import pseudonyms as P
from sparkveil.operators.restore import restore
from sparkveil.operators.spans import layers
from sparkveil.operators.words import FIRST_NAMES
from sparkveil.plans import QUERIES


def test_every_order_excludes_its_customer(spark, tmp_path):
    spark.range(4).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, 1, "1-URGENT"), (1, 2, "5-LOW")], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(r[0] for r in QUERIES["anti_join_exclusion"](spark, str(tmp_path)).collect()) == [0, 3]


def test_numbers_have_no_gaps_where_quantiles_come_out_differently_each_time(spark, monkeypatch):
    exact = F.percentile_approx
    shaken = F.udf(lambda xs: sorted({x + random.randint(0, 40) for x in xs}), "array<long>")
    monkeypatch.setattr(F, "percentile_approx", lambda *a: shaken(exact(*a)))
    before = spark.conf.get("spark.sql.exchange.reuse", "true")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        rows = spark.range(3000).select(F.lit("Empresa").alias("p"), (F.col("id") * 3).alias("o"))
        out = P.number_rows(rows, ["p"], ["o"], "n", slices=16).collect()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)
    assert sorted((r["o"], r["n"]) for r in out) == [(3 * k, k + 1) for k in range(3000)]


def test_names_are_walked_in_the_parts_that_can_begin_one_and_come_out_as_from_whole_texts(spark):
    texts = [
        "nada que ver aquí. Otra frase larga sin nadie; la Sra. Ana Gómez vino. Fin", "mi nombre, es Ana (1) y me\nllamo Juan Pérez", "firmado 12 por Luis Gil. Juan", "J. Pérez, Ana. K. Juan D. Gil\nMaría de la Cruz",
        "av. Juan B. Justo 12, Gómez Pérez, Juan; soy Pedro!", "el Dr. D'Elía. 'A. Juan", "...\n\n" + "x " * 50 + "Lic. Marta Sosa\t\n", "mi\nnombre\nes\nMarta", "titular: Rosa Paz. San. Juan",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(strip_accents(F.col("t")).alias("t"))
    parts = df.select(N._sections(F.col("t"), FIRST_NAMES).alias("x"), "t")
    assert [r["part"] for r in parts.collect()[0]["x"]] == ["la Sra. Ana Gomez vino"]
    found = [r[0] for r in df.select(N.names(F.col("t"))).collect()]
    whole = N._sections
    try:
        N._sections = lambda bare, _names: F.array(F.struct(F.lit(0).alias("at"), bare.alias("part")))
        assert found == [r[0] for r in df.select(N.names(F.col("t"))).collect()] and sum(map(len, found)) > 8
    finally:
        N._sections = whole


def test_restoring_keeps_control_characters(spark):
    texts = spark.createDataFrame([(1, "a\x01b\x02 Persona_01 \x01")], "doc_id long, text string")
    known = spark.createDataFrame([("Persona_01", "Ana Gil")], "pseudonym string, original string")
    assert restore(texts, known, ["doc_id"]).collect()[0]["restored"] == "a\x01b\x02 Ana Gil \x01"


def test_pdf_of_very_many_pages(spark, tmp_path):
    text = "\n".join(f"line ({k}) \\ caf\u00e9 \u4e2d\x01" for k in range(120_000))
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    rows = {r.doc_id: r for r in QUERIES["pdf_text"](spark, str(tmp_path)).collect()}
    took = time.time() - began
    shown = text.replace("\u4e2d\x01", "??").split("\n")
    want = "\n\n".join("\n".join(shown[k : k + 40]) for k in range(0, len(shown), 40))
    assert rows[1].pages == 3000 and rows[1].text_md5 == hashlib.md5(want.encode()).hexdigest() and rows[2].error == "no_text"
    assert took < 60


def test_texts_are_searched_once_for_single_words_and_their_matches(spark):
    assert layers(["ist", "the", "was"]) == [["ist", "the", "was"]]
    texts = spark.createDataFrame([(1, "The\u0301 th\u00e9 THE theist ist. W\u00c1S w\u1ea5s"), (2, "nada")], "id long, text string")
    terms = spark.createDataFrame([("the", "X", 0), ("ist", "X", 1), ("was", "X", 2)], "value string, type string, ord long")
    found = D.term_spans(texts, terms, ["id"]).select("id", F.explode("sv_terms").alias("s"))
    assert "regexp" not in found._jdf.queryExecution().toString()
    assert [(r.id, r.s.value) for r in found.collect()] == [(1, "The"), (1, "th\u00e9"), (1, "THE"), (1, "ist"), (1, "W\u00c1S"), (1, "w\u1ea5s")]


def test_leaks_of_small_scopes_need_no_pieces_and_large_ones_find_the_same(spark, monkeypatch):
    cleaned = spark.createDataFrame([(1, "a", "xAna Lópezx Bruno Gil"), (1, "b", "Ana López, Bruno Gil"), (2, "c", "valor 7 y valor 11."), (3, None, "Ana López"), (4, "a", None)], "id int, who string, protected string")
    secrets = spark.createDataFrame([("a", "Ana López"), ("a", "Ana López"), ("b", "Bruno Gil"), ("b", "Ana"), (None, "Ana López"), *[("c", f"valor {k}") for k in range(30)]], "who string, original string")
    want = [(1, ["Ana López"]), (1, ["Bruno Gil"]), (2, ["valor 1", "valor 11", "valor 7"])]
    found = D.leaks(cleaned, secrets, ["id"], ["who"])
    assert "sv_piece" not in found._jdf.queryExecution().toString() and sorted(map(tuple, found.collect())) == want
    for few in (0, 10):
        monkeypatch.setattr(D, "_FEW_SECRETS", few)
        found = D.leaks(cleaned, secrets, ["id"], ["who"])
        assert "sv_piece" in found._jdf.queryExecution().toString() and sorted(map(tuple, found.collect())) == want
