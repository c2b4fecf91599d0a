"""Pseudonyms, documents, dictionary search, restoring, tables and models."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sparkveil.operators import documents as D
from sparkveil.operators import model as M
from sparkveil.operators import table as T
from sparkveil.operators.pseudonyms import assign, number_rows
from sparkveil.operators.restore import restore
from sparkveil.operators.spans import find_terms, layers
from sparkveil.streaming.state import Registry


@pytest.fixture(scope="module")
def protected(spark):
    rows = [
        (1, 0, "Graciela Benítez pidió hablar con la Sra. Benítez. Email: g.b@mail.com", None, None),
        (1, 1, "Juan Pérez", "contacto", None),
        (1, 2, "Llamar a juan perez y a Transporte Roca SRL", None, None),
        (2, 0, "Roberto Gómez y Ana Gómez. El Sr. Gómez vino", None, None),
        (3, 0, None, None, None),
        (4, 0, "1001", "cliente", None),
    ]
    segments = spark.createDataFrame(rows, "doc_id int, seg_id int, text string, hint string, context string")
    analyzed = D.analyze(segments)
    return analyzed, D.protect(analyzed)


def test_documents_are_protected_consistently(protected):
    got = {(r.doc_id, r.seg_id): r.protected for r in protected[1].segments.collect()}
    assert got == {
        (1, 0): "Persona_01 pidió hablar con la Sra. Persona_01. Email: ***@mail.com",
        (1, 1): "Persona_02",
        (1, 2): "Llamar a Persona_02 y a Empresa_01",
        (2, 0): "Persona_01 y Persona_02. El Sr. Persona_03 vino",
        (3, 0): None,
        (4, 0): "1001",
    }


def test_nothing_leaks_and_answers_are_restored(spark, protected):
    done = protected[1]
    assert D.leaks(done.segments, done.equivalences, ["doc_id", "seg_id"], ["doc_id"]).count() == 0
    answers = spark.createDataFrame([(1, "Persona 1 y persona_02, **PERSONA-01** Persona_9 [DNI] una persona 2 veces DNI 32.456"), (2, "Persona_02 ok"), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in restore(answers, done.equivalences, ["doc_id"], ["doc_id"]).collect()}
    assert got[1].restored == "Graciela Benítez y Juan Pérez, **Graciela Benítez** Persona_9 [DNI] una persona 2 veces DNI 32.456"
    assert got[1].replaced == {"Persona_01": 2, "Persona_02": 1} and got[1].unknown == ["Persona_9"] and got[1].irreversible == ["[DNI]"]
    assert got[2].restored == "Ana Gómez ok" and got[3].restored is None


def test_policy_and_ignored_values(spark):
    df = spark.createDataFrame([(1, 0, "Mail a@b.com de Juan Pérez")], "doc_id int, seg_id int, text string")
    analyzed = D.analyze(df, ignored=["JUAN PEREZ"])
    row = D.protect(analyzed, {"EMAIL": "mantener"}).segments.first()
    assert row.protected == "Mail a@b.com de Juan Pérez" and [s.value for s in row.ignored_spans] == ["Juan Pérez"]
    assert D.action_of({"IP": "eliminar"})["IP"] == "anonimizar"


def sequential(rows):
    """The plain registry, one row after another."""
    registry, words, out = {}, {}, []
    for prefix, kind, raw in rows:
        key = Registry.key(kind, raw)
        group = registry.setdefault(prefix, {})
        parts = raw.lower().split()
        if key not in group and kind == "NOMBRE_PERSONA" and len(parts) == 1 and len(parts[0]) >= 4 and words.get((prefix, parts[0])):
            out.append(words[prefix, parts[0]])
            continue
        if key not in group:
            group[key] = f"{prefix}_{len(group) + 1:02d}"
            if len(parts) > 1:
                for w in set(parts):
                    words[prefix, w] = group[key] if (prefix, w) not in words else None
        out.append(group[key])
    return out


def test_numbering_equals_the_sequential_registry(spark):
    rng = random.Random(5)
    names = ["maria", "lopez", "garcia", "perez", "soto", "ana", "ruiz"]
    rows, expected = [], {}
    for scope in range(12):
        own = [("Persona", "NOMBRE_PERSONA", " ".join(rng.sample(names, rng.choice([1, 1, 2])))) for _ in range(rng.randint(1, 25))]
        for k, (row, name) in enumerate(zip(own, sequential(own), strict=True)):
            rows.append((scope, k, *row))
            expected[scope, k] = name
    df = spark.createDataFrame(rows, "scope int, k int, prefix string, type string, raw string")
    got = {(r.scope, r.k): r.pseudonym for r in assign(df, ["k"], ["scope"])[0].collect()}
    assert got == expected


def test_numbers_run_on_over_slices(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1009).alias("o"), (F.col("id") % 3 == 0).cast("string").alias("g"))
    got = number_rows(df, ["g"], ["o"], "n", slices=9).toPandas().sort_values(["g", "o"])
    assert (got.groupby("g").cumcount() + 1 == got["n"]).all()


def test_terms_are_whole_words(spark):
    df = spark.createDataFrame([(1, "Óscar y oscar, oscarito; OSCAR. aa aa aa"), (2, None), (3, "")], "id int, text string")
    terms = F.array(F.struct(F.lit("oscar").alias("value"), F.lit("A").alias("type")), F.struct(F.lit("aa aa").alias("value"), F.lit("B").alias("type")))
    got = {r.id: [(s.type, s.start, s.value) for s in r.x] for r in df.select("id", find_terms(F.coalesce("text", F.lit("")), terms).alias("x")).collect()}
    assert got[1] == [("A", 0, "Óscar"), ("A", 8, "oscar"), ("A", 25, "OSCAR"), ("B", 32, "aa aa")] and got[2] == got[3] == []
    listed = spark.createDataFrame([("oscar", "A", 0), ("aa aa", "B", 1)], "value string, type string, ord long")
    assert {r.id: len(r.sv_terms) for r in D.term_spans(df, listed, ["id"]).collect()} == {1: 4}


def test_tables_of_documents_share_the_registry(spark):
    rows = [(1, 0, 0, ["Vendedor", "Monto"]), (1, 0, 1, ["Juan Pérez", "10"]), (1, 0, 2, ["Ana Gómez", "20"]), (1, 1, 0, ["Contacto"]), (1, 1, 5, ["JUAN PEREZ"])]
    tables = spark.createDataFrame(rows, "doc_id int, table_id int, row_id int, cells array<string>")
    analyzed = D.analyze(D.table_segments(tables, "doc_id"))
    done = D.protect(analyzed)
    got = {(r.table_id, r.row_id): r.cells for r in D.rebuild_tables(done.segments, "doc_id").collect()}
    assert got == {(0, 1): ["Persona_01", "10"], (0, 2): ["Persona_02", "20"], (1, 5): ["Persona_01"]}
    assert [tuple(r) for r in D.usage_events(analyzed, D.action_of()).collect()] == [(1, "NOMBRE_PERSONA", "seudonimizar", 3)]


TABLE = [
    (0, "Pérez Hnos SA", "20-12345678-6", "a@x.com", 850000.0, "Hablar con Pérez Hnos SA sobre b@y.com hoy mismo", "Córdoba"),
    (1, "PEREZ HNOS S.A.", "20-12345678-6", None, 1250000.0, "nada importante que decir por ahora", "Salta"),
    (2, "Roca SRL", "27-12345678-0", "c@x.com", 90.0, "el cliente Roca SRL llamó ayer a la tarde", "Salta"),
]


def test_columns_are_classified(spark):
    df = spark.createDataFrame(TABLE, "_row int, Cliente string, CUIT string, Correo string, Sueldo double, Notas string, Provincia string")
    found = {f.header: f for f in T.classify(df, "_row")}
    kinds = {h: (f.kind, f.type, f.confidence) for h, f in found.items()}
    assert kinds["Cliente"] == ("columna", "RAZON_SOCIAL", "alta") and kinds["Correo"] == ("columna", "EMAIL", "alta") and kinds["CUIT"][1] == "CUIT_CUIL"
    assert kinds["Sueldo"] == ("columna", "SALARIO", "alta") and kinds["Notas"][0] == "texto" and kinds["Provincia"] == ("ninguno", None, None)
    assert found["Correo"].count == 2 and T.summarize_findings(list(found.values()))["EMAIL"] == 3


def test_a_table_is_protected_with_one_numbering(spark):
    df = spark.createDataFrame(TABLE, "_row int, Cliente string, CUIT string, Correo string, Sueldo double, Notas string, Provincia string")
    plan = {"Cliente": T.Decision("seudonimizar", "RAZON_SOCIAL"), "CUIT": T.Decision("eliminar", "CUIT_CUIL"), "Correo": T.Decision("anonimizar", "EMAIL"), "Sueldo": T.Decision("anonimizar", "SALARIO"), "Notas": T.Decision("seudonimizar", None, "texto")}
    done = T.apply_decisions(df, plan, "_row")
    rows = done.table.orderBy("_row").collect()
    assert [r.Cliente for r in rows] == ["Empresa_01", "Empresa_01", "Empresa_02"] and "CUIT" not in done.table.columns
    assert rows[0].Notas == "Hablar con Empresa_01 sobre Email_01 hoy mismo" and rows[2].Notas == "el cliente Empresa_02 llamó ayer a la tarde"
    assert [r.Correo for r in rows] == ["***@x.com", None, "***@x.com"] and rows[0].Sueldo == "$ 800.000 – 900.000" and [r.Provincia for r in rows] == ["Córdoba", "Salta", "Salta"]
    assert {r.type: r["count"] for r in done.counts.collect()} == {"RAZON_SOCIAL": 5, "EMAIL": 3, "SALARIO": 3, "CUIT_CUIL": 3}


class FakeRunner:
    def encode_word(self, word):
        return [1]

    def scores(self, prompt, words, labels, width):
        import numpy as np

        out = np.full((len(words), width, len(labels)), -9.0)
        out[0, 1, 0] = 2.0  # the first two words of a window are a person
        return out


def test_a_model_runs_in_windows(spark):
    df = spark.createDataFrame([(1, "Nahuel Ibarra vino. Después otra cosa"), (2, None), (3, " ")], "id int, text string")
    got = M.detect(df, FakeRunner, ["id"], config=M.Config(window_words=0)).collect()
    assert len(got) == 1 and [(s.type, s.value, s.confidence) for s in got[0].spans] == [("NOMBRE_PERSONA", "Nahuel Ibarra", "alta"), ("NOMBRE_PERSONA", "Después otra", "alta")]


class HashRunner(FakeRunner):
    """Scores that follow from the words of a window alone."""

    def encode_word(self, word):
        return [ord(c) for c in word[:3]]

    def scores(self, prompt, words, labels, width):
        import numpy as np

        seed = sum((k + 1) * sum(w) for k, w in enumerate(words))
        return np.random.default_rng(seed).normal(-3, 2.5, (len(words), width, len(labels)))


class CountingRunner(HashRunner):
    runs: list = []  # noqa: RUF012

    def scores_many(self, prompt, windows, labels, width):
        sizes = [sum(map(len, w)) for w in windows]
        CountingRunner.runs.append((len(windows), max(sizes) * len(windows), sum(sizes)))
        return [self.scores(prompt, w, labels, width) for w in windows]


def test_a_model_scores_windows_of_all_rows_together(spark):
    rng = random.Random(8)
    words = "Ana Paz vive en Rosario y trabaja con Luis desde hace mucho tiempo en la empresa del Sur".split()
    rows = [(k, ". ".join(" ".join(rng.choices(words, k=rng.randint(1, 20))) for _ in range(rng.randint(0, 5)))) for k in range(60)]
    rows += [(100 + k, rows[k % 7][1]) for k in range(40)]
    df = spark.createDataFrame(rows, "id int, text string")
    config = M.Config(window_words=0, run_windows=16, run_tokens=4000)
    apart = {r.id: r.spans for r in M.detect(df, HashRunner, ["id"], config=config).collect()}
    together = {r.id: r.spans for r in M.detect(df, CountingRunner, ["id"], config=config).collect()}
    assert apart == together and sum(map(len, apart.values())) > 50

    scores = M.Scores(CountingRunner(), [[1]], ["x"], M.Config(run_windows=8, run_tokens=10_000, kept=30))
    wanted = {(str(k),): [[1] * (k % 10 + 1)] for k in range(40)}
    CountingRunner.runs.clear()
    first = scores.of(wanted)
    assert set(first) == set(wanted) and len(CountingRunner.runs) == 5 and len(scores.known) == 30
    assert sum(r[1] for r in CountingRunner.runs) <= 1.25 * sum(r[2] for r in CountingRunner.runs)  # next to no padding
    CountingRunner.runs.clear()
    again = scores.of({k: wanted[k] for k in list(scores.known)})
    assert CountingRunner.runs == [] and all((again[k] == first[k]).all() for k in again)
    assert scores.runs([5, 900, 5, 5]) == [[1, 0, 2, 3]] and M.Scores(HashRunner(), [[1] * 10], [], M.Config(run_windows=9, run_tokens=100)).runs([30, 1, 45, 2]) == [[2], [0, 3], [1]]


def test_windows_cut_long_sentences_with_an_overlap():
    words = [(f"w{k}", 3 * k, 3 * k + 2) for k in range(30)]
    text = " ".join(w for w, _, _ in words)
    assert M.windows(text, words, [1] * 30, 99, M.Config(window_words=12, overlap=4)) == [(0, 12), (8, 20), (16, 28), (24, 30)]


def test_rules_and_model_are_combined(spark):
    span = "array<struct<type:string,start:int,end:int,value:string,confidence:string,source:string>>"
    rows = [
        (1, [("NOMBRE_PERSONA", 0, 11, "María Laura", "media", "r")], [("NOMBRE_PERSONA", 0, 17, "María Laura Gómez", "baja", "m")]),
        (2, [("DNI", 0, 8, "12345678", "alta", "r")], [("NOMBRE_PERSONA", 0, 12, "12345678 Ana", "alta", "m")]),
        (3, [], [("NOMBRE_PERSONA", 0, 11, "La empleada", "alta", "m"), ("RAZON_SOCIAL", 20, 26, "Google", "alta", "m"), ("DIRECCION", 30, 40, "Las Heras", "alta", "m"), ("NOMBRE_PERSONA", 50, 60, "Persona_01", "alta", "m")]),
    ]
    df = spark.createDataFrame(rows, f"id int, a {span}, b {span}")
    got = {r.id: [(s.value, s.source) for s in r.x] for r in df.select("id", M.combine_spans(F.lit(""), F.col("a"), F.col("b")).alias("x")).collect()}
    assert got == {1: [("María Laura Gómez", "ia")], 2: [("12345678", "r")], 3: []}


def test_listed_terms_equal_terms_one_by_one(spark):
    rng = random.Random(3)
    pieces = ["Ana", "ÁNA", "ana gómez", "Gómez", "gomez paz", "paz", "a", "a a", "x-1", "(x)", "ñandú", "Straße", " ", ".", "\n", "banana", "1", "ba"]
    texts = [(k, "".join(rng.choice(pieces) + rng.choice(["", " ", "  ", ","]) for _ in range(rng.randint(0, 30)))) for k in range(200)] + [(900, None), (901, ""), (902, "\x01ana\x02 ana")]
    values = ["Ana", "ana gomez", "GÓMEZ", "Gómez Paz", "x-1", "(x)", "ñandu", "paz", "straße", "z", " "]
    terms = [(v, "NOMBRE_PERSONA" if k % 2 else "DIRECCION", k) for k, v in enumerate(values)]
    df = spark.createDataFrame(texts, "id long, text string")
    listed = spark.createDataFrame([*terms, ("ana", "DNI", 50)], "value string, type string, ord long")
    array = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(t).alias("type")) for v, t, _ in [*terms, ("ana", "DNI", 50)]])
    want = {r.id: [tuple(s) for s in r.x] for r in df.select("id", find_terms(F.col("text"), array).alias("x")).collect() if r.x}
    got = {r.id: [tuple(s) for s in r.sv_terms] for r in D.term_spans(df, listed, ["id"]).collect()}
    assert got == want and sum(map(len, got.values())) > 300


def test_very_many_matches_of_a_term(spark):
    text = "uno Dós, tres " * 100_000
    df = spark.createDataFrame([(1, text)], "id long, text string")
    terms = spark.createDataFrame([("dos", "DNI", 0), ("tres", "DNI", 1)], "value string, type string, ord long")
    began = time.time()
    row = D.term_spans(df, terms, ["id"]).select(F.size("sv_terms").alias("n"), F.aggregate("sv_terms", F.lit(0).cast("long"), lambda a, s: a + s["start"]).alias("sum")).first()
    assert row["n"] == 200_000 and row["sum"] == sum(14 * k + 4 + 14 * k + 9 for k in range(100_000)) and time.time() - began < 60


def test_needles_that_overlap_are_in_layers_of_their_own():
    assert layers(["ana", "ana gomez", "paz"]) == [["ana", "paz"], ["ana gomez"]]
    assert layers(["a b", "b c"]) == [["a b"], ["b c"]] and layers(["x", "y"]) == [["x", "y"]]
