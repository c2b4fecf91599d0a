"""Files from reading to protected copies, envelopes, and the smaller operators of reports, models and charts."""

import base64
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from sparkveil.functions.misc import base32
from sparkveil.operators import charts as C
from sparkveil.operators import documents as D
from sparkveil.operators import files, model
from sparkveil.operators import quality as Q
from sparkveil.operators import report as R
from sparkveil.operators.table import Finding
from sparkveil.sources import readers as S
from sparkveil.sources import writers as K


def parts(path):
    return "".join(p.read_text() for p in sorted(path.rglob("part-*")))


def test_a_table_file_from_review_to_copy(spark, tmp_path):
    rows = "".join(f"u{k}@mail.example.com;{k}\n" for k in range(12))
    (tmp_path / "t.csv").write_text("Correo;n\n" + rows)
    review = files.review_file(spark, str(tmp_path / "t.csv"))
    assert review.delimiter == ";" and files.file_totals(review) == {"EMAIL": 12}
    done = files.protect_file(review)
    files.write_file(review, done, str(tmp_path / "out"))
    text = parts(tmp_path / "out")
    assert text.count("***@mail.example.com") == 12 and "u3@" not in text and "Correo;n" in text
    assert [(r.type, r["count"]) for r in done.counts.collect()] == [("EMAIL", 12)]


def test_text_and_json_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Escribir a u1@mail.example.com hoy")
    review = files.review_file(spark, str(tmp_path / "a.txt"))
    assert files.file_totals(review) == {"EMAIL": 1}
    files.write_file(review, files.protect_file(review), str(tmp_path / "a"))
    assert parts(tmp_path / "a").strip() == "Escribir a ***@mail.example.com hoy"
    (tmp_path / "n.json").write_text('{"pedido": 7, "cliente": {"email": "u1@mail.example.com", "notas": ["nada"]}}')
    review = files.review_file(spark, str(tmp_path / "n.json"))
    files.write_file(review, files.protect_file(review), str(tmp_path / "n"))
    assert parts(tmp_path / "n").strip() == '{"pedido": 7, "cliente": {"email": "***@mail.example.com", "notas": ["nada"]}}'
    (tmp_path / "l.json").write_text('[{"email": "u1@mail.example.com", "n": 1}, {"email": "u2@mail.example.com", "n": 2}]')
    review = files.review_file(spark, str(tmp_path / "l.json"))
    assert list(review.sheets) == [""] and files.file_totals(review) == {"EMAIL": 2}
    files.write_file(review, files.protect_file(review), str(tmp_path / "l"))
    assert parts(tmp_path / "l").splitlines() == ['{"email":"***@mail.example.com","n":"1"}', '{"email":"***@mail.example.com","n":"2"}']
    with pytest.raises(ValueError, match="not a known kind"):
        files.review_file(spark, str(tmp_path / "x.exe"))


def test_sheets_of_a_workbook(spark, tmp_path):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda at, v: f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
    row = lambda n, *v: f'<row r="{n}">' + "".join(cell(f"{'AB'[i]}{n}", x) for i, x in enumerate(v)) + "</row>"
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="uno" r:id="r1"/><sheet name="dos" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{main}"><sheetData>' + row(1, "Email", "n") + "".join(row(k, f"u{k}@mail.example.com", k) for k in range(2, 8)) + "</sheetData></worksheet>")
        z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{main}"><sheetData>{row(1, "solo", "titulos")}</sheetData></worksheet>')
    review = files.review_file(spark, str(tmp_path / "t.xlsx"))
    assert list(review.sheets) == ["uno"] and review.sheets["uno"].columns == ["_row", "Email", "n"]
    assert files.file_totals(review) == {"EMAIL": 6}
    assert files.protect_file(review).parts["uno"].where("Email = '***@mail.example.com'").count() == 6


def test_envelopes(spark, tmp_path):
    df = spark.createDataFrame([("Persona_01", "Ana Gómez", "Persona"), ("DNI_01", "1", None)], "seudonimo string, original string, grupo string")
    K.write_envelope(df, str(tmp_path / "e"), "clave", "some-format", iterations=1000)
    assert sorted(map(tuple, S.read_envelope(spark, str(tmp_path / "e"), "clave").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    with pytest.raises(Exception, match="(?i)tag|decrypt|aes"):
        S.read_envelope(spark, str(tmp_path / "e"), "otra").collect()


def test_base32(spark):
    values = [b"", b"f", b"fo", b"foo", b"foob", b"fooba", b"foobar", bytes(range(200, 256))]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "b binary").select(base32(F.col("b"))).collect()]
    assert got == [base64.b32encode(v).decode().rstrip("=") for v in values]


def test_leaks_inside_words_and_of_many_values(spark):
    cleaned = spark.createDataFrame([(1, "xAna Lópezx y más"), (2, "nada"), (3, None), (4, "abc")], "doc_id int, protected string")
    secrets = spark.createDataFrame([("Ana López",), ("abc",), (None,), *[(f"otro valor {k}",) for k in range(200)]], "original string")
    assert [(r.doc_id, r.leaked) for r in D.leaks(cleaned, secrets, ["doc_id"]).collect()] == [(1, ["Ana López"])]


def test_many_terms_are_found_like_few(spark):
    texts = spark.createDataFrame([(k, f"uno término{k} y TERMINO{k + 1}") for k in range(90)], "id int, text string")
    terms = spark.createDataFrame([(f"termino{k}", "X", k) for k in range(100)], "value string, type string, ord long")
    many = {r.id: sorted(s.value for s in r.sv_terms) for r in D.term_spans(texts, terms, ["id"]).collect()}
    few = {r.id: sorted(s.value for s in r.sv_terms) for r in D.term_spans(texts, terms.where("ord < 60"), ["id"]).collect()}
    assert many[5] == few[5] == ["TERMINO6", "término5"] and len(many) == 90 and len(few) == 60


def test_three_examples_in_order(spark):
    df = spark.createDataFrame([(1, 0, "mail z9@mail.example.com"), (2, 0, "a1@mail.example.com, b1@mail.example.com y c1@mail.example.com")], "doc_id int, seg_id int, text string")
    row = D.summarize(D.analyze(df)).where("type = 'EMAIL'").first()
    assert (row["count"], row["distinct"]) == (4, 4) and [e[:1] for e in row.examples] == ["z", "a", "b"]


def test_people_guards_and_audit(spark, tmp_path):
    users = spark.createDataFrame([(1, 7, 1, "Zoe", "empleado", True), (2, 7, None, "Ana", "empleado", True), (3, 7, 1, "Bea", "empleado", False), (4, 8, 1, "Eva", "supervisor", True)], "id int, org_id int, area_id int, name string, role string, active boolean")
    areas, orgs = spark.createDataFrame([(1, 7, "Ventas")], "id int, org_id int, name string"), spark.createDataFrame([(7, "Uno")], "id int, name string")
    assert [tuple(r) for r in R.employees(users, areas, 7).collect()] == [(2, "Ana", None, True), (1, "Zoe", "Ventas", True), (3, "Bea", "Ventas", False)]
    assert [tuple(r) for r in R.whoami(users, orgs, areas, 2).collect()] == [(2, "Ana", "Uno", None)] and R.whoami(users, orgs, areas, 4).count() == 0
    assert R.require(users, 4, ("supervisor",))["name"] == "Eva"
    for user, roles, verified, code in ((9, (), True, "28000"), (3, (), True, "28000"), (1, ("supervisor",), True, "42501"), (4, ("supervisor",), False, "42501")):
        with pytest.raises(R.NotAllowed) as e:
            R.require(users, user, roles, verified)
        assert e.value.code == code
    R.audit(spark, str(tmp_path / "log"), 4, "panel", {"desde": "2025-01-01"})
    R.audit(spark, str(tmp_path / "log"), 4, "panel")
    assert [r.detail for r in spark.read.parquet(str(tmp_path / "log")).orderBy("ts").collect()] == ['{"desde": "2025-01-01"}', "{}"]


def test_months_json_arrays_and_sets(spark):
    months = spark.createDataFrame([("2025-01",), ("2025-02",), ("2025-03",)], "month string")
    flags = lambda a, b: [r.partial for r in R.partial_months(months, a, b).orderBy("month").collect()]
    assert flags(date(2025, 1, 1), date(2025, 3, 31)) == [False] * 3 and flags(date(2025, 1, 2), date(2025, 3, 30)) == [True, False, True]
    ev = spark.createDataFrame([(1, '[{"type": "DNI", "action": "eliminar", "amount": 3}, {"type": "IP", "action": "mantener", "amount": 1}]'), (2, None), (3, "[]")], "event_id int, detections string")
    assert sorted(tuple(r) for r in R.parse_detections(ev).collect()) == [(1, "DNI", "eliminar", 3), (1, "IP", "mantener", 1)]
    assert R.same_values(months, months) and not R.same_values(months, months.limit(1))


def test_training_sets_and_described_rows(spark):
    cases = Q.parse_annotated(spark.createDataFrame([(1, "hola [[NOMBRE_PERSONA|Ana Gómez]], chau"), (2, "nada que ver")], "case_id int, text string"))
    row = Q.training_statistics(cases).first()
    assert (row.n_cases, row.n_negative, row.by_type) == (2, 1, {"NOMBRE_PERSONA": 1})
    line = K.training_examples(cases, ["persona"]).collect()[0].value
    assert '"tokenized_text":["hola","Ana","Gómez",",","chau"]' in line and '"ner":[{"first":1,"last":2,"label":"NOMBRE_PERSONA"}]' in line
    df = spark.createDataFrame([(0, 5.0, "a", "2025-01-02"), (1, 9.0, "b", "2025-01-03"), (2, 1.0, "c", None)], "_row int, Monto double, Rubro string, Fecha string")
    out = C.describe_rows(C.numeric_summary(df, "Monto", "_row"), df, "_row", "Rubro", "Fecha").first()
    assert (out.max_category, out.max_date, out.min_category, out.min_date) == ("b", "2025-01-03", "c", None)


def test_verdicts_of_a_model_change_findings(spark):
    found = [Finding(0, "ref", "columna", "NOMBRE_PERSONA", "baja", 0.3, 10), Finding(1, "x", "ninguno"), Finding(2, "notas", "ninguno"), Finding(3, "otro", "ninguno")]
    plan = {"ref": "muestra", "x": "muestra", "notas": "texto"}
    votes = spark.createDataFrame([("ref", "RAZON_SOCIAL", 0.8), ("x", "DIRECCION", 0.7)], "column string, type string, ratio double")
    span = "array<struct<type:string,start:int,end:int,value:string>>"
    cells = spark.createDataFrame([("notas", 3, [("NOMBRE_PERSONA", 0, 3, "Ana Paz")]), ("notas", 1, [("DNI", 4, 9, "12345678"), ("NOMBRE_PERSONA", 0, 3, "Leo Sol")])], f"column string, row int, spans {span}")
    out = model.apply_verdicts(found, plan, votes, cells, {"x": 42})
    assert [(f.kind, f.type, f.confidence, f.count, f.action) for f in out] == [("columna", "RAZON_SOCIAL", "media", 10, "seudonimizar"), ("columna", "DIRECCION", "media", 42, "eliminar"), ("texto", None, "media", 3, "seudonimizar"), ("ninguno", None, None, 0, "mantener")]
    assert out[2].text_counts == {"NOMBRE_PERSONA": 2, "DNI": 1} and len(out[2].examples) == 3


def test_generated_tables_are_the_same_on_every_run(spark):
    from sparkveil.sources import generate as G

    ev = G.usage_events(spark, 20, 30, date(2025, 3, 31))
    assert sorted(map(tuple, ev.collect())) == sorted(map(tuple, G.usage_events(spark, 20, 30, date(2025, 3, 31)).repartition(5).collect()))
    assert all(r.day.weekday() < 5 and 9 <= r.hour < 18 for r in ev.collect()) and 0.3 < ev.where("sensitive").count() / ev.count() < 0.5
    det = G.usage_detections(ev)
    assert det.groupBy("event_id", "type").count().where("count > 1").count() == 0 and det.select("event_id").distinct().count() == ev.where("sensitive").count()


def test_a_seeded_stream_goes_on_in_every_partition(spark):
    from sparkveil.operators.scan import scan
    from sparkveil.sources import generate as G

    x, want = 42, []
    for _ in range(3000):
        x = (x * G.FACTOR + G.ADDEND) % (1 << G.STATE_BITS)
        want.append(x)
    for parts in (1, 64):
        got = spark.range(0, 3000, 1, parts).select(G.stream(F.col("id") + 1).alias("x")).collect()
        assert [r.x for r in got] == want
    far = 1 << 40
    a, b = (spark.range(1).select(G.stream(F.lit(far + k)).alias("x")).first().x for k in (0, 1))
    assert b == (a * G.FACTOR + G.ADDEND) % (1 << G.STATE_BITS)
    people = G.people(spark.range(0, 40, 1, 7).withColumnRenamed("id", "n"), "n")
    assert sorted(people.collect()) == sorted(G.people(spark.range(0, 40, 1, 1).withColumnRenamed("id", "n"), "n").collect()) and people.select("name").distinct().count() > 20
    cases = Q.parse_annotated(G.annotated(people, "n"), "n", "text")
    found = Q.outcomes(scan(cases), "n")
    assert found.where("outcome <> 'tp'").count() == 0 and found.count() == 120
    example = K.training_examples(cases, ["NOMBRE_PERSONA", "DNI", "SALARIO"]).first().value
    assert '"NOMBRE_PERSONA"' in example and '"La"' in example
