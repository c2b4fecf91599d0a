"""Readers, writers and streams: round trips and small files made here."""

import io
import zipfile
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkveil.sources import readers as S
from sparkveil.sources import writers as K
from sparkveil.streaming import ingest, state


def test_csv_of_either_encoding_and_ragged_rows(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("Fecha;;Nombre\n2025-01-01;x;Ana\n\n;;\n2025-01-02;y\n", encoding="utf-8")
    df = S.read_csv(spark, str(path))
    assert df.columns == ["_row", "Fecha", "Columna 2", "Nombre"]
    assert [tuple(r) for r in df.orderBy("_row").collect()] == [(0, "2025-01-01", "x", "Ana"), (1, "2025-01-02", "y", None)]
    (tmp_path / "a.txt").write_bytes("¿Año? €".encode("cp1252"))
    (tmp_path / "b.txt").write_bytes("﻿Año €".encode())
    got = {r.path[-5:]: r.text for r in S.read_texts(spark, str(tmp_path / "*.txt")).collect()}
    assert got == {"a.txt": "¿Año? €", "b.txt": "Año €"}
    assert S.header_names(["a", "", "a", None]) == ["a", "Columna 2", "a (2)", "Columna 4"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'x;"y"', datetime(2025, 1, 2)), (0, None, None)], "_row int, t string, d timestamp")
    K.write_csv(df, str(tmp_path / "out"), ";")
    back = S.read_csv(spark, str(tmp_path / "out"), ";").where("t is not null").collect()
    assert [(r.t, r.d) for r in back] == [('x;"y"', "2025-01-02")]


def test_json_table_and_leaves(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"b": "x", "a": 1}, {"a": 2.5, "c": null}]')
    df = S.read_json_table(spark, str(tmp_path / "t.json"))
    assert df.columns == ["_row", "b", "a", "c"] and [tuple(r) for r in df.orderBy("_row").collect()] == [(0, "x", "1", None), (1, None, "2.5", None)]
    docs = spark.createDataFrame([(1, '{"cliente": {"contacto": {"nombre": "Ana"}}, "n": [5, true, null, "z"]}'), (2, "no json"), (3, None), (4, '"solo"')], "id int, json string")
    leaves = S.json_leaves(docs, "json", "id")
    got = {(r.id, r.seg_id): (r.text, r.hint, r.context) for r in leaves.collect()}
    assert got == {(1, 0): ("Ana", "nombre", "contacto"), (1, 1): ("5", "n", None), (1, 2): ("z", "n", None), (4, 0): ("solo", None, None)}
    changed = leaves.withColumn("protected", F.when(F.col("text") == "Ana", "Persona_01").otherwise(F.col("text")))
    back = {r.id: r.json for r in K.rebuild_json(docs, changed, "id").collect()}
    assert back[1] == '{"cliente": {"contacto": {"nombre": "Persona_01"}}, "n": [5, true, null, "z"]}' and back[2] == "no json" and back[3] is None and back[4] == '"solo"'
    assert [r.value for r in K.json_rows(df).collect()][0] == '{"b":"x","a":"1","c":null}'


def test_html_tables(spark):
    page = "<table><tr><th>A</th><th>B</th></tr><tr><td><p>x</p><p>y</p></td><td>1&lt;2 &#225; &#xE9; &amp;lt;</td></tr><tr><td> </td></tr></table><TABLE><tr><td>solo</td></tr></TABLE>"
    df = spark.createDataFrame([(1, page), (2, "sin tablas"), (3, None)], "id int, html string")
    got = [(r.id, r.table_id, r.row_id, r.cells) for r in S.html_tables(df, "id").orderBy("table_id", "row_id").collect()]
    assert got == [(1, 0, 0, ["A", "B"]), (1, 0, 1, ["x y", "1<2 á é &lt;"]), (1, 1, 0, ["solo"])]
    assert S.html_tables(df, "id", least_columns=2, least_rows=2).count() == 2


def test_office_files(spark, tmp_path):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Hoja" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Nombre</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Monto</t></is></c></row><row r="3"><c r="C3"><v>45000</v></c></row></sheetData></worksheet>')
    got = [(r.sheet, r.cells) for r in S.read_workbooks(spark, str(tmp_path / "*.xlsx")).orderBy("row_id").collect()]
    assert got == [("Hoja", ["Nombre", None, "Monto"]), ("Hoja", [None, None, "45000"])]
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hola</w:t></w:r></w:p><w:tbl><w:tr>{cell("A")}{cell("B &amp; C")}</w:tr></w:tbl></w:body></w:document>')
    row = S.read_docx(spark, str(tmp_path / "*.docx")).first()
    assert row.text.startswith("Hola") and "<td>B &amp; C</td>" in row.html and io is not None
    files = spark.createDataFrame([("a/b.csv", 10), ("a/c.doc", 10), ("a/d.PDF", 1), ("x.xlsx", 60_000_000)], "path string, length long")
    assert [r.accepted for r in S.gate(files).collect()] == [True, False, True, False]


def test_equivalences_in_the_clear_and_encrypted(spark, tmp_path):
    table = spark.createDataFrame([("Persona_01", "Ana Gómez", "Persona"), ("Empresa_02", "Roca", "Empresa")], "pseudonym string, original string, prefix string")
    K.write_equivalences(table, str(tmp_path / "eq"))
    assert sorted((r.pseudonym, r.original, r.grp) for r in S.read_equivalences(spark, str(tmp_path / "eq")).collect()) == sorted(tuple(r) for r in table.collect())
    secret = K.encrypt_rows(table, "clave", iterations=1000)
    rows = secret.collect()
    assert "Ana" not in str(rows)
    kept = spark.createDataFrame(rows, secret.schema)
    assert sorted(map(tuple, K.decrypt_rows(kept, "clave", "pseudonym string, original string, prefix string").collect())) == sorted(tuple(r) for r in table.collect())
    with pytest.raises(Exception):
        K.decrypt_rows(kept, "otra", "pseudonym string, original string, prefix string").collect()


def test_row_numbers_are_dense(spark):
    df = spark.range(100, numPartitions=7).where("id % 3 = 0")
    rows = S.add_row_number(df).orderBy("id").collect()
    assert [r._row for r in rows] == list(range(len(rows)))


def run_stream(spark, df, tmp_path, name, build, mode="append"):
    source = tmp_path / f"{name}-in"
    df.coalesce(1).write.parquet(str(source))
    stream = build(spark.readStream.schema(df.schema).parquet(str(source)))
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_event_windows(spark, tmp_path):
    rows = [(1, "a", datetime(2025, 1, 1, 1), 2.0), (1, "a", datetime(2025, 1, 1, 1), 2.0), (2, "a", datetime(2025, 1, 1, 2), 3.0), (3, "b", datetime(2025, 1, 2, 1), 1.0)]
    df = spark.createDataFrame(rows, "event_id int, event_type string, ts timestamp, value double")
    got = run_stream(spark, df, tmp_path, "wins", lambda s: ingest.windowed_counts(ingest.deduplicated(s), late=None), "complete")
    assert sorted((r.event_type, r.events, r.total) for r in got.collect()) == [("a", 2, 5.0), ("b", 1, 1.0)]


def test_a_conversation_shares_its_registry(spark, tmp_path):
    span = lambda s, e, v, p="Persona": (s, e, "NOMBRE_PERSONA", v, p, None)
    rows = [(1, 0, "Ana Gómez y Luis", [span(0, 9, "Ana Gómez"), span(12, 16, "Luis")]), (1, 1, "Gómez otra vez", [span(0, 5, "Gómez")]), (2, 0, "Eva", [span(0, 3, "Eva")]), (2, 1, None, [])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, spans array<struct<start:int,end:int,type:string,value:string,prefix:string,token:string>>")
    got = {(r.conv_id, r.turn): r.protected for r in run_stream(spark, df, tmp_path, "chat", state.protect_chat).collect()}
    assert got == {(1, 0): "Persona_01 y Persona_02", (1, 1): "Persona_01 otra vez", (2, 0): "Persona_01", (2, 1): None}


def test_rate_limits_are_anchored_at_the_first_hit(spark, tmp_path):
    at = lambda s: datetime(2025, 1, 1, 0, 0, s)
    df = spark.createDataFrame([("k", at(5)), ("k", at(6)), ("k", at(7)), ("k", at(16)), ("z", at(7))], "key string, ts timestamp")
    got = {(r.key, r.ts.second): r.allowed for r in run_stream(spark, df, tmp_path, "limits", lambda s: state.rate_limit(s, 2, 10)).collect()}
    assert got == {("k", 5): True, ("k", 6): True, ("k", 7): False, ("k", 16): True, ("z", 7): True}
    hits = pd.DataFrame({"ts": pd.to_datetime(["2025-01-01 00:00:01", "2025-01-01 00:00:02"])})
    assert state.allow_hits(hits, None, 0, 1, 5)[0] == [True, False]


def test_steps_are_not_replayed(spark, tmp_path):
    df = spark.createDataFrame([("u", 5), ("u", 5), ("u", 4), ("u", 6)], "key string, step long")
    got = run_stream(spark, df, tmp_path, "steps", state.replay_guard).collect()
    assert sorted((r.step, r.accepted) for r in got) == [(4, False), (5, False), (5, True), (6, True)]


def test_a_full_limiter_refuses_new_keys(spark, tmp_path):
    at = lambda s: datetime(2025, 1, 1, 0, 0, s)
    df = spark.createDataFrame([("a", at(1)), ("b", at(2)), ("c", at(3)), ("a", at(4)), ("c", at(12)), ("c", at(13))], "key string, ts timestamp")
    got = {(r.key, r.ts.second): r.allowed for r in run_stream(spark, df, tmp_path, "bounded", lambda s: state.rate_limit_bounded(s, 1, 10, most_keys=2, shards=1)).collect()}
    assert got == {("a", 1): True, ("b", 2): True, ("c", 3): False, ("a", 4): False, ("c", 12): True, ("c", 13): False}


def test_revoked_tokens_are_refused_until_they_end(spark, tmp_path):
    at = lambda s: datetime(2025, 1, 1, 0, 0, s)
    df = spark.createDataFrame([("t", at(1), False), ("t", at(2), True), ("t", at(3), False), ("t", at(30), False), ("u", at(3), False)], "token string, ts timestamp, revoke boolean")
    got = {(r.token, r.ts.second): r.valid for r in run_stream(spark, df, tmp_path, "revoked", lambda s: state.revoked_tokens(s, 20)).collect()}
    assert got == {("t", 1): True, ("t", 3): False, ("t", 30): True, ("u", 3): True}


def test_latest_counts_of_changed_groups(spark, tmp_path):
    rows = [(k, "ab"[k % 2], datetime(2025, 1, 1 + k % 3, 1), 1.0) for k in range(30)]
    df = spark.createDataFrame(rows, "event_id int, event_type string, ts timestamp, value double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = ingest.windowed_counts(ingest.deduplicated(stream, late="30 days"), late=None)
    ingest.keep_latest(counts, str(tmp_path / "rows"), str(tmp_path / "cp")).awaitTermination()
    got = ingest.latest_counts(spark, str(tmp_path / "rows"), ["start", "event_type"], ["events", "total"], counts.schema)
    assert sorted((r.start.day, r.event_type, r.events) for r in got.collect()) == sorted((d, t, 5) for d in (1, 2, 3) for t in "ab")
