"""Workbooks in both formats there and back, and PDF files that the tests build."""

import random
import zipfile
import zlib
from datetime import date

import pytest
from pyspark.sql import functions as F

from sparkveil.operators import files
from sparkveil.sources import office as O
from sparkveil.sources import pdf as P

MAIN, REL = O._MAIN, O._REL


def rows(spark, path):
    return [(r.sheet, r.cells) for r in O.read_workbooks(spark, str(path)).orderBy("sheet", "row_id").collect()]


def xlsx(path, body, styles="", book=""):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}">{book}<sheets><sheet name="uno" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><t>Alta</t></si><si><r><t>dos </t></r><r><t>partes</t></r></si></sst>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}">{styles}</styleSheet>')


def ods(path, body):
    names = " ".join(f'xmlns:{k}="urn:oasis:names:tc:opendocument:xmlns:{k}:1.0"' for k in ("table", "office", "text"))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("mimetype", "application/vnd.oasis.opendocument.spreadsheet")
        z.writestr("content.xml", f'<office:document-content {names}><office:body><office:spreadsheet><table:table table:name="uno">{body}</table:table></office:spreadsheet></office:body></office:document-content>')


def test_both_formats_give_equal_tables(spark, tmp_path):
    styles = '<numFmts><numFmt numFmtId="164" formatCode="dd\\-mm\\-yyyy"/><numFmt numFmtId="165" formatCode="0.00 &quot;días&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'
    row = lambda *c: "<row>" + "".join(c) + "</row>"
    body = row('<c r="A1" t="s"><v>0</v></c>', '<c r="B1" t="inlineStr"><is><t>n</t></is></c>', '<c r="D1" t="s"><v>1</v></c>')
    body += row('<c r="A2" s="1"><v>45292</v></c>', '<c r="B2"><v>45292</v></c>', '<c r="D2" t="b"><v>1</v></c>')
    body += row() + row('<c r="A4" s="2"><v>45292.75</v></c>', '<c r="B4" s="3"><v>3.5</v></c>', '<c r="C4" t="inlineStr"><is><t>x</t></is></c>') * 1
    body += row('<c r="A5" s="1"><v>59</v></c>', '<c r="B5"><v>7</v></c>') + row('<c r="A6" s="1"><v>59</v></c>', '<c r="B6"><v>7</v></c>')
    xlsx(tmp_path / "a.xlsx", body, styles)
    text = lambda v: f'<table:table-cell office:value-type="string"><text:p>{v}</text:p></table:table-cell>'
    value = lambda kind, v, n=1: f'<table:table-cell office:value-type="{kind}" office:{"date-" if kind == "date" else "boolean-" if kind == "boolean" else ""}value="{v}" table:number-columns-repeated="{n}"/>'
    row = lambda *c, n=1: f'<table:table-row table:number-rows-repeated="{n}">' + "".join(c) + "</table:table-row>"
    gap = '<table:table-cell table:number-columns-repeated="{}"/>'.format
    body = row(text("Alta"), text("n"), gap(1), text('dos<text:s text:c="1"/>partes'), gap(16000))
    body += row(value("date", "2024-01-01"), value("float", "45292"), gap(1), value("boolean", "true")) + row(gap(1024), n=1) + row(value("date", "2024-01-01T18:00:00"), value("float", "3.5"), text("x"))
    body += row(value("date", "1900-02-28"), value("float", "7"), n=2) + row(gap(1024), n=1_000_000)
    ods(tmp_path / "a.ods", body)
    want = [("uno", ["Alta", "n", None, "dos partes"]), ("uno", ["2024-01-01", "45292", None, "true"]), ("uno", ["2024-01-01", "3.5", "x"]), ("uno", ["1900-02-28", "7"]), ("uno", ["1900-02-28", "7"])]
    assert rows(spark, tmp_path / "a.xlsx") == want and rows(spark, tmp_path / "a.ods") == want


def test_what_a_format_shows_and_day_counts():
    assert [O.shows_days(x) for x in ("yyyy-mm-dd", "[$-2C0A]d mmm", "[h]:mm", "General", '0.00 "days"', "#,##0\\d", "0.00E+00", "[Red]0;dd")] == [True, True, True, False, False, False, False, False]
    assert [O.day("60"), O.day("61"), O.day("1"), O.day("45292.9"), O.day("0.5"), O.day("x"), O.day("1e12"), O.day("0", True)] == ["1900-02-28", "1900-03-01", "1900-01-01", "2024-01-01", "0.5", "x", "1e12", "1904-01-01"]


def test_days_counted_from_1904(spark, tmp_path):
    xlsx(tmp_path / "b.xlsx", '<row><c s="0"><v>1</v></c></row>', '<cellXfs><xf numFmtId="22"/></cellXfs>', '<workbookPr date1904="1"/>')
    assert rows(spark, tmp_path / "b.xlsx") == [("uno", ["1904-01-02"])]


def test_a_workbook_there_and_back(spark, tmp_path):
    rng = random.Random(1)
    odd = ["", " a ", "<&>\"'", "línea\ny\totra", "\x01\x1f\r\n", "_x0041_ y _x005F_", "é🙂", "007", "1.0", None, "x" * 40_000]
    data = [(k, rng.choice(odd), "v") for k in range(300)]
    text = spark.createDataFrame(data, "_row long, `a.b` string, w string").repartition(7)
    typed = spark.createDataFrame([(0, date(2024, 2, 29), 1.5, True, 7), (1, None, 3.0, False, None), (2, date(1899, 1, 1), float("nan"), None, -1)], "_row long, d date, x double, b boolean, n long")
    empty = spark.createDataFrame([], "_row long, `solo` string")
    O.write_workbook({"uno/dos": text, "t" * 40: typed, "T" * 40: empty}, f"file://{tmp_path}/w.xlsx")
    assert [p.name for p in tmp_path.iterdir()] == ["w.xlsx"]
    got = rows(spark, tmp_path / "w.xlsx")
    assert [c for s, c in got if s == "uno dos"] == [["a.b", "w"]] + [[r[1], "v"] for r in data]
    assert [c for s, c in got if s == "t" * 31] == [["d", "x", "b", "n"], ["2024-02-29", "1.5", "true", "7"], [None, "3", "false", None], ["1899-01-01", "NaN", None, "-1"]]
    assert [c for s, c in got if s == "T" * 27 + " (2)"] == [["solo"]]
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        assert z.testzip() is None and {"[Content_Types].xml", "_rels/.rels", "xl/styles.xml", "xl/worksheets/sheet3.xml"} <= set(z.namelist())


def test_a_workbook_that_is_too_large_leaves_nothing(spark, tmp_path, monkeypatch):
    with pytest.raises(ValueError, match="columns"):
        O.write_workbook({"x": spark.range(1).select(*[F.lit(1).alias(f"c{k}") for k in range(16_385)])}, str(tmp_path / "w.xlsx"))
    with pytest.raises(Exception, match="rows in sheet"):
        O.write_workbook({"x": spark.range(1_048_576)}, str(tmp_path / "w.xlsx"))
    assert list(tmp_path.iterdir()) == []


def test_a_workbook_in_a_protected_workbook_out(spark, tmp_path):
    df = spark.createDataFrame([(k, f"u{k}@mail.example.com", k) for k in range(20)], "_row long, Correo string, n int")
    O.write_workbook({"gente": df, "vacía": df.limit(0)}, str(tmp_path / "in.xlsx"))
    review = files.review_file(spark, str(tmp_path / "in.xlsx"))
    files.write_file(review, files.protect_file(review), str(tmp_path / "out"))
    got = rows(spark, tmp_path / "out/in.xlsx")
    assert got == [("gente", ["Correo", "n"])] + [("gente", ["***@mail.example.com", str(k)]) for k in range(20)]


def build(objects, root=1, packed=False, broken=False):
    """A PDF of numbered objects (bytes, or a pair of head and stream), with a table of them or a stream of it."""
    out, where = bytearray(b"%PDF-1.5\n%\xe2\xe3\n"), {}
    inside = {n: x for n, x in objects.items() if packed and not isinstance(x, tuple)}
    objects = {n: x for n, x in objects.items() if n not in inside}
    if inside:
        parts, places, at = b"", [], 0
        for n, x in inside.items():
            places += [n, len(parts)]
            parts += x + b" "
        first = " ".join(map(str, places)).encode() + b"\n"
        objects[90] = (f"/Type /ObjStm /N {len(inside)} /First {len(first)}".encode(), first + parts)
    for n, x in objects.items():
        where[n] = len(out)
        if isinstance(x, tuple):
            data = zlib.compress(x[1])
            x = b"<<" + x[0] + b" /Filter /FlateDecode /Length " + str(len(data)).encode() + b">>\nstream\n" + data + b"\nendstream"
        out += f"{n} 0 obj\n".encode() + x + b"\nendobj\n"
    at = len(out)
    if packed:
        size = 92
        table = b"".join((b"\x01" + where[n].to_bytes(3, "big") + b"\0" if n in where else b"\x02" + (90).to_bytes(3, "big") + bytes([list(inside).index(n)]) if n in inside else b"\0" * 5) for n in range(size))
        predicted, before = b"", bytes(5)
        for k in range(0, len(table), 5):
            predicted += b"\x02" + bytes((a - b) & 255 for a, b in zip(table[k : k + 5], before, strict=True))
            before = table[k : k + 5]
        data = zlib.compress(predicted)
        out += f"91 0 obj\n<</Type /XRef /Size {size} /W [1 3 1] /Root {root} 0 R /Filter /FlateDecode /DecodeParms <</Predictor 12 /Columns 5>> /Length {len(data)}>>\nstream\n".encode() + data + b"\nendstream\nendobj\n"
    else:
        out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(f"{n} 1\n{o:010} 00000 n \n".encode() for n, o in where.items())
        out += f"trailer\n<</Size 99 /Root {root} 0 R>>\n".encode()
    return bytes(out + f"startxref\n{at + 7 if broken else at}\n%%EOF".encode())


FONT = b"<</Type /Font /Subtype /Type1 /Encoding <</BaseEncoding /WinAnsiEncoding /Differences [1 /eacute /ntilde /uni20AC]>>>>"
CMAP = b"1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfrange <0001> <0003> <0041> <0010> <0011> [<00e9> <d83dde42>] endbfrange 1 beginbfchar <0020> <0020> endbfchar"


def document(*contents, extra=None):
    objects = {1: b"<</Type /Catalog /Pages 2 0 R>>", 3: FONT, 4: b"<</Subtype /Type0 /ToUnicode 5 0 R /DescendantFonts [<</DW 500>>]>>", 5: (b"", CMAP), 6: (b"/Subtype /Form", b"BT /A 9 Tf (del formulario) Tj ET")}
    kids = []
    for k, c in enumerate(contents):
        objects |= {20 + 2 * k: f"<</Type /Page /Parent 2 0 R /Contents {21 + 2 * k} 0 R>>".encode(), 21 + 2 * k: (b"", c)}
        kids.append(f"{20 + 2 * k} 0 R")
    objects[2] = f"<</Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} /Resources <</Font <</A 3 0 R /B 4 0 R>> /XObject <</X 6 0 R>>>>>>".encode()
    return objects | (extra or {})


PAGE = rb"""BT /A 12 Tf 14 TL 72 700 Td (Se\361ora \(Ana\) G\363mez) Tj T* [(pal) -20 (abra) -600 (otra)] TJ (siguiente l\
inea) ' ET % nota
BT /B 10 Tf 1 0 0 1 72 600 Tm <000100020020> Tj <0010 0011> Tj ET BT /A 12 Tf 72 500 Td <010203> Tj ET /X Do"""
WANT = "Señora (Ana) Gómez\npalabra otra\nsiguiente linea\nAB é🙂\néñ€\ndel formulario"


def test_text_of_pages(spark, tmp_path):
    second = b"BT /A 12 Tf 10 10 Td (segunda) Tj ET BI /W 1 ID \x00(\xff EI BT /A 12 Tf 10 50 Td (imagen antes) Tj ET"
    (tmp_path / "a.pdf").write_bytes(build(document(PAGE, b"", second)))
    (tmp_path / "b.pdf").write_bytes(build(document(PAGE, b"", second), packed=True))
    (tmp_path / "c.pdf").write_bytes(build(document(PAGE, b"", second), broken=True))
    got = P.read_pdfs(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r.pages, r.text, r.error) for r in got] == [(3, WANT + "\n\n\n\nsegunda\nimagen antes", None)] * 3


def test_files_without_text(spark, tmp_path):
    cases = {"corto": build(document(b"BT /A 9 Tf (poco) Tj ET")), "imagen": build(document(b"/Im Do")), "otro": b"PK\x03\x04 no", "cabecera": b"%PDF-1.4\n%%EOF", "ciclo": build({1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [2 0 R 2 0 R]>>"})}
    cases["clave"] = build(document(PAGE)).replace(b"/Size 99", b"/Encrypt 9 0 R /Size 99")
    for name, data in cases.items():
        (tmp_path / f"{name}.pdf").write_bytes(data)
    got = {r.path.rsplit("/", 1)[1][:-4]: (r.text, r.error) for r in P.read_pdfs(spark, str(tmp_path)).collect()}
    assert got == {k: (None, "no_text" if k in ("corto", "imagen") else "encrypted" if k == "clave" else "broken") for k in cases}
    with pytest.raises(ValueError, match="no_text"):
        files.review_file(spark, str(tmp_path / "corto.pdf"))


def test_damaged_files_give_rows_not_errors():
    rng, whole = random.Random(7), build(document(PAGE, PAGE), packed=True)
    plain = build(document(PAGE, PAGE))
    for k in range(300):
        data = bytearray(rng.choice((whole, plain)))
        for _ in range(rng.randint(1, 12)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        if k % 3 == 0:
            del data[rng.randrange(len(data)) :]
        assert list(P.pages_of(bytes(data)))


def test_a_pdf_is_reviewed_and_protected(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(build(document(b"BT /A 12 Tf 72 700 Td (Escribir a u1@mail.example.com) Tj 0 -20 Td (hoy sin falta) Tj ET")))
    review = files.review_file(spark, str(tmp_path / "a.pdf"))
    assert files.file_totals(review) == {"EMAIL": 1}
    files.write_file(review, files.protect_file(review), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).strip() == "Escribir a ***@mail.example.com\nhoy sin falta"


def test_a_folder_of_workbooks(spark, tmp_path, monkeypatch):
    O.write_workbook_parts(spark.range(100).repartition(3).select("id", F.concat(F.lit("v"), "id").alias("v")), str(tmp_path / "f"))
    O.write_workbook_parts(spark.range(100, 103).select("id", F.lit("w").alias("v")).coalesce(1), str(tmp_path / "f"))
    assert len(list((tmp_path / "f").iterdir())) == 4 and [p.name for p in tmp_path.iterdir()] == ["f"]
    got = O.read_workbooks(spark, str(tmp_path / "f")).collect()
    assert sum(r.cells == ["id", "v"] and r.row_id == 0 for r in got) == 4
    assert sorted(int(r.cells[0]) for r in got if r.row_id) == list(range(103))
