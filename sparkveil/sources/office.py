"""Workbooks: .xlsx and .ods in, .xlsx out.

Reading unpacks one file in a task, row by row. Writing builds the XML of each row with Spark expressions; tasks write the
rows of their range as parts beside the target, and the commit puts the parts into one zip, so nothing but the names of
parts passes through the driver's memory. A table too large for one file becomes a folder of workbooks, one or more a task.
Targets lie in a store that pyarrow opens by its URI (local, hdfs, s3, gs).

Defined cases: days come out as ``YYYY-MM-DD`` (a time of day alone stays a number), truth values as ``true`` and ``false``;
blank rows are left out; repeated cells and rows of .ods are written out, but never the blank ones at the end; characters
that XML doesn't have are escaped and come back. Sheet names are cut to 31 characters and kept apart by a number. A sheet
of more rows or columns than the format holds is an error, and then no file is left behind.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from typing import IO
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Built-in number formats that show a day or a time, and limits of the format. Fixed values.
DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))
MOST_ROWS, MOST_COLUMNS, MOST_NAME = 1_048_576, 16_384, 31
DEFAULT_SHEET = "Datos"

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_ODF = "{urn:oasis:names:tc:opendocument:xmlns:"
Row = tuple[str, int, list[str | None]]


def _elements(z: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of one tag as they end; those before are forgotten."""
    with z.open(name) as f:
        parents: list[ElementTree.Element] = []
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                parents.append(e)
                continue
            parents.pop()
            if e.tag == tag:
                yield e
                if parents:
                    parents[-1].remove(e)


def shows_days(code: str) -> bool:
    """Whether a number format writes days or times: it has a part of one outside of quotes, escapes and brackets."""
    plain = re.sub(r'"[^"]*"|[\\_*].|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code.lower().split(";")[0])
    return plain != "general" and re.search("[ymdhs]", plain) is not None


def day(serial: str, since_1904: bool = False) -> str:
    """A day count as a day; what is no day stays."""
    try:
        n = int(float(serial))
        start = date(1904, 1, 1) if since_1904 else date(1899, 12, 30) if n >= 60 else date(1899, 12, 31)  # 1900 counts a leap day that was none
        return serial if n < (0 if since_1904 else 1) else (start + timedelta(n)).isoformat()
    except (ValueError, OverflowError):
        return serial


def _plain(text: str) -> str:
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def _date_styles(z: zipfile.ZipFile) -> list[bool]:
    """By number of a cell's style: whether it shows days."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): shows_days(f.get("formatCode", "")) for f in root.iter(f"{{{_MAIN}}}numFmt")}
    cells = root.find(f"{{{_MAIN}}}cellXfs")
    numbers = [int(x.get("numFmtId", 0)) for x in cells] if cells is not None else []
    return [own.get(n, n in DATE_FORMATS) for n in numbers]


def _xlsx(z: zipfile.ZipFile) -> Iterator[Row]:
    text = lambda e: _plain("".join(t.text or "" for t in e.iter(f"{{{_MAIN}}}t")))
    shared = [text(si) for si in _elements(z, "xl/sharedStrings.xml", f"{{{_MAIN}}}si")] if "xl/sharedStrings.xml" in z.namelist() else []
    styles, targets = _date_styles(z), {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    settings = book.find(f"{{{_MAIN}}}workbookPr")
    since_1904 = settings is not None and settings.get("date1904") in ("1", "true")

    def value(c: ElementTree.Element) -> str | None:
        kind, raw = c.get("t", "n"), c.findtext(f"{{{_MAIN}}}v")
        if kind == "inlineStr":
            return text(c)
        if raw is None:
            return None
        if kind == "s":
            return shared[int(raw)]
        if kind == "b":
            return "true" if raw == "1" else "false"
        if kind == "d":
            return raw[:10]
        style = int(c.get("s", 0))
        return day(raw, since_1904) if kind == "n" and style < len(styles) and styles[style] else _plain(raw)

    for sheet in book.iter(f"{{{_MAIN}}}sheet"):
        target = targets[sheet.get(f"{{{_REL}}}id")].lstrip("/")
        for k, row in enumerate(_elements(z, target if target.startswith("xl/") else f"xl/{target}", f"{{{_MAIN}}}row")):
            cells: dict[int, str | None] = {}
            for c in row.iter(f"{{{_MAIN}}}c"):
                letters = re.match("[A-Z]+", c.get("r", ""))
                at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                cells[at] = value(c)
            yield sheet.get("name"), k, [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def _ods(z: zipfile.ZipFile) -> Iterator[Row]:
    table, office, words = (f"{_ODF}{x}:1.0}}" for x in ("table", "office", "text"))

    def text(p: ElementTree.Element) -> str:
        out = p.text or ""
        for e in p:
            out += " " * int(e.get(f"{words}c", 1)) if e.tag == f"{words}s" else "\t" if e.tag == f"{words}tab" else "\n" if e.tag == f"{words}line-break" else "" if e.tag == f"{office}annotation" else text(e)
            out += e.tail or ""
        return out

    def value(c: ElementTree.Element) -> str | None:
        kind = c.get(f"{office}value-type")
        if kind == "date":
            return c.get(f"{office}date-value", "")[:10]
        if kind == "boolean":
            return c.get(f"{office}boolean-value")
        if kind in ("float", "currency", "percentage"):
            return c.get(f"{office}value")
        found = [text(p) for p in c.findall(f"{words}p")]
        return "\n".join(found) if found else c.get(f"{office}string-value")

    # A row is met before its table has ended, so the name comes from the start of it.
    name, k = "", 0
    with z.open("content.xml") as f:
        parents: list[ElementTree.Element] = []
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                parents.append(e)
                if e.tag == f"{table}table":
                    name, k = e.get(f"{table}name", ""), 0
                continue
            parents.pop()
            if e.tag != f"{table}table-row":
                continue
            cells: list[str | None] = []
            blank = 0
            for c in e:
                if c.tag in (f"{table}table-cell", f"{table}covered-table-cell"):
                    n, v = int(c.get(f"{table}number-columns-repeated", 1)), value(c)
                    if v is None:
                        blank += n
                    else:
                        cells += [None] * blank + [v] * n
                        blank = 0
            times = int(e.get(f"{table}number-rows-repeated", 1))
            for i in range(times if any((v or "").strip() for v in cells) else 0):
                yield name, k + i, list(cells)
            k += times
            if parents:
                parents[-1].remove(e)


def sheets(data: bytes) -> Iterator[Row]:
    """(sheet, row number, cells) of the rows of a workbook that aren't blank."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for row in _ods(z) if "content.xml" in z.namelist() else _xlsx(z):
            if any((v or "").strip() for v in row[2]):
                yield row


def read_workbooks(spark: SparkSession, path: str, at_once: int = 4096) -> DataFrame:
    """(path, sheet, row_id, cells) of all rows of .xlsx and .ods files; the first row of a sheet is its header."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, data in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for r in sheets(bytes(data)):
                    rows.append((p, *r))
                    if len(rows) == at_once:
                        yield pd.DataFrame(rows, columns=["path", "sheet", "row_id", "cells"])
                        rows = []
                yield pd.DataFrame(rows, columns=["path", "sheet", "row_id", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, sheet string, row_id int, cells array<string>")


def sheet_names(names: list[str]) -> list[str]:
    """Names that a workbook takes: without the signs it refuses, cut, and apart whatever their case."""
    out: list[str] = []
    for n in names:
        base = re.sub(r"[\[\]:*?/\\\0-\x1f]", " ", n).strip().strip("'") or DEFAULT_SHEET
        name, k = base[:MOST_NAME], 2
        while name.lower() in {x.lower() for x in out}:
            mark = f" ({k})"
            name, k = base[: MOST_NAME - len(mark)] + mark, k + 1
        out.append(name)
    return out


_CONTROL = "[\\x00-\\x08\\x0b-\\x1f\\x{FFFE}\\x{FFFF}]"


def _escaped(text: Column) -> Column:
    """Text as XML: markup, what looks like an escape, and characters that XML doesn't have."""
    s = F.regexp_replace(text, "_(x[0-9A-Fa-f]{4}_)", "_x005F_$1")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(char), F.lit(name))
    hexed = lambda c: F.concat(F.lit("_x"), F.lpad(F.hex(F.ascii(c)), 4, "0"), F.lit("_"))
    spelled = F.array_join(F.transform(F.split(s, ""), lambda c: F.when(c.rlike(_CONTROL), hexed(c)).otherwise(c)), "")
    return F.when(s.rlike(_CONTROL), spelled).otherwise(s)


def _cell(df: DataFrame, name: str) -> Column:
    c, kind = F.col(f"`{name}`"), dict(df.dtypes)[name]
    number = lambda x: F.concat(F.lit("<c><v>"), x, F.lit("</v></c>"))
    string = F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), _escaped(c.cast("string")), F.lit("</t></is></c>"))
    if kind in ("date", "timestamp", "timestamp_ntz"):
        n = F.datediff(c.cast("date"), F.lit("1899-12-30").cast("date"))
        iso = F.concat(F.lit('<c t="inlineStr"><is><t>'), F.date_format(c, "yyyy-MM-dd"), F.lit("</t></is></c>"))
        out = F.when(n >= 61, F.concat(F.lit('<c s="1"><v>'), n.cast("string"), F.lit("</v></c>"))).otherwise(iso)
    elif kind == "boolean":
        out = F.concat(F.lit('<c t="b"><v>'), c.cast("int").cast("string"), F.lit("</v></c>"))
    elif kind in ("double", "float"):
        whole = (F.abs(c) < 1e15) & (c == F.floor(c))
        out = F.when(F.isnan(c) | (F.abs(c) == float("inf")), string).when(whole, number(c.cast("decimal(16,0)").cast("string"))).otherwise(number(c.cast("string")))
    elif kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        out = number(c.cast("string"))
    else:
        out = string
    return F.coalesce(out, F.lit("<c/>"))


def _row(cells: list[Column]) -> Column:
    return F.concat(F.lit("<row>"), *cells, F.lit("</row>")).alias("xml")


def _head(spark: SparkSession, names: list[str]) -> DataFrame:
    """One row: that of the column names."""
    head = spark.range(1).select(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(names)])
    return head.select(_row([_cell(head, c) for c in head.columns]))


def write_workbook_parts(df: DataFrame, path: str, sheet: str = DEFAULT_SHEET) -> None:
    """A table of any size as a folder of workbooks with one sheet each: every task writes its own rows, in their order, and
    begins another file where a sheet is full. ``read_workbooks`` reads the folder."""
    if len(df.columns) > MOST_COLUMNS:
        raise ValueError(f"over {MOST_COLUMNS} columns")
    df.sparkSession.dataSource.register(WorkbookSource)
    head = _head(df.sparkSession, df.columns).first()["xml"]
    rows = df.select(F.lit(0).alias("sheet"), _row([_cell(df, c) for c in df.columns]))
    rows.write.format(WorkbookSource.name()).option("sheets", json.dumps(sheet_names([sheet]))).option("head", head).mode("append").save(path)


def write_workbook(tables: dict[str, DataFrame], path: str, order: str = "_row") -> None:
    """Tables as the sheets of one .xlsx file, with their column names in the first row and rows in the order of ``order``
    (which is left out; without it rows are in reading order)."""
    from .readers import add_row_number

    row, rows = _row, None
    for k, (name, df) in enumerate(zip(sheet_names(list(tables)), tables.values(), strict=True)):
        shown = [c for c in df.columns if c != order]
        if len(shown) > MOST_COLUMNS:
            raise ValueError(f"over {MOST_COLUMNS} columns in sheet {name}")
        df = df if order in df.columns else add_row_number(df, order)
        head = _head(df.sparkSession, shown).select(F.lit(k).alias("sheet"), F.lit(None).cast("long").alias("at"), "xml")
        body = df.select(F.lit(k).alias("sheet"), F.col(f"`{order}`").cast("long").alias("at"), row([_cell(df, c) for c in shown]))
        rows = head.union(body) if rows is None else rows.union(head).union(body)
    if rows is None:
        raise ValueError("no sheets")
    rows.sparkSession.dataSource.register(WorkbookSource)
    placed = rows.repartitionByRange("sheet", "at").sortWithinPartitions("sheet", "at").select("sheet", "xml")
    placed.write.format(WorkbookSource.name()).option("sheets", json.dumps(sheet_names(list(tables)))).mode("overwrite").save(path)


@dataclass
class Parts(WriterCommitMessage):
    #: Of a task: its partition, and of each sheet its rows and the file that holds them.
    partition: int
    files: list[tuple[int, int, str]]


class WorkbookSource(DataSource):
    """Rows (sheet, xml), in order, as one workbook."""

    @classmethod
    def name(cls) -> str:
        return "sparkveil_xlsx"

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options["path"], json.loads(self.options["sheets"]), self.options.get("head"))


class WorkbookWriter(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str], head: str | None = None) -> None:
        self.path, self.names, self.head = path, names, head  # with a head, a folder of workbooks that begin with it
        self.parts = f"{path}.parts-{uuid.uuid4().hex}"

    def _files(self) -> tuple[pa.fs.FileSystem, str, str]:
        """The file system, and the places of the target and of the parts in it."""
        from pyarrow import fs

        if re.match("[a-z][a-z0-9+.-]*:", self.path):
            system, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", self.path))
        else:
            system, place = fs.LocalFileSystem(), self.path
        return system, place, posixpath.join(posixpath.dirname(place), posixpath.basename(self.parts))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, _, folder = self._files()
        system.create_dir(folder)
        files: list[tuple[int, int, str]] = []
        out: IO[bytes] | None = None
        pack = zlib.compressobj(1)

        def end() -> None:
            if out:
                out.write(pack.flush())
                out.close()

        try:
            for batch in iterator:
                for k, xml in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if not files or files[-1][0] != k or self.head and files[-1][1] == MOST_ROWS:
                        end()
                        name = f"{folder}/{task.partitionId()}-{task.taskAttemptId()}-{len(files)}"
                        out, pack = system.open_output_stream(name), zlib.compressobj(1)
                        files.append((k, 0, name))
                        if self.head:
                            out.write(pack.compress(self.head.encode()))
                            files[-1] = (k, 1, name)
                    out.write(pack.compress(xml.as_py().encode()))
                    files[-1] = (k, files[-1][1] + 1, files[-1][2])
        finally:
            end()
        if self.head:  # whole workbooks, which the commit only moves
            for _, _, part in files:
                self._assemble(system, [(0, 0, part)], f"{part}.xlsx")
                system.delete_file(part)
        return Parts(task.partitionId(), files)

    def _assemble(self, system: pa.fs.FileSystem, parts: list[tuple[int, int, str]], target: str) -> None:
        with system.open_output_stream(target) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in _frame(self.names):
                z.writestr(name, text)
            for k in range(len(self.names)):
                with z.open(f"xl/worksheets/sheet{k + 1}.xml", "w", force_zip64=True) as sheet:
                    sheet.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                    for _, _, part in (p for p in parts if p[0] == k):
                        with system.open_input_stream(part) as f:
                            unpack = zlib.decompressobj()
                            while some := f.read(1 << 20):
                                sheet.write(unpack.decompress(some))
                    sheet.write(b"</sheetData></worksheet>")

    def commit(self, messages: list[Parts | None]) -> None:
        system, place, folder = self._files()
        parts = [f for m in sorted((m for m in messages if m), key=lambda m: m.partition) for f in m.files]
        if self.head:
            system.create_dir(place)
            for n, (_, _, part) in enumerate(parts):
                system.move(f"{part}.xlsx", f"{place}/part-{n:05}-{self.parts[-8:]}.xlsx")
        else:
            for k, name in enumerate(self.names):
                if sum(n for s, n, _ in parts if s == k) > MOST_ROWS:
                    raise ValueError(f"over {MOST_ROWS} rows in sheet {name}")
            self._assemble(system, parts, f"{folder}/book")
            system.move(f"{folder}/book", place)
        system.delete_dir(folder)

    def abort(self, messages: list[Parts | None]) -> None:
        from pyarrow import fs

        system, _, folder = self._files()
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


def _frame(names: list[str]) -> Iterator[tuple[str, str]]:
    """The files of a workbook around its sheets."""
    from xml.sax.saxutils import quoteattr

    head, office = '<?xml version="1.0" encoding="UTF-8"?>\n', "application/vnd.openxmlformats-officedocument.spreadsheetml"
    kinds = {"/xl/workbook.xml": f"{office}.sheet.main+xml", "/xl/styles.xml": f"{office}.styles+xml"} | {f"/xl/worksheets/sheet{k + 1}.xml": f"{office}.worksheet+xml" for k in range(len(names))}
    yield "[Content_Types].xml", f'{head}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + "".join(f'<Override PartName="{p}" ContentType="{t}"/>' for p, t in kinds.items()) + "</Types>"
    yield "_rels/.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    links = "".join(f'<Relationship Id="rId{k + 1}" Type="{_REL}/worksheet" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(len(names)))
    yield "xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships">{links}<Relationship Id="rId{len(names) + 1}" Type="{_REL}/styles" Target="styles.xml"/></Relationships>'
    yield "xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{k + 1}" r:id="rId{k + 1}"/>' for k, n in enumerate(names)) + "</sheets></workbook>"
    one = lambda tag, inside: f'<{tag} count="1">{inside}</{tag}>'
    formats = '<cellXfs count="2"><xf numFmtId="0" fontId="0" fillId="0" borderId="0" xfId="0"/><xf numFmtId="14" fontId="0" fillId="0" borderId="0" xfId="0" applyNumberFormat="1"/></cellXfs>'
    yield "xl/styles.xml", f'{head}<styleSheet xmlns="{_MAIN}">' + one("fonts", '<font><sz val="11"/><name val="Calibri"/></font>') + one("fills", '<fill><patternFill patternType="none"/></fill>') + one("borders", "<border/>") + one("cellStyleXfs", '<xf numFmtId="0" fontId="0" fillId="0" borderId="0"/>') + formats + "</styleSheet>"
