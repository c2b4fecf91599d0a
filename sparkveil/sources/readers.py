"""Reading tables, documents and JSON as DataFrames.

Text formats use Spark's own readers and split; office files are zip archives, one small Python function per file
unpacks them inside tasks. Paths may be anything that Spark can read; the driver opens no file itself.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from .delimited import SNIFFED, delimiter_of, numbered, read_records
from .office import read_workbooks
from .pdf import read_pdfs

__all__ = ["read_pdfs", "read_workbooks"]

#: Accepted extensions and the largest file, in MB. Fixed values.
EXTENSIONS, MAX_MB = ("csv", "tsv", "xlsx", "xlsm", "ods", "json", "docx", "pdf", "txt", "md"), 50
BLANK_HEADER = "Columna {}"


def add_row_number(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` with 0, 1, 2... in reading order. One count per partition, then an offset; no shuffle of the rows."""
    marked = df.withColumn("sv_id", F.monotonically_increasing_id())
    part = F.shiftright("sv_id", 33)
    sizes = marked.groupBy(part.alias("sv_part")).agg(F.count("*").alias("n"))
    before = Win.orderBy("sv_part").rowsBetween(Win.unboundedPreceding, -1)
    starts = sizes.select("sv_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("sv_start"))
    joined = marked.withColumn("sv_part", part).join(F.broadcast(starts), "sv_part")  # one row per partition
    return joined.select((F.col("sv_start") + F.col("sv_id").bitwiseAND((1 << 33) - 1)).alias(name), *df.columns)


def gate(files: DataFrame, most_mb: int = MAX_MB) -> DataFrame:
    """Files (path, length) with ``accepted``: a known extension and not too large."""
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.withColumn("accepted", extension.isin(*EXTENSIONS) & (F.col("length") <= most_mb * 1_000_000))


#: What Windows-1252 has where Latin-1 has control characters, by rule from the codec.
_LATIN, _WINDOWS = zip(*((chr(b), bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)), strict=True)


def decode_bytes(data: Column) -> Column:
    """Bytes as text: UTF-8 if they are valid, else Windows-1252; a leading byte-order mark goes."""
    text = F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(F.translate(F.decode(data, "ISO-8859-1"), "".join(_LATIN), "".join(_WINDOWS)))
    return F.regexp_replace(text, "^﻿", "")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files, whatever the two encodings."""
    return spark.read.format("binaryFile").load(path).select("path", decode_bytes(F.col("content")).alias("text"))


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter that splits the first records most evenly, outside of quotes."""
    return delimiter_of([r[0] for r in spark.read.text(path).limit(SNIFFED).collect()])


def header_names(names: list[str | None]) -> list[str]:
    """Blank headers get a number; repeated ones stay apart by a suffix."""
    out: list[str] = []
    for i, n in enumerate(names):
        base = (n or "").strip().removeprefix("﻿") or BLANK_HEADER.format(i + 1)
        name, k = base, 2
        while name in out:
            name, k = f"{base} ({k})", k + 1
        out.append(name)
    return out


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """A delimited file as text cells with ``_row``; blank records are left out, short ones are padded with null, cells beyond
    the header go. Cells may hold line breaks in quotes: see ``delimited``."""
    sep = delimiter or sniff_delimiter(spark, path)
    records = read_records(spark, path, sep)
    options = {"sep": sep, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1", "nullValue": "", "emptyValue": ""}
    head = records.orderBy("file", "block", "n").limit(1).collect()
    if not head:
        raise ValueError(f"no rows in {path}")
    names = header_names(next(csv.reader([head[0]["text"]], delimiter=sep)) if "\n" not in head[0]["text"] else next(csv.reader(io.StringIO(head[0]["text"], newline=""), delimiter=sep)))
    schema = ", ".join(f"c{k} string" for k in range(len(names)))
    body = numbered(records).select("_row", F.from_csv("text", schema, options).alias("sv_c"))
    return body.select("_row", *[F.col(f"sv_c.c{k}").alias(n) for k, n in enumerate(names)])


def read_json_table(spark: SparkSession, path: str) -> DataFrame:
    """An array of flat objects as a table: columns in the order in which keys first occur, a missing key is null."""
    raw = spark.read.text(path, wholetext=True)
    items = raw.select(F.posexplode(F.from_json("value", "array<string>")).alias("_row", "o"))
    keys = items.select("_row", F.posexplode(F.json_object_keys("o")).alias("p", "k"))
    order = [r["k"] for r in keys.groupBy("k").agg(F.min(F.struct("_row", "p")).alias("at")).orderBy("at").collect()]
    if not order:
        raise ValueError("not a list of objects")
    field = lambda k: F.from_json("o", "map<string,string>")[k]
    return items.select(F.col("_row").cast("long").alias("_row"), *[field(k).alias(k) for k in order])


def json_leaves(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, seg_id, path, text, hint, context): one row per string or number of a JSON text, in order.

    ``hint`` is the last key above it and ``context`` the one before; places in arrays do not count as keys. A text that
    is no JSON gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()

    def walk(node, path):
        if isinstance(node, dict):
            for k, v in node.items():
                yield from walk(v, [*path, k])
        elif isinstance(node, list):
            for i, v in enumerate(node):
                yield from walk(v, [*path, i])
        elif isinstance(node, str | int | float) and not isinstance(node, bool):
            names = [p for p in path if isinstance(p, str)]
            yield json.dumps(path, ensure_ascii=False), node if isinstance(node, str) else _number(node), names[-1] if names else None, names[-2] if len(names) > 1 else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch["key"], batch["text"], strict=True):
                try:
                    root = json.loads(text)
                except (TypeError, ValueError):
                    continue
                rows += [(k, i, *leaf) for i, leaf in enumerate(walk(root, []))]
            yield pd.DataFrame(rows, columns=["key", "seg_id", "path", "text", "hint", "context"])

    found = df.select(F.col(key).alias("key"), F.col(column).alias("text")).mapInPandas(run, f"key {kind}, seg_id int, path string, text string, hint string, context string")
    return found.withColumnRenamed("key", key)


def _number(x: float) -> str:
    return str(int(x)) if isinstance(x, int) or x.is_integer() else repr(x)


# Entities that cells are decoded by.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}


def html_text(html: Column) -> Column:
    """Text of a piece of HTML: paragraph and line ends are blanks, tags go, entities are decoded."""
    s = F.regexp_replace(F.regexp_replace(html, r"(?i)</p>\s*<p[^>]*>", " "), r"(?i)<br\s*/?>", " ")
    s = F.regexp_replace(s, "<[^>]+>", "")
    parts = F.split(s, "&(?=#x[0-9a-fA-F]+;|#[0-9]+;)")

    def decoded(part: Column, i: Column) -> Column:
        number = F.regexp_extract(part, "^#([0-9]+);", 1).try_cast("int")
        hexed = F.conv(F.regexp_extract(part, "^#x([0-9a-fA-F]+);", 1), 16, 10).try_cast("int")
        code = F.coalesce(number, hexed)
        rest = F.regexp_replace(part, "^#x?[0-9a-fA-F]+;", "")
        utf8 = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when((i > 0) & code.isNotNull(), F.concat(utf8, rest)).otherwise(part)

    s = F.array_join(F.transform(parts, decoded), "")
    for name, char in ENTITIES.items():
        s = F.regexp_replace(s, f"(?i)&{name};", re.escape(char) if char in "$\\" else char)
    return F.btrim(F.regexp_replace(s, r"[\s ]+", " "))


def html_tables(df: DataFrame, key: str, html: str = "html", least_columns: int = 1, least_rows: int = 1) -> DataFrame:
    """(key, table_id, row_id, cells) of the tables of a page, not nested. Empty rows, and tables too small, are left out."""
    all_ = lambda c, rx, g=0: F.regexp_extract_all(c, F.lit(rx), F.lit(g))
    tables = df.select(key, F.posexplode(all_(F.col(html), r"(?is)<table.*?</table>")).alias("table_id", "t"))
    rows = tables.select(key, "table_id", F.posexplode(all_(F.col("t"), r"(?is)<tr.*?</tr>")).alias("row_id", "r"))
    cells = rows.select(key, "table_id", "row_id", F.transform(all_(F.col("r"), r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", 1), html_text).alias("cells"))
    filled = cells.where(F.exists("cells", lambda c: c != ""))
    sized = filled.withColumn("sv_n", F.count("*").over(Win.partitionBy(key, "table_id"))).withColumn("sv_w", F.max(F.size("cells")).over(Win.partitionBy(key, "table_id")))
    return sized.where((F.col("sv_n") >= least_rows) & (F.col("sv_w") >= least_columns)).drop("sv_n", "sv_w")


_WORDML = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, html): the paragraphs of .docx files, and their tables as HTML for ``html_tables``."""

    def paragraphs(node) -> Iterator[str]:
        for p in node.iter(f"{_WORDML}p"):
            yield "".join("\t" if x.tag == f"{_WORDML}tab" else x.text or "" for x in p.iter() if x.tag in (f"{_WORDML}t", f"{_WORDML}tab"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from html import escape

        for batch in batches:
            rows = []
            for p, data in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                    body = ElementTree.fromstring(z.read("word/document.xml"))
                tables = ["<table>" + "".join("<tr>" + "".join(f"<td>{escape(' '.join(paragraphs(c)))}</td>" for c in r.iter(f"{_WORDML}tc")) + "</tr>" for r in t.iter(f"{_WORDML}tr")) + "</table>" for t in body.iter(f"{_WORDML}tbl")]
                rows.append((p, re.sub(r"\n{3,}", "\n\n", "\n\n".join(paragraphs(body))).strip(), "".join(tables)))
            yield pd.DataFrame(rows, columns=["path", "text", "html"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string, html string")


def read_equivalences(spark: SparkSession, path: str) -> DataFrame:
    """(pseudonym, original, grp) of a CSV table of equivalences, whatever the case of its headers."""
    df = read_csv(spark, path)
    low = {c.strip().lower(): c for c in df.columns}
    original = low.get("valor_original") or low.get("original")
    if "seudonimo" not in low or original is None:
        raise ValueError("no table of equivalences")
    group = F.col(f"`{low['grupo']}`") if "grupo" in low else F.lit(None).cast("string")
    out = df.select(F.trim(f"`{low['seudonimo']}`").alias("pseudonym"), F.col(f"`{original}`").alias("original"), group.alias("grp"))
    return out.where((F.coalesce("pseudonym", F.lit("")) != "") & (F.coalesce("original", F.lit("")) != ""))


def read_envelope(spark: SparkSession, path: str, password: str, schema: str = "seudonimo string, original string, grupo string") -> DataFrame:
    """The rows of an encrypted JSON envelope (kdf.iteraciones, kdf.sal, cifrado.iv, datos; bytes in base64): one AES-256-GCM
    message under a key of PBKDF2-SHA256. A wrong password or a changed file raises an error when the rows are read."""
    from .writers import _key

    kinds = "version int, kdf struct<iteraciones:int,sal:string>, cifrado struct<iv:string>, datos string"
    file = spark.read.text(path, wholetext=True).select(F.from_json("value", kinds).alias("f")).select("f.*")
    head = file.select("kdf.iteraciones", F.unbase64("kdf.sal").alias("salt")).first()
    if head is None or head["salt"] is None:
        raise ValueError(f"no encrypted envelope in {path}")
    key = F.lit(_key(password, bytes(head["salt"]), head["iteraciones"]))
    plain = F.aes_decrypt(F.concat(F.unbase64("cifrado.iv"), F.unbase64("datos")), key, F.lit("GCM")).cast("string")
    return file.select(F.inline(F.from_json(plain, "array<struct<" + ",".join(":".join(c.split()) for c in schema.split(", ")) + ">>")))
