"""Files made from the tables and read again: workbooks and PDF."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources import generate as G
from ..sources.office import read_workbooks, write_workbook_parts
from ..sources.pdf import join_pages, pdf_pages
from ..sources.readers import read_csv
from ..sources.writers import write_csv
from ..storage import materialize, shared_dir
from .base import Query, register, table

FILES: dict[str, Query] = {}


@register(FILES, """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice AS price, o_orderpriority || ' <&> "é"' AS priority, o_orderstatus = 'F' AS done, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '00' || o_custkey::VARCHAR END AS code FROM orders""")
def workbook_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All orders as workbooks, a file or more a task, read back cell by cell: days, numbers, truth values, odd characters."""
    o = table(spark, sf, "orders")
    code = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("00"), F.col("o_custkey").cast("string")))
    rows = o.select(F.col("o_orderkey").alias("clave"), F.col("o_orderdate").cast("date").alias("día"), F.col("o_totalprice").alias("precio"), F.concat("o_orderpriority", F.lit(' <&> "é"')).alias("prioridad"), (F.col("o_orderstatus") == "F").alias("listo"), code.alias("código"))
    path = f"{shared_dir(spark)}/veil-{uuid.uuid4().hex}"
    write_workbook_parts(rows, path)
    cells = read_workbooks(spark, f"{path}/*.xlsx").where("row_id > 0").select(*[F.col("cells")[k].alias(c) for k, c in enumerate(("key", "day", "price", "priority", "done", "code"))])
    return cells.select(F.col("key").cast("long").alias("o_orderkey"), "day", F.col("price").cast("double").alias("price"), "priority", (F.col("done") == "true").alias("done"), "code")


@register(FILES, """
SELECT doc_id, md5(coalesce(text, '')) AS text_md5, length(coalesce(text, ''))::INTEGER AS n, lang FROM documents""")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as delimited files, whose texts hold line breaks, quotes and delimiters, read back by records."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    path = f"{shared_dir(spark)}/veil-{uuid.uuid4().hex}"
    write_csv(docs.repartition(spark.sparkContext.defaultParallelism), path, ";")
    back = read_csv(spark, path, ";")
    text = F.coalesce("text", F.lit(""))
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("text_md5"), F.length(text).alias("n"), "lang")


def _of(names: tuple[str, ...], draw: str) -> str:
    return f"[{', '.join(repr(n) for n in names)}][{draw} * {len(names)} // {1 << G.STATE_BITS} + 1]"


@register(FILES, f"""
WITH RECURSIVE r(i, x) AS (
  SELECT 0::BIGINT, 42::BIGINT UNION ALL SELECT i + 1, (x * {G.FACTOR} + {G.ADDEND}) % {1 << G.STATE_BITS} FROM r WHERE i < (SELECT {G.DRAWS} * (max(c_custkey) + 1) FROM customer)),
d AS (SELECT (i - 1) // {G.DRAWS} AS n, max(x) FILTER ((i - 1) % 4 = 0) AS a, max(x) FILTER ((i - 1) % 4 = 1) AS b, max(x) FILTER ((i - 1) % 4 = 2) AS c, max(x) FILTER ((i - 1) % 4 = 3) AS e FROM r WHERE i > 0 GROUP BY 1)
SELECT c_custkey, {_of(G.FIRST, 'a')} || ' ' || {_of(G.LAST, 'b')} AS name, c * 39000000 // {1 << G.STATE_BITS} + 10000000 AS dni, e * 2000000 // {1 << G.STATE_BITS} + 300000 AS amount
FROM customer JOIN d ON n = c_custkey""")
def seeded_people(spark: SparkSession, sf: str) -> DataFrame:
    """A made-up person for each customer, from one sequential stream that every partition enters at its own rows."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").alias("at"))
    return G.people(c.repartition(16), "at").select("c_custkey", "name", "dni", "amount")


#: Lines of a page.
PAGE_LINES = 40


def _pdf(text: Column) -> Column:
    """A PDF file of a text in Latin-1, without a cross-reference table: a page for each ``PAGE_LINES`` lines."""

    def page(k: Column, lines: Column) -> Column:
        shown = F.array_join(F.slice(lines, (k - 1) * PAGE_LINES + 1, F.lit(PAGE_LINES)), ") Tj T*\n(")
        program = F.concat(F.lit("BT /A 10 Tf 12 TL 40 800 Td\n("), shown, F.lit(") Tj T*\nET"))
        head = F.concat((2 * k + 8).cast("string"), F.lit(" 0 obj\n<</Type /Page /Parent 2 0 R /Contents "), (2 * k + 9).cast("string"), F.lit(" 0 R>>\nendobj\n"))
        return let(program, lambda content: F.concat(head, (2 * k + 9).cast("string"), F.lit(" 0 obj\n<</Length "), F.length(content).cast("string"), F.lit(">>\nstream\n"), content, F.lit("\nendstream\nendobj\n")))

    def whole(lines: Column) -> Column:
        count = F.ceil(F.size(lines) / PAGE_LINES).cast("int")
        numbers = F.sequence(F.lit(1), count)
        kids = F.array_join(F.transform(numbers, lambda k: F.concat((2 * k + 8).cast("string"), F.lit(" 0 R"))), " ")
        tree = F.concat(F.lit("%PDF-1.4\n1 0 obj\n<</Type /Catalog /Pages 2 0 R>>\nendobj\n3 0 obj\n<</Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding>>\nendobj\n2 0 obj\n<</Type /Pages /Count "), count.cast("string"), F.lit(" /Resources <</Font <</A 3 0 R>>>> /Kids ["), kids, F.lit("]>>\nendobj\n"))
        return F.encode(F.concat(tree, F.array_join(F.transform(numbers, lambda k: page(k, lines)), ""), F.lit("trailer\n<</Root 1 0 R>>\n%%EOF")), "ISO-8859-1")

    # the lines are bound once: a page would cut the whole text again otherwise
    return let(F.split(F.regexp_replace(text, r"([()\\])", r"\\$1"), "\n"), whole)


@register(FILES, r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\x09\x0a\x20-\x7e\x{a0}-\x{ff}]', '?', 'g') AS t FROM documents),
l AS (SELECT doc_id, string_split(t, chr(10)) AS l FROM t),
p AS (SELECT doc_id, list_transform(range(0, (len(l) + 39) // 40), lambda k: array_to_string(l[k * 40 + 1 : k * 40 + 40], chr(10))) AS p FROM l),
w AS (SELECT doc_id, len(p)::INTEGER AS pages, trim(array_to_string(p, chr(10) || chr(10)), chr(32) || chr(9) || chr(10)) AS w FROM p)
SELECT doc_id, pages, CASE WHEN length(w) >= 20 THEN md5(w) END AS text_md5, CASE WHEN length(w) < 20 THEN 'no_text' END AS error FROM w""")
def pdf_text(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as PDF files, read back: their pages, text, and the error of those that show next to none."""
    docs = table(spark, sf, "documents")
    # the characters that go, by name: over the same set as a negation the expression takes ten times as long
    latin = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0b-\x1f\x7f-\x9f\x{100}-\x{10ffff}]", "?")
    made = docs.select(F.col("doc_id").cast("string").alias("path"), _pdf(latin).alias("content"))
    found = materialize(join_pages(pdf_pages(made)))
    return found.select(F.col("path").cast("long").alias("doc_id"), "pages", F.md5("text").alias("text_md5"), "error")
