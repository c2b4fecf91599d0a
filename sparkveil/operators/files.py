"""From a file to its protected copy in one call, whatever the format.

Tables (csv, tsv, json lists) are classified and protected column by column; workbooks sheet by sheet; texts, nested JSON
and the tables of documents as segments. Paths are what Spark can read and write; the driver opens no file itself.

Defined cases: an unknown extension is an error, and so is a PDF file without text (``no_text``, ``encrypted``, ``broken``); a
sheet or table without rows below its header is left out; blank files
give empty results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import office as Of
from ..sources import readers as R
from ..sources import writers as Wr
from . import documents as D
from . import table as T

WORKBOOKS = ("xlsx", "xlsm", "ods")
TABLES, DOCUMENTS = ("csv", "tsv", "json", *WORKBOOKS), ("txt", "md", "docx", "pdf")


@dataclass
class Review:
    """What a file holds: its tables by sheet with their findings, or its analysed segments."""

    path: str
    kind: str
    sheets: dict[str, DataFrame] = field(default_factory=dict)
    findings: dict[str, list[T.Finding]] = field(default_factory=dict)
    analyzed: DataFrame | None = None
    delimiter: str = ","


def extension(path: str) -> str:
    found = re.search(r"\.([A-Za-z0-9]+)$", path)
    kind = found.group(1).lower() if found else ""
    if kind not in (*TABLES, *DOCUMENTS):
        raise ValueError(f"not a known kind of file: {path}")
    return kind


def sheets_of(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sheets of a workbook as tables of text cells with ``_row``, without those that hold a header only."""
    rows = R.read_workbooks(spark, path)
    heads = rows.groupBy("sheet").agg(F.min_by("cells", "row_id").alias("head"), F.min("row_id").alias("first"), F.max("row_id").alias("last")).where("last > first").collect()
    out = {}
    for h in sorted(heads, key=lambda h: h["sheet"]):
        names = R.header_names(list(h["head"]))
        body = rows.where((F.col("sheet") == h["sheet"]) & (F.col("row_id") > h["first"]))
        out[h["sheet"]] = body.select((F.col("row_id") - (h["first"] + 1)).cast("long").alias("_row"), *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return out


def review_file(spark: SparkSession, path: str) -> Review:
    """Reads and looks through one file."""
    kind = extension(path)
    review = Review(path, kind)
    if kind in ("csv", "tsv"):
        review.delimiter = R.sniff_delimiter(spark, path)
        review.sheets = {"": R.read_csv(spark, path, review.delimiter)}
    elif kind in WORKBOOKS:
        review.sheets = sheets_of(spark, path)
    elif kind == "json" and _is_list(spark, path):
        review.sheets = {"": R.read_json_table(spark, path)}
    else:
        review.analyzed = D.analyze(_segments(spark, path, kind))
    review.findings = {s: T.classify(df, "_row") for s, df in review.sheets.items()}
    return review


def _is_list(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file is a list of flat objects."""
    items = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("o"))
    row = items.agg(F.count("*").alias("n"), F.count_if(~F.ltrim("o").startswith("{") | F.exists(F.map_values(F.from_json("o", "map<string,string>")), lambda v: F.ltrim(v).rlike(r"^[\[{]"))).alias("deep")).first()
    return row["n"] > 0 and row["deep"] == 0


def _segments(spark: SparkSession, path: str, kind: str) -> DataFrame:
    none = F.lit(None).cast("string")
    if kind == "json":
        raw = spark.read.text(path, wholetext=True).select(F.lit(path).alias("doc_id"), F.col("value").alias("json"))
        return R.json_leaves(raw, "json", "doc_id").select("doc_id", F.col("seg_id").cast("long").alias("seg_id"), "text", "hint", "context", "path")
    if kind == "docx":
        docs = R.read_docx(spark, path)
        body = docs.select(F.lit(path).alias("doc_id"), F.lit(-1).cast("long").alias("seg_id"), "text", none.alias("hint"))
        tables = R.html_tables(docs.select(F.lit(path).alias("doc_id"), "html"), "doc_id", least_columns=2, least_rows=3)  # a header and two rows
        return body.unionByName(D.table_segments(tables, "doc_id").select("doc_id", "seg_id", "text", "hint"))
    if kind == "pdf":
        pages = R.read_pdfs(spark, path)
        if found := pages.where("error is not null").select("error").first():
            raise ValueError(f"{found['error']}: {path}")
        return pages.select(F.lit(path).alias("doc_id"), F.lit(0).cast("long").alias("seg_id"), "text")
    return R.read_texts(spark, path).select(F.lit(path).alias("doc_id"), F.lit(0).cast("long").alias("seg_id"), "text")


def file_totals(review: Review) -> dict[str, int]:
    """Findings by type over all sheets or segments, most frequent first; columns of low confidence are left out."""
    totals: dict[str, int] = {}
    for findings in review.findings.values():
        for kind, n in T.summarize_findings(findings).items():
            totals[kind] = totals.get(kind, 0) + n
    if review.analyzed is not None:
        for r in D.summarize(review.analyzed).select("type", "count").collect():  # one row a type
            totals[r["type"]] = totals.get(r["type"], 0) + r["count"]
    return dict(sorted(totals.items(), key=lambda x: (-x[1], x[0])))


@dataclass(frozen=True)
class ProtectedFile:
    #: The protected table of each sheet, or the segments with ``protected``.
    parts: dict[str, DataFrame]
    equivalences: dict[str, DataFrame]
    counts: DataFrame


def protect_file(review: Review, policy: dict[str, str] | None = None) -> ProtectedFile:
    """Carries out the suggested decisions, or the company's policy by type, on a reviewed file."""
    if review.analyzed is not None:
        done = D.protect(review.analyzed, policy)
        return ProtectedFile({"": done.segments}, {"": done.equivalences}, done.counts)
    parts = {s: T.apply_decisions(df, T.suggested(review.findings[s], policy), "_row") for s, df in review.sheets.items()}
    counts = None
    for p in parts.values():
        counts = p.counts if counts is None else counts.unionByName(p.counts)
    summed = counts.groupBy("type").agg(F.sum("count").alias("count"))
    return ProtectedFile({s: p.table for s, p in parts.items()}, {s: p.equivalences for s, p in parts.items()}, summed)


def write_file(review: Review, done: ProtectedFile, path: str) -> None:
    """Writes the protected copy under a folder: a table as delimited text, a workbook as one .xlsx file of the same sheets,
    lists as JSON rows, JSON documents with their leaves put back, texts as text."""
    if review.kind in WORKBOOKS:
        Of.write_workbook(done.parts, f"{path}/{re.sub(r'^.*/|[.][^.]*$', '', review.path)}.xlsx")
        return
    for part in done.parts.values():
        if review.analyzed is None and review.kind == "json":
            Wr.json_rows(part.orderBy("_row")).write.text(path)
        elif review.analyzed is None:
            Wr.write_csv(part, path, review.delimiter)
        elif review.kind == "json":
            raw = part.sparkSession.read.text(review.path, wholetext=True).select(F.lit(review.path).alias("doc_id"), F.col("value").alias("json"))
            Wr.rebuild_json(raw, part, "doc_id").select(F.col("json").alias("value")).write.text(path)
        else:
            Wr.write_texts(part.orderBy("seg_id"), path)
