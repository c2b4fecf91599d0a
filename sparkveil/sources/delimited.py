"""Delimited files whose quoted cells may hold line breaks, read in parallel.

A file is cut into blocks wherever Spark cuts it. Whether a block begins inside of a quoted cell is the parity of all quotes
before it: quotes are counted by block, and a running sum of the counts (one row a block) tells each its beginning. Blocks
then yield their records as they stream by; only what crosses a border of blocks, two pieces a block at most, is put together
by a join. No task sees more than a block, and no line is shuffled.

Defined cases: blank records (no cell has a character but space) are left out; a quote that is never closed runs to the end
of its file; ``\\r\\n`` and ``\\n`` end records, and both stay as they are within quotes; each file begins with its header, and
the first file's names count; a byte-order mark goes; files that aren't valid UTF-8 are read as Windows-1252.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

DELIMITERS = (",", ";", "\t", "|")
#: Lines that the delimiter is told by.
SNIFFED = 200


def delimiter_of(lines: list[str]) -> str:
    """The delimiter that splits the first records most evenly, outside of quotes."""
    text = re.sub(r'"(?:[^"]|"")*(?:"|\Z)', '""', "\n".join(lines))
    rows = [x for x in text.split("\n") if x.strip()]
    counts = {d: [x.count(d) for x in rows] for d in DELIMITERS}

    def even(d: str) -> tuple[bool, int, int]:
        c = counts[d]
        return min(c, default=0) > 0, max((c.count(n) for n in set(c) if n), default=0), sum(c)

    return max(DELIMITERS, key=even) if rows else ","


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _records(opens: dict[tuple[str, int], bool], windows: set[str], delimiter: str):
    """Lines of blocks -> (file, block, n, piece, text): piece 0 is a whole record, 1 the beginning of one that goes on in a
    later block, 2 what a block begins with of an earlier record, 3 a block that lies within one. n counts what begins in the
    block and isn't blank."""
    blank = re.compile(rf'[\s"{re.escape(delimiter)}]*\Z')

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, int, int, str]] = []
        at: tuple[str, int] | None = None
        held: list[str] = []
        inside = first = False
        n = 0

        def ended() -> None:
            """The block is over: what is open goes on behind it."""
            if held:
                rows.append((*at, n, 3 if first else 1, "\n".join(held)))

        for batch in batches:
            for file, block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (file, block) != at:
                    ended()
                    at, held, n = (file, block), [], 0
                    inside = first = opens[at]
                line = raw.as_py().decode("cp1252" if file in windows else "utf-8", "replace")
                if block == 0 and n == 0 and not held:
                    line = line.removeprefix("﻿")
                held.append(line)
                inside ^= line.count('"') % 2 == 1
                if not inside:
                    text, held = "\n".join(held).removesuffix("\r"), []
                    if first:
                        rows.append((*at, n, 2, text))
                    elif not blank.match(text):
                        rows.append((*at, n, 0, text))
                        n += 1
                    first = False
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["file", "block", "n", "piece", "text"])
            rows = []
        if at:
            ended()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["file", "block", "n", "piece", "text"])

    return run


def read_records(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """(file, block, n, text): the records of delimited files, line breaks within quotes included; ordered by the first three."""
    lines = _lines(spark, path)
    one_a_byte = F.decode("line", "ISO-8859-1")
    quotes = F.length(one_a_byte) - F.length(F.replace(one_a_byte, F.lit('"'), F.lit("")))
    blocks = lines.groupBy("file", "block").agg(F.sum(quotes).alias("q"), F.bool_and(F.is_valid_utf8(F.col("line").cast("string"))).alias("valid"))
    before = Win.partitionBy("file").orderBy("block").rowsBetween(Win.unboundedPreceding, -1)
    told = blocks.select("file", "block", (F.coalesce(F.sum("q").over(before), F.lit(0)) % 2 == 1).alias("open"), "valid").collect()  # one row a block
    opens, windows = {(r["file"], r["block"]): r["open"] for r in told}, {r["file"] for r in told if not r["valid"]}
    found = lines.mapInArrow(_records(opens, windows, delimiter), "file string, block long, n long, piece int, text string")
    # What crosses borders: each later piece belongs to the last beginning before it.
    crossing = found.where("piece > 0").withColumn("start", F.when(F.col("piece") == 1, F.struct("block", "n")))
    upto = Win.partitionBy("file").orderBy("block", F.col("piece") == 1).rowsBetween(Win.unboundedPreceding, Win.currentRow)
    crossing = crossing.withColumn("start", F.last("start", ignorenulls=True).over(upto))
    joined = crossing.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("block", F.when(F.col("piece") == 1, 1).otherwise(0).alias("late"), "text"))).alias("t"))
    whole = joined.select("file", "start.block", "start.n", F.regexp_replace(F.array_join(F.transform("t", lambda x: x["text"]), "\n"), r"\r$", "").alias("text"))
    return found.where("piece = 0").select("file", "block", "n", "text").union(whole)


def numbered(records: DataFrame) -> DataFrame:
    """Records with ``_row``: 0, 1, 2... in reading order, the header of each file left out. One count a block, no sort."""
    sizes = records.groupBy("file", "block").agg(F.max("n").alias("m"))
    order = Win.orderBy("file", "block")  # one row a block
    starts = sizes.withColumn("at", F.sum(F.col("m") + 1).over(order) - F.col("m") - 1).withColumn("files", F.dense_rank().over(Win.orderBy("file")))
    starts = starts.withColumn("head", F.min("block").over(Win.partitionBy("file")))
    joined = records.join(F.broadcast(starts.select(F.col("file").alias("f"), F.col("block").alias("b"), "at", "files", "head")), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    body = joined.where((F.col("block") != F.col("head")) | (F.col("n") > 0))
    return body.select((F.col("at") + F.col("n") - F.col("files")).alias("_row"), "text")
