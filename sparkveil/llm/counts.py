"""Token counts as delta-maintained rollups.

A change is a signed row: an insert adds a document's count, a delete takes it back, a revised count does both. A batch
of changes is summed by source, language and tokenizer version and committed as one folder of deltas under its number.
Committing a number again does nothing once its folder is complete, and replaces what an interrupted attempt left, so
batches may be retried. Totals add up what is committed; ``compact`` folds it into one base, which knows its batches by
number, so that one that comes late still counts.

Defined cases: null sources and languages are groups of their own; a null or empty text counts 0 tokens and 1 document;
repeated rows count each; a delete of what was never inserted makes a negative count; empty batches commit as empty;
groups whose documents and tokens are all taken back are not in the totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import words
from .tokens import word_tokenizer

KEYS = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"


def _count(name: str, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(name, path)
        for batch in batches:
            counts = pa.array((tok.count(t.as_py()) for t in batch.column(4)), pa.int64(), size=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], counts], names=["key", "source", "lang", "n_words", "n_pieces"])

    return run


def count_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", lang: str = "lang", text: str = "text", name: str = "word_bpe_49k.json", path: str | None = None) -> DataFrame:
    """One row per document and tokenizer version: key, source, lang, version, n_tokens."""
    kind = docs.schema[key].dataType.simpleString()
    base = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(lang).alias("lang"), F.size(words(F.col(text))).cast("long").alias("n_words"), F.col(text).cast("string").alias("text"))
    counted = base.mapInArrow(_count(name, path), f"key {kind}, source string, lang string, n_words long, n_pieces long")
    versions = F.array(F.struct(F.lit("words/1").alias("version"), F.col("n_words").alias("n_tokens")), F.struct(F.lit(f"{name.split('.')[0]}/1").alias("version"), F.col("n_pieces").alias("n_tokens")))
    return counted.select("key", "source", "lang", F.inline(versions))


def inserts(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, "n_tokens", F.lit(1).alias("sign"))


def deletes(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, "n_tokens", F.lit(-1).alias("sign"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old counts taken back, new ones added."""
    return deletes(old).unionByName(inserts(new))


def deltas(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens"))


class Rollup:
    """Totals in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._at = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _done(self, kind: str) -> list[int]:
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=") and self._fs.exists(self._at(f"{self.path}/{n}/_SUCCESS")))

    def _base(self) -> tuple[int | None, set[int]]:
        """The last base, and the numbers of the batches that it holds."""
        bases = self._done("base")
        if not bases:
            return None, set()
        return bases[-1], {r["number"] for r in self.spark.read.schema("number long").parquet(f"{self.path}/held={bases[-1]}").collect()}

    def commit(self, number: int, changes: DataFrame) -> bool:
        """False if that batch is committed already, by itself or within a base. A batch that comes after a base of later
        numbers was made counts like any other."""
        if number in self._base()[1] or number in self._done("batch"):
            return False
        deltas(changes).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        return True

    def _parts(self, upto: int | None = None) -> list[str]:
        base, held = self._base()
        found = [f"{self.path}/base={base}"] if base is not None else []
        return found + [f"{self.path}/batch={b}" for b in self._done("batch") if b not in held and (upto is None or b <= upto)]

    def _sum(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*parts)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        return self._sum(self._parts())

    def compact(self, upto: int) -> None:
        """One base of the batches that are committed so far, to the number ``upto``. The base says which these are before it
        counts as complete, so an interrupted attempt changes nothing."""
        base, held = self._base()
        now = 0 if base is None else base + 1
        numbers = sorted(held | {b for b in self._done("batch") if b <= upto})
        self.spark.createDataFrame([(n,) for n in numbers], "number long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/held={now}")
        self._sum(self._parts(upto)).write.mode("overwrite").parquet(f"{self.path}/base={now}")

    def vacuum(self) -> None:
        """Delete what the last base replaces: batches that it holds and earlier bases. Totals read before may need them."""
        base, held = self._base()
        gone = [f"batch={b}" for b in self._done("batch") if b in held] + [f"{k}={b}" for b in self._done("base") if base is not None and b < base for k in ("base", "held")]
        for name in gone:
            self._fs.delete(self._at(f"{self.path}/{name}"), True)


def part_of(key: Column, parts: int) -> Column:
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


ORACLE_WORDS = r"""
SELECT source, coalesce(lang, 'und') AS lang, 'words/1' AS version, count(*)::BIGINT AS n_docs,
       sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS n_tokens
FROM documents GROUP BY ALL
"""
