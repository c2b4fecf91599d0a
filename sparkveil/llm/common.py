"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..storage import drop_materialized, materialize, shared_dir
from ..storage import among as among_column
from ..storage import marked as marked_column

__all__ = ["WS", "WS_RE", "among", "drop_materialized", "fresh", "let", "marked", "materialize", "shared_dir", "table", "words"]

#: The six ASCII white-space characters that end a word.
WS = " \t\n\x0b\f\r"
#: The same as a Java regular expression.
WS_RE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The white-space separated words of a text; none of a null one."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_RE))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names made from ``stems`` that no column of ``df`` has (compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def marked(rows: DataFrame, ids: DataFrame, mark: str) -> DataFrame:
    """``rows`` with a column that is true where their ``h`` is among ``ids`` (h), and for a few others."""
    return marked_column(rows, ids, "h", mark)


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose ``h`` is among ``ids`` (h), and a few others."""
    return among_column(rows, ids, "h")
