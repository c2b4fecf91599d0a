"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset, in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(spark, "_veil_dir", None):
        spark._veil_dir = tempfile.mkdtemp(prefix="veil-")
    return spark._veil_dir


@contextmanager
def _no_shuffle_files_after(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes the shuffle files of an execution when it has ended, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: it is computed once, lineage is cut, and lost
    executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veil-{uuid.uuid4().hex}"
    with _no_shuffle_files_after(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veil_path = path
    return out


def drop_materialized(*frames: DataFrame) -> None:
    """Delete the files behind frames made by ``materialize`` that no later plan reads."""
    for df in frames:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._veil_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the filters by which rows without a partner are left where they are: 4 MB at most, whatever the input.
FILTER_BITS = 1 << 25


def marked(rows: DataFrame, known: DataFrame, column: str, mark: str) -> DataFrame:
    """``rows`` with a column that is true where their ``column`` is among that of ``known``, and for a few others. What is
    known becomes a bitmap of fixed size, which is broadcast, so that only marked rows need be shuffled afterwards."""
    slot = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    at = lambda c: F.call_function("bitmap_bit_position", c)
    group = lambda c: F.call_function("bitmap_bucket_number", c)
    maps = known.select(slot.alias("x")).groupBy(group(F.col("x")).alias("sv_g")).agg(F.call_function("bitmap_construct_agg", at(F.col("x"))).alias("sv_bits"))
    byte = F.conv(F.hex(F.substring("sv_bits", (F.shiftright(at(slot), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (at(slot) % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return rows.join(F.broadcast(maps), group(slot) == F.col("sv_g"), "left").select(*rows.columns, F.coalesce(hit, F.lit(False)).alias(mark))


def among(rows: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is among that of ``known``, and a few others."""
    return marked(rows, known, column, "sv_among").where("sv_among").drop("sv_among")
