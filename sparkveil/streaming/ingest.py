"""Events as they arrive: deduplicated and counted by window and type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def deduplicated(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each event once, as long as a copy comes within ``late``."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", width: str = "1 day", late: str | None = "1 hour") -> DataFrame:
    """window start, type, events and the sum of ``value``; rows later than ``late`` are left out (null: ``events`` has its
    watermark already)."""
    out = (events.withWatermark(ts, late) if late else events).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), kind, "events", "total")


def append_detections(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends each micro-batch's detections, summed by (event, type, action), under its batch number: a batch that is
    run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        from ..operators.report import ingest_detections

        ingest_detections(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def keep_latest(counts: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes the groups that each micro-batch changed, under its number; read them with ``latest_counts``. With a watermark
    the state holds open windows only, and nothing passes through the driver."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_counts(spark: SparkSession, path: str, by: list[str], values: list[str], schema: StructType) -> DataFrame:
    """The last state of every group that ``keep_latest`` wrote; no rows if no batch came."""
    rows = spark.read.schema(schema.add("batch", "long")).parquet(path)
    return rows.groupBy(*by).agg(F.max_by(F.struct(*values), "batch").alias("x")).select(*by, "x.*")
