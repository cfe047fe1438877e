"""Buildings that keep arriving: Structured Streaming from files of rectangles to covered area per cell.

Every micro-batch is aggregated by itself and written under its batch number, so a batch that is run again after a
failure replaces its own output; the totals are the sum over all batches. No state is held between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.operators.grid import CELL_M, rectangle_overlay

BOX = "city string, polygon_id bigint, lx double, ly double, hx double, hy double"


def ingest(spark: SparkSession, source: str, sink: str, state: str, cell: float = CELL_M, files_per_batch: int = 100) -> DataFrame:
    """Take in all files of source that state hasn't seen, and return city, cx, cy, building_area_m2 over all so far."""
    boxes = spark.readStream.schema(BOX).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def keep(batch: DataFrame, number: int) -> None:
        rectangle_overlay(batch, cell).groupBy("city", "cx", "cy").agg(F.sum("area_m2").alias("building_area_m2")).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    query = boxes.writeStream.foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(sink).groupBy("city", "cx", "cy").agg(F.sum("building_area_m2").alias("building_area_m2"))


def windowed_counts(events: DataFrame, time: str = "loaded_at", every: str = "1 day", late: str = "30 days") -> DataFrame:
    """Rows per city and window of a stream (or a batch): late rows count until the watermark passes."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    return timed.groupBy(F.window(time, every).alias("w"), "city").agg(F.count("*").alias("n")).select("city", F.col("w.start").alias("start"), "n")
