"""Catalogue records as a stream of files: the same columns as in batch, rows that are sound and rows that aren't apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmetrics.sources.ingest import slim
from shelfmetrics.sources.load import FIELDS, decoded, typed


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.format("text").option("lineSep", "\n").load(folder)


def stream_items(spark: SparkSession, folder: str, items_path: str, errors_path: str, checkpoint: str) -> StreamingQuery:
    """Appends typed items and bad rows (with messages) as files arrive. Each batch writes under its own number, so that a
    batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        rows = slim(batch)
        read = decoded(rows.where("why_bad IS NULL").select(*FIELDS)).persist()
        try:
            typed(read).write.mode("overwrite").parquet(f"{items_path}/batch={number}")
            bad = read.where(F.size("errors") > 0).select("parent_asin", "errors")
            lines = rows.where("why_bad IS NOT NULL").select(F.lit(None).cast("string").alias("parent_asin"), F.array("why_bad").alias("errors"))
            bad.unionByName(lines).write.mode("overwrite").parquet(f"{errors_path}/batch={number}")
        finally:
            read.unpersist()

    return read_lines(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
