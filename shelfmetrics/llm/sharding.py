"""Byte-balanced contiguous shards from a global prefix sum of sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written


def byte_shards(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cuts the rows into ``shards`` contiguous runs whose sizes are near equal, equal texts side by side.

    Rows are ordered by a hash of their text, then by key, so that equal texts lie in one shard unless one of the ``shards`` - 1 cuts falls among them: a group of copies may be larger
    than a shard. A row's size is its text's UTF-8 bytes plus 1. The rows are range-partitioned once and written, so
    that every later step sees the same partitions. Per-partition totals, of which there are as many as
    partitions, give each partition the sum of all before it; inside a partition a running sum does the rest.
    A row goes to the shard in which its first byte falls, so a shard's size differs from total / shards by
    less than one row at either end.

    Returns key, size, text_crc32, shard, slot (position inside the shard, gapless from 0), start (bytes before it).
    Null or empty text: size 1, crc32 of nothing. Among equal texts null keys come first; equal rows are interchangeable. No rows: no rows. Extra columns are ignored.
    """
    body = F.encode(text_or_empty(text), "UTF-8")
    light = docs.select(
        F.col(key).alias("_key"), F.xxhash64(text_or_empty(text)).alias("_hash"), (F.octet_length(text_or_empty(text)) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32")
    )
    order = ["_hash", "text_crc32", "size", "_key"]
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = light.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the id is partition << 33 | row, so it carries both the partition and the order inside it
    numbered = written(ranged.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)), "shards")

    totals = numbered.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy("_id")
    placed = (
        numbered.withColumn("_sum", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("_row", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "_part")  # a row for each partition
        .withColumn("start", F.col("_sum") + F.col("_bytes_before"))
        .withColumn("_at", F.col("_row") + F.col("_rows_before"))
        # decimals: bytes times shards may pass 2^63
        .withColumn("shard", F.floor(F.col("start").cast("decimal(30,0)") * shards / F.col("_total").cast("decimal(30,0)")).cast("int"))
    )
    firsts = placed.groupBy("shard").agg(F.min("_at").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").select(  # a row for each shard
        F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_at") - F.col("_first")).cast("long").alias("slot"), "start"
    )
