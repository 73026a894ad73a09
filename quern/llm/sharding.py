"""Sharding: contiguous, byte-balanced shards from global prefix sums.

Rows are ordered by id. Each range partition adds up its bytes, a running sum over those totals (one
row per partition) gives every partition its global offset, and the running sum inside a partition
then is a global prefix sum. A document belongs to the shard whose equal share of all bytes holds the
middle of its own span, so shards are contiguous and differ by less than one document.

Only (id, size, checksum) are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import cut

SHARDS = 8


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(t, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per row of `docs`: id_col, size, text_crc32, shard, slot, start.

    size is the UTF-8 length of the text (null: none) plus 1, start the bytes before the row, slot its
    place inside its shard from 0 without gaps. Order is by id (nulls first), then size and checksum;
    rows that tie in all three are equal and take adjacent places. A document longer than a shard's
    share leaves shards empty, however long it is. An empty table gives no rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    # Written once: range bounds come from a sample, and both uses below must see the same partitions.
    # The random tail splits a run of equal ids over partitions.
    rows = keyed(docs, id_col, text_col).withColumn("tie", F.xxhash64("id", "size", "text_crc32", F.monotonically_increasing_id()))
    placed = cut(rows.repartitionByRange(n, *order, F.col("tie")).withColumn("part", F.spark_partition_id()))
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    # One row per range partition, n at most.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("part_start"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("part_row"),
        F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order, "tie")
    local = placed.select(
        "*",
        (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("local_start"),
        (F.row_number().over(inside) - 1).cast("long").alias("local_row"),
    )
    # 2 * middle * shards / (2 * all), in decimals so that no product overflows.
    middle = (2 * (F.col("part_start") + F.col("local_start")) + F.col("size")).cast("decimal(30,0)")
    shard = F.least(F.floor(middle * shards / (2 * F.col("all_bytes")).cast("decimal(20,0)")), F.lit(shards - 1)).cast("int")
    spans = local.join(F.broadcast(offsets), "part").select(
        "id", "size", "text_crc32", shard.alias("shard"), (F.col("part_row") + F.col("local_row")).alias("row"), (F.col("part_start") + F.col("local_start")).alias("start")
    )
    first = spans.groupBy("shard").agg(F.min("row").alias("first_row"))  # `shards` rows
    return spans.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).cast("long").alias("slot"), "start"
    )
