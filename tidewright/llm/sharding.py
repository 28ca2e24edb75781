"""Sharding by global byte-size prefix sums, in DataFrame operations alone.

Rows are range-partitioned by id; totals of each partition (one row for each, so their
number is bounded by the partition count) are summed up to give every partition its
starting byte and row, and a window inside each partition completes the prefix sums.
Equal cuts of the total give contiguous shards whose sizes differ by one row at most.

Edge cases: a null text has size 1 like an empty one; rows with a null id come first;
rows that repeat an id are told apart by checksum, size and place; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, partitions, text_or_empty


def prefix_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot, start): ``start`` is the byte at which the row begins in the order of all rows."""
    if shards < 1:
        raise ValueError("at least one shard")
    order = ["id", "text_crc32", "size", "tie"]
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).select("id", (F.octet_length("text") + 1).cast("bigint").alias("size"), F.crc32("text").alias("text_crc32"), F.monotonically_increasing_id().alias("tie"))
    dealt = rows.repartitionByRange(4 * partitions(docs.sparkSession), *order).withColumn("part", F.spark_partition_id())
    table = keep(dealt, "sizes")
    totals = table.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row0"))
    total = totals.agg(F.sum("bytes").alias("total"))
    inside = Window.partitionBy("part").orderBy(*order)
    placed = table.select("*", (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("b"), (F.row_number().over(inside) - 1).alias("r")).join(F.broadcast(starts), "part").join(F.broadcast(total))
    start = F.col("byte0") + F.col("b")
    # A row goes where its middle byte lies.
    cut = placed.select("id", "size", "text_crc32", F.expr("row0 + r").alias("row"), start.alias("start"), F.least(F.lit(shards - 1), F.expr(f"((2 * (byte0 + b) + size) * {shards}) div (2 * total)")).cast("int").alias("shard"))
    first = cut.groupBy("shard").agg(F.min("row").alias("first_row"))
    return cut.join(F.broadcast(first), "shard").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"), "start")
