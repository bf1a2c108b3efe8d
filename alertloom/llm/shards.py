"""Contiguous shards of nearly equal bytes, from prefix sums over per-partition totals.

Rows are put in order of doc_id by range partitioning, without their texts. Each partition sums its own rows;
the totals of the partitions, one row each, are summed up in order; a row's global byte offset is its
partition's offset plus a running sum inside the partition. Cutting the offsets at equal targets gives
contiguous shards. Only DataFrame functions are used.

Law ``bytes``: a document belongs to the shard that its middle byte falls into, so a shard differs from the equal
share by less than one document at either end. Defined cases: a null text has no bytes and counts only the
overhead; null doc_ids come first; rows with one doc_id are ordered by checksum, size and the partition they were
read from, so repeated rows spread as well. Shards may stay empty if there are fewer rows than shards. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

#: Bytes that a document takes in a shard besides its text.
OVERHEAD = 8


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), a row per document; slot counts a shard's rows from 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.spark_partition_id().alias("origin"),
    )
    order = ["doc_id", "text_crc32", "size", "origin"]
    ranged = materialize(
        slim.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "shards-ranged")
    # One row per partition: the only thing that is put in one global order.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    offsets = materialize(totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    ), "shards-offsets")
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = ranged.withColumn("upto", F.sum("size").over(within)).withColumn("nth", F.count("*").over(within))
    # As many rows as there are range partitions, whatever the rows are.
    middle = F.col("bytes_before") + F.col("upto") - F.col("size") + F.expr("size div 2")
    placed = materialize(run.join(F.broadcast(offsets), "part").select(
        "doc_id", "size", "text_crc32",
        F.least(F.floor(middle.cast("decimal(30,0)") * shards / F.col("total")), F.lit(shards - 1))
        .cast("int").alias("shard"),
        (F.col("rows_before") + F.col("nth") - 1).alias("row"),
    ), "shards-placed")
    # One row per shard.
    starts = placed.groupBy("shard").agg(F.min("row").alias("start"))
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("start")).alias("slot"))
