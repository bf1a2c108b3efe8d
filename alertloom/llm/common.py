"""Helpers shared by the operators: reading tables, size-checked lookups, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: Size on disk up to which a written lookup table of ids and other small columns may be broadcast.
BROADCAST_BYTES = 4 << 20
SALTS = 8


#: Size of the batches that go to Python workers and back; a task holds several of them at once.
BATCH = "8m"


def small_batches(spark: SparkSession) -> None:
    """Limit Arrow batches of the session by size, so that whole texts in them stay within an executor's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_enough(written: DataFrame) -> bool:
    """Whether a written table may be broadcast, by the size of its files; no job is run for it."""
    size = written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= BROADCAST_BYTES


def lookup(df: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "left") -> DataFrame:
    """Join ``small``, a written table with one row per key, to ``df``.

    It is broadcast only if its files stay within BROADCAST_BYTES. Beyond that both sides are shuffled, with the
    key salted by ``spread``, any column that differs within a hot key.
    """
    if small_enough(small):
        return df.join(F.broadcast(small), keys, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return out.join(salted, [*keys, "_salt"], how).drop("_salt")


def _round(edges: DataFrame) -> DataFrame:
    """One large-star step and one small-star step over rows (hi, lo), hi > lo."""
    both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("least"))
    large = (
        both.where("lo > hi").join(least, "hi")
        .select(F.col("lo").alias("hi"), F.col("least").alias("lo")).where("hi > lo").distinct()
    )
    low = large.groupBy("hi").agg(F.min("lo").alias("least"))
    return large.join(low, "hi").select(
        F.explode(F.array(F.struct("hi", F.col("least").alias("lo")),
                          F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")))).alias("e")
    ).select("e.*").where("hi > lo").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node in the rows (a, b) of ``links``; component is its smallest node.

    Alternating star contraction: every round brings each node's neighbours closer to the smallest one,
    so the number of rounds grows with the logarithm of the longest chain. Null nodes, loops and
    repeated rows are ignored; no links give no rows.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .where("a is not null and b is not null and hi > lo").distinct(), name)
    state = lambda e: e.agg(
        F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    before = state(edges)
    while before[0]:
        edges = materialize(_round(edges), name)
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
