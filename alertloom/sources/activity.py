"""The activity log: a date-partitioned table scanned by source address, newest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_activity(activity: DataFrame, path: str, mode: str = "append") -> None:
    """Partition by day and order by address inside a file, so that scans skip row groups."""
    (
        activity.withColumn("event_date", F.to_date("event_time"))
        # Spread each day over many tasks: a day may hold far more than one task should write.
        .repartition("event_date", F.pmod(F.xxhash64("source_ip"), F.lit(64)))
        .sortWithinPartitions("event_date", "source_ip")
        .write.mode(mode).partitionBy("event_date").parquet(path)
    )


def read_activity(spark: SparkSession, path: str, since: str | None = None,
                  until: str | None = None) -> DataFrame:
    """Activity rows; the date bounds prune partitions."""
    df = spark.read.parquet(path)
    if since is not None:
        df = df.filter(F.col("event_date") >= F.lit(since).cast("date"))
    if until is not None:
        df = df.filter(F.col("event_date") <= F.lit(until).cast("date"))
    return df


def newest_for(activity: DataFrame, source_ips: list[str], limit: int) -> DataFrame:
    """Newest rows of a given list of addresses; filter and limit reach the scan."""
    return (
        activity.filter(F.col("source_ip").isin(source_ips))
        .orderBy(F.col("event_time").desc(), "event_name").limit(limit)
    )
