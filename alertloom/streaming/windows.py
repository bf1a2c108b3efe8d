"""Windowed figures over streams and batches.

Streams need a bound on lateness: rows more than ten minutes late are dropped. Windows are aligned to
the epoch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WATERMARK = "10 minutes"
SALTS = 32


def limit_breaches(access: DataFrame, limit: int, width: str = "60 seconds", time: str = "ts",
                   ip: str = "source_ip") -> DataFrame:
    """Windows in which an address exceeded its number of requests: (window_start, ip, n, rejected).

    Works on a stream and on a table. Counting combines before the shuffle, so a busy address costs
    one row per task and window. A stream in update mode tells a breach as soon as it happens and again whenever its
    count grows, see ``latest``; in append mode a window comes once, when the watermark has passed it.
    """
    source = access.withWatermark(time, WATERMARK) if access.isStreaming else access
    counted = source.groupBy(F.window(time, width).alias("w"), F.col(ip).alias("source_ip")).agg(
        F.count("*").alias("n")
    )
    return counted.filter(F.col("n") > limit).select(
        F.col("w.start").alias("window_start"), "source_ip", "n", (F.col("n") - limit).alias("rejected")
    )


def latest(told: DataFrame) -> DataFrame:
    """The last word on each window from the rows a stream told in update mode: counts only grow."""
    return told.groupBy("window_start", "source_ip").agg(F.max("n").alias("n"), F.max("rejected").alias("rejected"))


def rejected_requests(access: DataFrame, limit: int, seconds: int = 60, time: str = "ts",
                      ip: str = "source_ip", tie_break: str = "event_id") -> DataFrame:
    """The requests beyond the limit themselves (tables only): all but the first ones of their window.

    An address may send a third of all requests in one window. The first ``limit`` are therefore found
    per salt and then among these few, and every request is compared with the last admitted one, again per salt.
    """
    slot = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds)
    rows = access.withColumn("slot", slot)
    salt = F.pmod(F.xxhash64(tie_break), F.lit(SALTS)).cast("int")
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(time, tie_break))
    admitted = (
        rows.select(ip, "slot", time, tie_break)
        .withColumn("salt", salt)
        .withColumn("nth", nth(ip, "slot", "salt")).filter(F.col("nth") <= limit)
        .withColumn("nth", nth(ip, "slot")).filter(F.col("nth") <= limit)
    )
    last = admitted.groupBy(ip, "slot").agg(
        F.max(F.struct(time, tie_break)).alias("last"), F.count("*").alias("admitted")
    ).filter(F.col("admitted") == limit)
    # Only windows that reached the limit are copied, once per salt.
    last = last.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(last, [ip, "slot", "salt"]).filter(
        F.struct(time, tie_break) > F.col("last")).select(*access.columns)


def rolling_counts(jobs: DataFrame, time: str = "created_at", width: str = "24 hours",
                   slide: str = "1 hour") -> DataFrame:
    """Jobs per sliding window: (window_end, n)."""
    source = jobs.withWatermark(time, WATERMARK) if jobs.isStreaming else jobs
    if not jobs.isStreaming and width != slide:
        # Count per step first: each row then enters the overlapping windows as one small total.
        steps = source.groupBy(F.window(time, slide).alias("s")).agg(F.count("*").alias("c"))
        return steps.select(F.col("s.start").alias("t"), "c").groupBy(F.window("t", width, slide).alias("w")).agg(
            F.sum("c").alias("n")
        ).select(F.col("w.end").alias("window_end"), "n")
    return source.groupBy(F.window(time, width, slide).alias("w")).agg(F.count("*").alias("n")).select(
        F.col("w.end").alias("window_end"), "n"
    )
