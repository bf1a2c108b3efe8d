"""Threat-intel enrichment: time-limited cache, feed answers, heuristic fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.heuristics import heuristic
from ..functions.text import as_col
from ..sources.intel_feed import ABUSE, VT, parse_feed

CACHE_HOURS = 24
KEY = ["type", "value", "source"]


def applicable_sources(type_col: Column | str) -> Column:
    """Services that can judge an indicator type; none for mail addresses."""
    kind = as_col(type_col)
    return (
        F.when(kind == "Ip", F.array(F.lit(VT), F.lit(ABUSE)))
        .when(kind.isin("Domain", "Url", "Hash"), F.array(F.lit(VT)))
        .otherwise(F.array().cast("array<string>"))
    )


def with_sources(iocs: DataFrame) -> DataFrame:
    """One row per indicator and service. The mapping is a constant, so it needs no join."""
    return iocs.withColumn("source", F.explode(applicable_sources("type")))


def lookup_keys(iocs: DataFrame) -> DataFrame:
    """Distinct (type, value, source): what many jobs share is looked up once."""
    return with_sources(iocs.select("type", "value").distinct())


def cached_at(cache: DataFrame, at: Column, hours: int = CACHE_HOURS) -> DataFrame:
    """Newest row per key that is younger than the time limit at one moment."""
    fresh = cache.filter(
        (F.col("looked_up_at") > at - F.make_dt_interval(hours=F.lit(hours))) & (F.col("looked_up_at") <= at)
    )
    rest = [c for c in cache.columns if c not in KEY]
    return fresh.groupBy(*KEY).agg(
        F.max_by(F.struct(*rest), F.struct("looked_up_at", F.struct(*rest))).alias("row")
    ).select(*KEY, *[F.col(f"row.{c}").alias(c) for c in rest])


def cached_as_of(lookups: DataFrame, cache: DataFrame, hours: float = CACHE_HOURS,
                 bucket_minutes: int = 60) -> DataFrame:
    """Per lookup (type, value, source, at, ...) the newest cache row not older than the limit.

    Each key is cut into time buckets, so that a key with a third of all rows spreads over many
    tasks. The newest row of every earlier bucket is carried forward on a table with one row per key
    and bucket; the search inside a bucket is a window over that bucket only.
    """
    width = bucket_minutes * 60
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / width)
    extra = [c for c in lookups.columns if c not in KEY]
    rest = [c for c in cache.columns if c not in KEY]
    hit = F.struct(*[F.col(c) for c in rest])

    stored = cache.select(*KEY, bucket("looked_up_at").alias("bucket"), F.col("looked_up_at").alias("t"), hit.alias("hit"))
    asked = lookups.select(*KEY, bucket("at").alias("bucket"), F.col("at").alias("t"), F.struct(*extra).alias("ask"))

    newest = stored.groupBy(*KEY, "bucket").agg(F.max_by("hit", F.struct("t", "hit")).alias("hit"))
    wanted = asked.select(*KEY, "bucket").distinct()
    no_hit = F.lit(None).cast(stored.schema["hit"].dataType)
    steps = newest.unionByName(wanted.withColumn("hit", no_hit)).groupBy(*KEY, "bucket").agg(
        F.first("hit", ignorenulls=True).alias("hit")
    )
    before = Window.partitionBy(*KEY).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        steps.withColumn("hit", F.last("hit", ignorenulls=True).over(before))
        .filter(F.col("hit").isNotNull())
        .select(*KEY, "bucket", F.col("hit.looked_up_at").alias("t"), "hit")
        # The carried row must be inside the time limit at the start of the bucket at least.
        .filter(
            F.unix_micros(F.col("t").cast("timestamp"))
            > F.col("bucket") * width * 1_000_000 - int(hours * 3_600_000_000)
        )
    )
    no_ask = F.lit(None).cast(asked.schema["ask"].dataType)
    timeline = (
        stored.unionByName(carried).withColumn("ask", no_ask)
        .unionByName(asked.withColumn("hit", no_hit))
    )
    # A cache row of the same instant counts as present, hence rows with a hit sort first, the largest of them last.
    upto = (
        Window.partitionBy(*KEY, "bucket").orderBy("t", F.col("hit").isNull(), "hit")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    answered = timeline.withColumn("hit", F.last("hit", ignorenulls=True).over(upto)).filter(
        F.col("ask").isNotNull()
    )
    age = F.unix_micros(F.col("t").cast("timestamp")) - F.unix_micros(F.col("hit.looked_up_at").cast("timestamp"))
    valid = age < int(hours * 3_600_000_000)
    return answered.select(
        *KEY,
        *[F.col(f"ask.{c}").alias(c) for c in extra],
        *[F.when(valid, F.col(f"hit.{c}")).alias(c) for c in rest if c not in extra],
    )


def newest_answers(feed: DataFrame) -> DataFrame:
    """Newest parsed feed answer per key."""
    return parse_feed(feed).groupBy(*KEY).agg(
        F.max_by(F.struct("success", "score", "raw", "reason"), F.struct("fetched_at", "success", "score", "raw", "reason")).alias("answer")
    )


def fallback_json(source: Column, value: Column, reason: Column, guess: Column) -> Column:
    return F.to_json(F.struct(
        F.lit(True).alias("fallback"), source.alias("source"), value.alias("ioc"), reason.alias("reason"),
        guess["score"].alias("heuristic_score"), guess["flags"].alias("flags"),
    ))


def enrich(iocs: DataFrame, cache: DataFrame, feed: DataFrame, at: Column,
           hours: int = CACHE_HOURS, no_answer: str = "missing_api_key") -> DataFrame:
    """Intel rows for all distinct keys: cache, else feed, else heuristic.

    A cache hit keeps its own ``from_live_api`` and time and is marked ``cached``; only the other
    rows are new and belong into the cache table.
    """
    keys = lookup_keys(iocs)
    cached = cached_at(cache, at, hours).withColumn("cached", F.lit(True))
    hits = keys.join(cached, KEY, "left")
    full = hits.join(newest_answers(feed), KEY, "left").withColumn("guess", heuristic("type", "value"))
    ok = F.coalesce(F.col("answer.success"), F.lit(False))
    is_hit = F.coalesce(F.col("cached"), F.lit(False))
    reason = F.coalesce("answer.reason", F.lit(no_answer))
    return full.select(
        *KEY,
        F.when(is_hit, F.col("raw_response")).when(ok, F.col("answer.raw"))
        .otherwise(fallback_json(F.col("source"), F.col("value"), reason, F.col("guess"))).alias("raw_response"),
        F.when(is_hit, F.col("malicious_score")).when(ok, F.col("answer.score"))
        .otherwise(F.col("guess.score")).alias("malicious_score"),
        F.when(is_hit, F.col("from_live_api")).otherwise(ok).alias("from_live_api"),
        F.when(is_hit, F.col("looked_up_at")).otherwise(at).alias("looked_up_at"),
        is_hit.alias("cached"),
    )
