"""Order of the pipeline stages, resumption, and skipping of finished work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_col

# Stages of the second tier; logs skip the first.
TIER2_STEPS = ["tier2.email_analysis", "tier2.threat_intel", "tier2.synthesis_pending", "tier2.synthesis"]


def path_for(file_type: Column | str) -> Column:
    steps = [F.lit(s) for s in TIER2_STEPS]
    return F.when(as_col(file_type) == "Eml", F.array(*steps)).otherwise(F.array(*steps[1:]))


def next_step(step: Column | str) -> Column:
    """Step after the given one, ``done`` after the last; null for steps outside of the path."""
    s = as_col(step)
    return F.coalesce(*[F.when(s == a, F.lit(b)) for a, b in zip(TIER2_STEPS, TIER2_STEPS[1:] + ["done"])])


def entry_step(file_type: Column | str, current_step: Column | str) -> Column:
    """Where a job enters: at synthesis when it was left waiting for it, else at the start of its path."""
    return F.when(as_col(current_step) == "tier2.synthesis_pending", F.lit("tier2.synthesis")).otherwise(
        F.element_at(path_for(file_type), 1)
    )


def not_yet_filtered(jobs: DataFrame, tier1_results: DataFrame) -> DataFrame:
    """Jobs without a tier-1 result: a redelivered job is dropped here."""
    return jobs.join(tier1_results.select(F.col("job_id").alias("id")), "id", "left_anti")


def ready_for_tier2(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Jobs in analysis that have no report yet, with the step they enter at."""
    waiting = jobs.filter(F.col("status") == "Analyzing").join(
        reports.select(F.col("job_id").alias("id")), "id", "left_anti"
    )
    return waiting.withColumn("enter_at", entry_step("file_type", "current_step"))


def after_tier1(jobs: DataFrame, tier1_results: DataFrame, at: Column) -> DataFrame:
    """New state of jobs: suspicious ones go on, benign ones are done, broken ones have failed.

    A job without a result carries its ``error_message`` when reading it failed.
    """
    joined = jobs.drop("verdict").join(
        tier1_results.select(F.col("job_id").alias("id"), "verdict"), "id", "left"
    )
    v = F.col("verdict")
    return joined.withColumn(
        "status", F.when(v == "Suspicious", "Analyzing").when(v == "Benign", "Done").otherwise("Failed")
    ).withColumn(
        "current_step", F.when(v == "Suspicious", "tier2.pending").when(v == "Benign", "tier1.done").otherwise("tier1.failed")
    ).withColumn("finished_at", F.when(v == "Suspicious", F.lit(None).cast("timestamp")).otherwise(at)).withColumn(
        "error_message", F.when(v.isNotNull(), F.lit(None).cast("string"))
        .otherwise(F.coalesce("error_message", F.lit("No Tier 1 result.")))
    )


def after_tier2(jobs: DataFrame, reports: DataFrame, failed: DataFrame, at: Column,
                waiting: DataFrame | None = None) -> DataFrame:
    """New state of jobs of the second tier; ``waiting`` (job_id) are those whose synthesis is to come."""
    joined = jobs.join(
        reports.select(F.col("job_id").alias("id"), F.lit(True).alias("reported")), "id", "left"
    ).join(failed.select(F.col("job_id").alias("id"), F.col("error_message").alias("failure")), "id", "left")
    if waiting is None:
        waits = F.lit(False)
    else:
        joined = joined.join(waiting.select(F.col("job_id").alias("id"), F.lit(True).alias("waits")), "id", "left")
        waits = F.coalesce("waits", F.lit(False))
    ok, bad = F.col("reported"), F.col("failure").isNotNull()
    return joined.select(*[
        {
            "status": F.when(ok, "Done").when(bad, "Failed").otherwise(F.col("status")),
            "current_step": F.when(ok, "done").when(bad, "tier2.failed")
            .when(waits, "tier2.synthesis_pending").otherwise(F.col("current_step")),
            "error_message": F.coalesce("failure", "error_message"),
            "finished_at": F.when(ok | bad, at).otherwise(F.col("finished_at")),
        }.get(c, F.col(c)).alias(c)
        for c in jobs.columns
    ])


def parse_job_messages(messages: DataFrame, body: str = "value") -> DataFrame:
    """Queue messages with ``job_id``, null for poison ones."""
    uuid = r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
    job_id = F.from_json(F.col(body).cast("string"), "jobId string")["jobId"]
    return messages.withColumn("job_id", F.when(F.rlike(job_id, F.lit(uuid)), F.lower(job_id)))


def split_messages(messages: DataFrame, body: str = "value") -> tuple[DataFrame, DataFrame]:
    """(usable, dead letters); dead letters are kept, not retried."""
    parsed = parse_job_messages(messages, body)
    return parsed.filter(F.col("job_id").isNotNull()), parsed.filter(F.col("job_id").isNull()).drop("job_id")
