"""Continuous triage: new files are picked up, checked, and reported batch by batch.

A file is read once per batch. Delivery is at least once; results are exactly once. A batch owns one partition of every result table
and overwrites it on replay, and artifacts that another batch has finished are dropped by an anti join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import stages, triage
from ..plans.incident_memory import IncidentMemory
from ..schemas import ACTIVITY, INTEL, INTEL_FEED, REPORT
from ..session import materialize, scratch_scope
from ..sources import sinks
from ..sources.artifacts import BINARY_SCHEMA, as_text, describe, read_error, split_intake
from ..sources.rule_pack import RulePack

IOC_ROWS = "job_id string, type string, value string, extracted_by string, pos int"
# Ids of 64 characters: the side that is broadcast stays below ten megabytes.
BROADCAST_IDS = 100_000
JOBS = (
    "id string, file_name string, file_type string, status string, current_step string, "
    "error_message string, created_at timestamp, started_at timestamp, finished_at timestamp"
)


def artifact_stream(spark: SparkSession, folder: str, files_per_trigger: int = 10_000) -> DataFrame:
    return describe(
        spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    )


def process_batch(batch: DataFrame, batch_id: int, root: str, pack: RulePack | None,
                  cache: DataFrame | None = None, feed: DataFrame | None = None, activity: DataFrame | None = None,
                  classifier: Callable[[DataFrame], DataFrame] | None = None, email_answers: DataFrame | None = None,
                  synthesis_answers: DataFrame | None = None, version: str = "1") -> None:
    """Both tiers of one micro-batch, written to the result tables below ``root``.

    ``classifier`` turns (artifact_id, text) of scrubbed mails into (artifact_id, ml_score). Answers are tables
    (job_id, attempt, response); the prompts of the batch are written to ``prompts``. Earlier incidents are found and
    the batch's own are stored under ``version`` of the vectoriser.
    """
    with scratch_scope(batch.sparkSession):
        _process(batch, batch_id, root, pack, cache, feed, activity, classifier, email_answers, synthesis_answers, version)


def _process(batch: DataFrame, batch_id: int, root: str, pack: RulePack | None, cache: DataFrame | None,
             feed: DataFrame | None, activity: DataFrame | None, classifier: Callable[[DataFrame], DataFrame] | None,
             email_answers: DataFrame | None, synthesis_answers: DataFrame | None, version: str) -> None:
    spark = batch.sparkSession
    known = sinks.read_other_batches(spark, root, "tier1_results", triage.TIER1, batch_id).select(
        F.col("job_id").alias("artifact_id")
    )
    # Compare ids first and fetch contents afterwards: the file contents stay out of the shuffle.
    ids = materialize(
        batch.select("artifact_id").distinct().join(known, "artifact_id", "left_anti"), "stream-ids"
    )
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    # Both tiers read the batch several times; a written copy is read by type and by column.
    fresh = materialize(batch.join(ids, "artifact_id", "left_semi"), "stream-batch")
    accepted, rejected = split_intake(fresh)
    sinks.write_batch(rejected, root, "quarantine", batch_id)
    # Value or error per artifact: what cannot be read becomes a failed job with its message.
    accepted = accepted.withColumn("read_error", read_error("content", "length"))
    texts = as_text(accepted.where("read_error is null").drop("read_error"))
    # One moment for the whole batch: each write would otherwise see its own.
    now = F.lit(spark.range(1).select(F.current_timestamp()).first()[0])

    present = [r["file_type"] for r in accepted.select("file_type").distinct().collect()]  # three at most
    ml_scores = classifier(triage.classifier_inputs(texts)) if classifier is not None and "Eml" in present else None
    results = triage.tier1(texts, pack, ml_scores, file_types=present)
    sinks.write_batch(results, root, "tier1_results", batch_id)
    # Read back what was written: the second tier works on the stored rows, not on a recomputation.
    stored = spark.read.schema(triage.TIER1).parquet(
        f"{sinks.table_path(root, 'tier1_results')}/batch_id={batch_id}"
    )
    jobs = accepted.select(
        F.col("artifact_id").alias("id"), "file_name", "file_type", F.lit("Filtering").alias("status"),
        F.lit("tier1.filtering").alias("current_step"), F.col("read_error").alias("error_message"),
        "created_at", now.alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"),
    )
    jobs = materialize(stages.after_tier1(jobs, stored, now).select(
        *[c.split()[0] for c in JOBS.split(", ")]
    ), "stream-jobs")
    empty = lambda schema: spark.createDataFrame([], schema)
    memory = IncidentMemory(spark, root, version)
    earlier = sinks.read_other_batches(spark, root, "threat_intel", INTEL, batch_id)
    done = triage.tier2(
        jobs, stored, earlier if cache is None else earlier.unionByName(cache),
        feed if feed is not None else empty(INTEL_FEED),
        activity if activity is not None else empty(ACTIVITY), now, email_answers, synthesis_answers,
        memory.similar(batch_id),
    )
    # Read by the reports, the prompts and what waits.
    done.bundles = materialize(done.bundles, "stream-bundles")
    intel_new = done.intel.filter(~F.col("cached")).drop("cached")
    sinks.write_batch(done.iocs, root, "iocs", batch_id)
    sinks.write_batch(intel_new, root, "threat_intel", batch_id)
    sinks.write_batch(done.reports, root, "reports", batch_id)
    reports = spark.read.schema(REPORT).parquet(f"{sinks.table_path(root, 'reports')}/batch_id={batch_id}")
    memory.remember(reports, spark.read.schema(IOC_ROWS).parquet(f"{sinks.table_path(root, 'iocs')}/batch_id={batch_id}"), batch_id)
    sinks.write_batch(
        triage.analyst_prompts(stored).withColumn("kind", F.lit("email_analysis"))
        .unionByName(triage.synthesis_prompts(done.bundles).withColumn("kind", F.lit("synthesis"))), root, "prompts", batch_id)
    sinks.write_batch(stages.after_tier2(jobs, reports, done.failed, now, done.waiting), root, "jobs", batch_id)


def start_triage(spark: SparkSession, folder: str, root: str, checkpoint: str, pack: RulePack | None = None,
                 available_now: bool = False, **sources) -> StreamingQuery:
    """Start the stream; ``available_now`` processes what is there and stops. ``sources`` go to ``process_batch``."""
    writer = artifact_stream(spark, folder).writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.foreachBatch(
        lambda batch, batch_id: process_batch(batch, batch_id, root, pack, **sources)
    ).start()


def unique_messages(messages: DataFrame, time: str = "ts") -> DataFrame:
    """Usable queue messages with redeliveries inside ten minutes removed."""
    usable, _ = stages.split_messages(messages)
    return usable.withWatermark(time, "10 minutes").dropDuplicatesWithinWatermark(["job_id"])
