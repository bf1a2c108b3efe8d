"""End-to-end triage of a batch of artifacts as DataFrame stages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.email import header, parse_eml, tool_output_json
from ..functions.pii import scrub
from ..functions.prompts import email_prompt, synthesis_prompt
from ..functions.scoring import ML_THRESHOLD
from ..operators import correlate, intel, iocs, report
from ..operators.email_checks import email_reports
from ..operators.log_checks import log_reports
from ..operators.phishing_model import classifier_text, ml_check
from ..session import materialize
from ..sources.artifacts import unsupported_reports
from ..sources.csv_logs import parse_logs
from ..sources.eml import parse_messages
from ..sources.rule_pack import RulePack

TIER1 = (
    "job_id string, scrubbed_payload string, artifact_type string, risk_score int, verdict string, "
    "matched_rules array<string>, checks array<struct<name:string,result:string,detail:string>>, "
    "extracted struct<sender:string,sender_domain:string,urls:array<string>,ips:array<string>,"
    "domains:array<string>,header_ips:array<string>,unique_ips:array<string>,record_count:bigint,"
    "user_count:bigint,sigma_rules_loaded:int>, ml_score double"
)
_EXTRACTED = [
    ("sender", "string"), ("sender_domain", "string"), ("urls", "array<string>"), ("ips", "array<string>"),
    ("domains", "array<string>"), ("header_ips", "array<string>"), ("unique_ips", "array<string>"),
    ("record_count", "bigint"), ("user_count", "bigint"), ("sigma_rules_loaded", "int"),
]


def _aligned(reports: DataFrame, artifact_type: Column | None = None) -> DataFrame:
    """Reports of one artifact type in the common schema."""
    have = set(reports.schema["extracted"].dataType.names) if "extracted" in reports.columns else set()
    fields = [
        (F.col(f"extracted.{n}") if n in have else F.lit(None)).cast(t).alias(n) for n, t in _EXTRACTED
    ]
    kind = artifact_type if artifact_type is not None else F.col("artifact_type")
    payload = [c for c in reports.columns if c == "scrubbed_payload"]
    return reports.select(
        "artifact_id", *payload, kind.alias("artifact_type"), F.col("risk_score").cast("int").alias("risk_score"),
        "verdict", "matched_rules", "checks", F.struct(*fields).alias("extracted"),
    )


def tier1(artifacts: DataFrame, pack: RulePack | None = None, ml_scores: DataFrame | None = None,
          threshold: float = ML_THRESHOLD, file_types: list[str] | None = None) -> DataFrame:
    """Tier-1 results of accepted artifacts (artifact_id, file_type, raw).

    ``file_types`` names the types that occur, where the caller knows: branches of others are left out.

    Rules run on the raw text. ``ml_scores`` (artifact_id, ml_score) comes from a model that was given
    the scrubbed text; without it the model check is marked as skipped.
    """
    typed = lambda t: artifacts.filter(F.col("file_type") == t).select(
        "artifact_id", "file_type", "raw", scrub("raw").alias("scrubbed_payload")
    )
    # A mail is one row from reading to report, so its text is never shuffled.
    mails = lambda: _aligned(email_reports(parse_messages(typed("Eml")), ["scrubbed_payload"]))

    # Log checks group by artifact; their reports are joined with the texts afterwards.
    def logs() -> DataFrame:
        texts = typed("Csv")
        rows = log_reports(texts.select("artifact_id"), parse_logs(texts.select("artifact_id", "raw")), pack)
        return texts.select("artifact_id", "scrubbed_payload").join(_aligned(rows), "artifact_id")

    other = lambda: _aligned(unsupported_reports(typed("Json"), ["scrubbed_payload"]), F.lit("Json"))
    branches = {"Eml": mails, "Csv": logs, "Json": other}
    wanted = [t for t in branches if file_types is None or t in file_types] or ["Json"]
    joined = reduce(DataFrame.unionByName, [branches[t]() for t in wanted])
    if ml_scores is not None:
        joined = joined.join(ml_scores.select("artifact_id", "ml_score"), "artifact_id", "left")
    else:
        joined = joined.withColumn("ml_score", F.lit(None).cast("double"))
    is_mail = F.col("artifact_type") == "Eml"
    ml = F.when(is_mail, F.col("ml_score"))
    by_model = F.coalesce(ml >= threshold, F.lit(False))
    return joined.select(
        F.col("artifact_id").alias("job_id"), "scrubbed_payload", "artifact_type", "risk_score",
        F.when(by_model, "Suspicious").otherwise(F.col("verdict")).alias("verdict"),
        "matched_rules",
        F.when(is_mail, F.concat("checks", F.array(ml_check(ml, threshold)))).otherwise(F.col("checks")).alias("checks"),
        "extracted", ml.alias("ml_score"),
    )


def classifier_inputs(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, text) that the phishing model is given: scrubbed mails only."""
    m = parse_eml(scrub("raw"))
    return artifacts.filter(F.col("file_type") == "Eml").select("artifact_id", m.alias("m")).select(
        "artifact_id", classifier_text(header("m.headers", "Subject"), F.col("m.body")).alias("text")
    )


def analyst_prompts(tier1_results: DataFrame) -> DataFrame:
    """(job_id, prompt) for the suspicious mails of a batch."""
    mails = tier1_results.filter((F.col("artifact_type") == "Eml") & (F.col("verdict") == "Suspicious"))
    m = mails.select("job_id", "scrubbed_payload", "matched_rules", parse_eml("scrubbed_payload").alias("m"))
    tools = tool_output_json("m.headers", "m.body", "scrubbed_payload")
    return m.select("job_id", email_prompt("scrubbed_payload", "matched_rules", tools).alias("prompt"))


def synthesis_prompts(bundles: DataFrame) -> DataFrame:
    """(job_id, prompt) for the final report of the jobs of a batch, similar incidents beside the evidence."""
    evidence = F.to_json(F.struct(*[F.col(c) for c in bundles.columns if c != "similar"]))
    return bundles.select("job_id", synthesis_prompt(evidence, F.col("similar")).alias("prompt"))


def pending_tier2(tier1_results: DataFrame) -> DataFrame:
    return tier1_results.filter(F.col("verdict") == "Suspicious")


@dataclass
class Tier2:
    iocs: DataFrame
    intel: DataFrame
    activity: DataFrame
    bundles: DataFrame
    reports: DataFrame
    failed: DataFrame
    waiting: DataFrame


def tier2(jobs: DataFrame, tier1_results: DataFrame, cache: DataFrame, feed: DataFrame, activity: DataFrame,
          at: Column, email_responses: DataFrame | None = None, synthesis_responses: DataFrame | None = None,
          similar: DataFrame | Callable[..., DataFrame] | None = None,
          require_email_analysis: bool = False, max_activity: int = correlate.MAX_ACTIVITY) -> Tier2:
    """Indicators, intel, correlation and reports of the suspicious jobs of a batch.

    ``similar`` has (job_id, similar), or is a function that finds it for (pending, iocs, analyses). The
    newest ``max_activity`` log rows of a job are listed; all of them are counted.
    Without model answers every job gets a deterministic report. Where answers are given, mails whose attempts are all
    unusable fail, as do jobs of which no synthesis attempt is; jobs that nobody has answered yet are returned as
    waiting for their synthesis. With ``require_email_analysis`` mails without an answer fail as well. Jobs that fail
    are returned with their message.
    """
    spark = jobs.sparkSession
    pending = pending_tier2(tier1_results)
    found = iocs.seed(iocs.extracted_candidates(pending, "job_id"), spark.createDataFrame([], "job_id string, type string, value string"))
    no_fail = spark.createDataFrame([], "job_id string, error_message string")
    failed, analyses = no_fail, None
    if email_responses is not None:
        outcomes = report.analysis_outcomes(email_responses)
        analyses = outcomes.filter("outcome = 'accepted'").select("job_id", "analysis")
        found = iocs.merge_model_iocs(found, iocs.analysis_iocs(analyses))
        refused = pending.join(outcomes.filter("outcome = 'failed'").select("job_id"), "job_id", "left_semi")
        failed = failed.unionByName(refused.select("job_id", F.lit("No usable email analysis.").alias("error_message")))
    if require_email_analysis:
        mails = pending.filter(F.col("artifact_type") == "Eml").select("job_id")
        lacking = mails if analyses is None else mails.join(outcomes.select("job_id"), "job_id", "left_anti")
        failed = failed.unionByName(lacking.withColumn("error_message", F.lit("No usable email analysis.")))
    # Both are stored and read by correlation and reports: computed once.
    found = materialize(found, "tier2-iocs")
    looked_up = materialize(intel.enrich(found, cache, feed, at), "tier2-intel")
    events = correlate.correlate_activity(found, activity, max_activity)
    near = similar(pending, found, analyses) if callable(similar) else similar
    bundles = correlate.evidence_bundles(
        jobs.join(pending.select(F.col("job_id").alias("id")), "id", "left_semi")
        .join(failed.select(F.col("job_id").alias("id")), "id", "left_anti"),
        pending, found, looked_up, events, near, analyses, correlate.activity_totals(found, activity),
    )
    waiting = bundles.select("job_id").limit(0)
    if synthesis_responses is None:
        reports = report.deterministic_reports(bundles, at)
    else:
        outcomes = report.synthesis_outcomes(synthesis_responses).join(bundles.select("job_id"), "job_id", "left_semi")
        reports = outcomes.filter("outcome = 'accepted'").select("job_id", "report.*").withColumn("created_at", at)
        failed = failed.unionByName(outcomes.filter("outcome = 'failed'").select(
            "job_id", F.lit("No answer satisfied the report contract.").alias("error_message")))
        waiting = bundles.select("job_id").join(outcomes.select("job_id"), "job_id", "left_anti")
    return Tier2(found, looked_up, events, bundles, reports, failed, waiting)
