"""Deterministic incident reports from evidence bundles: a projection, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import responses, scoring
from ..functions.text import compact

MARKER = "[generated without LLM]"

# Fixed value: the closing note of a report that no model wrote.
NO_MODEL_NOTE = (
    "_LLM synthesis unavailable (no Llm:ApiKey configured); this report was generated from structured "
    "evidence only. Re-run with an LLM key for a full analyst narrative._"
)

# Recommended actions by artifact type, and the one for correlated activity.
EMAIL_ACTIONS = [
    "Quarantine the email and block the sender address/domain at the mail gateway.",
    "Add the extracted URLs/IPs to the proxy and DNS blocklists.",
    "Notify recipients and reset credentials of anyone who may have interacted with the email.",
]
LOG_ACTIONS = [
    "Disable or rotate credentials of the flagged user accounts pending review.",
    "Block the flagged source IPs at the network perimeter.",
    "Review the flagged high-risk API calls with the account owner.",
]
CORRELATED_ACTION = "Investigate the correlated CloudTrail activity from the IOC source IPs."


def _lits(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _str(col: Column) -> Column:
    return col.cast("string")


def max_intel(iocs: Column) -> Column:
    return F.array_max(F.flatten(F.transform(
        iocs, lambda i: F.transform(i["intel"], lambda r: r["malicious_score"])
    )))


def _answers(intel: Column, line: Callable[[Column], Column], runs: bool) -> Column:
    """A line per intel row; equal rows that are one entry are written once and repeated."""
    if not runs:
        return F.transform(intel, line)
    return F.flatten(F.transform(intel, lambda r: F.array_repeat(line(r), r["times"].cast("int"))))


def intel_rows(iocs: Column, runs: bool = False) -> Column:
    """Number of intel rows of all indicators."""
    rows = lambda i: F.aggregate(i["intel"], F.lit(0), lambda n, r: n + r["times"].cast("int")) if runs else F.size(i["intel"])
    return F.aggregate(iocs, F.lit(0), lambda n, i: n + rows(i))


def mitre(artifact_type: Column, iocs: Column, rules: Column) -> Column:
    has_url = F.exists(iocs, lambda i: i["type"] == "Url")
    return F.when(artifact_type == "Eml", scoring.email_techniques(has_url, rules)).otherwise(
        scoring.log_techniques(rules)
    )


def actions(artifact_type: Column, activity: Column) -> Column:
    base = F.when(artifact_type == "Eml", _lits(EMAIL_ACTIONS)).otherwise(_lits(LOG_ACTIONS))
    return F.concat(base, compact(F.when(F.size(activity) > 0, F.lit(CORRELATED_ACTION))))


def _origin(live: Column) -> Column:
    return F.when(live, "live API").otherwise("heuristic analysis only")


def summary(e: dict[str, Column], risk: Column, severity: Column, runs: bool = False) -> Column:
    """Markdown summary; ``e`` maps evidence field names to Columns, ``runs`` tells that equal intel rows are one entry."""
    code = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    rules, iocs, activity, analysis = e["matched_rules"], e["iocs"], e["activity"], e["analysis"]
    lookups = intel_rows(iocs, runs)
    score = _shown(runs)
    ioc_lines = F.transform(iocs, lambda i: F.concat(
        F.lit("  - "), code(i["type"]), F.lit(" "), code(i["value"]), F.lit(" ("), i["extracted_by"], F.lit(") — "),
        F.when(F.size(i["intel"]) == 0, "not enriched").otherwise(F.array_join(
            _answers(i["intel"], lambda r: F.concat(
                r["source"], F.lit(" score "), score(r), F.lit(" ("), _origin(r["from_live_api"]), F.lit(")")), runs), "; ")),
    ))
    lines = F.concat(
        F.array(
            F.lit(MARKER), F.lit(""),
            F.lit("## Incident summary (rule-based, no LLM synthesis)"), F.lit(""),
            F.concat(F.lit("- Artifact: "), code(e["file_name"]), F.lit(" ("), e["artifact_type"], F.lit(")")),
            F.concat(
                F.lit("- Tier 1 verdict: **"), e["tier1_verdict"], F.lit("** (rule score "), _str(e["rule_score"]), F.lit("/100"),
                F.when(e["ml_score"].isNotNull(), F.format_string(", ML phishing probability %.3f", e["ml_score"])).otherwise(""),
                F.lit(")"),
            ),
            F.concat(F.lit("- Matched rules: "), F.when(F.size(rules) > 0, F.array_join(F.transform(rules, code), ", ")).otherwise("none")),
            F.concat(F.lit("- IOCs: "), _str(F.size(iocs)), F.lit(" ("), _str(lookups), F.lit(" threat intel lookups)")),
        ),
        ioc_lines,
        compact(
            F.when(analysis.isNotNull(), F.concat(
                F.lit("- Email analyst: "), analysis["status"],
                F.format_string(" (confidence %.2f) — ", analysis["confidence"]), analysis["summary"])),
            F.when(e["activity_total"] > 0, F.concat(
                F.lit("- Correlated CloudTrail events: "), _str(e["activity_total"]), F.lit(" (source IP matches an IOC)"))),
        ),
        F.array(
            F.lit(""),
            F.concat(F.format_string("**Risk score: %.1f/10 — severity: ", risk), severity, F.lit("**")),
            F.lit(""),
            F.lit(NO_MODEL_NOTE),
            F.lit(""),
        ),
    )
    return F.array_join(lines, "\n")


def _shown(runs: bool) -> Callable[[Column], Column]:
    return (lambda r: r["shown"]) if runs else (lambda r: F.format_string("%.2f", r["malicious_score"]))


def evidence_trail(e: dict[str, Column], risk: Column, runs: bool = False) -> Column:
    """array<struct<claim, source>>: every figure of the report with its origin."""
    item = lambda claim, source: F.struct(claim.alias("claim"), source.alias("source"))
    rules, analysis = e["matched_rules"], e["analysis"]
    tier1 = item(
        F.concat(
            F.lit("Tier 1 verdict "), e["tier1_verdict"], F.lit(" with rule score "), _str(e["rule_score"]), F.lit("/100"),
            F.when(F.size(rules) > 0, F.concat(F.lit("; matched rules: "), F.array_join(rules, ", "))).otherwise(""),
        ),
        F.lit("tier1.rule_check_results"),
    )
    ml = F.when(e["ml_score"].isNotNull(), item(F.format_string("ML phishing probability %.3f.", e["ml_score"]), F.lit("ml_score")))
    score = _shown(runs)
    intel = F.flatten(F.transform(e["iocs"], lambda i: _answers(i["intel"], lambda r: item(
        F.concat(i["type"], F.lit(" "), i["value"], F.lit(" scored "), score(r), F.lit(" by "), r["source"], F.lit(" ("),
                 _origin(r["from_live_api"]), F.lit(").")),
        F.concat(F.lit("intel:"), r["source"]),
    ), runs)))
    email = F.when(analysis.isNotNull(), item(
        F.concat(F.lit("Email analyst verdict "), analysis["status"],
                 F.format_string(" (confidence %.2f): ", analysis["confidence"]), analysis["summary"]),
        F.lit("email_analysis"),
    ))
    activity = F.transform(e["activity"], lambda a: item(
        F.concat(
            F.lit("CloudTrail event "), a["event_name"], F.lit(" from "), F.coalesce(a["source_ip"], F.lit("unknown IP")),
            F.lit(" by "), F.coalesce(a["user_identity"], F.lit("unknown identity")),
            F.lit(" at "), F.date_format(a["event_time"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0+00:00."),
        ),
        F.lit("cloudtrail"),
    ))
    final = item(
        F.format_string("Deterministic risk score %.1f/10 (rule score, ML score, intel scores, email verdict).", risk),
        F.lit("deterministic_scoring"),
    )
    return F.concat(F.array(tier1), compact(ml), intel, compact(email), activity, F.array(final))


def deterministic_reports(bundles: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Report rows from evidence bundles."""
    scored = bundles.withColumn("risk", scoring.risk_score(
        F.col("rule_score"), F.col("ml_score"), max_intel(F.col("iocs")), F.col("analysis.status") == "Phishing"
    )).withColumn("severity", scoring.severity_band("risk"))
    e = {c: F.col(c) for c in bundles.columns}
    runs = "times" in bundles.schema["iocs"].dataType.elementType["intel"].dataType.elementType.names
    return scored.select(
        "job_id", F.col("risk").alias("risk_score"), "severity",
        summary(e, F.col("risk"), F.col("severity"), runs).alias("summary"),
        mitre(e["artifact_type"], e["iocs"], e["matched_rules"]).alias("mitre"),
        actions(e["artifact_type"], e["activity"]).alias("actions"),
        evidence_trail(e, F.col("risk"), runs).alias("evidence"),
        (created_at if created_at is not None else F.current_timestamp()).alias("created_at"),
    )


def with_violations(reports: DataFrame) -> DataFrame:
    return reports.withColumn("violations", scoring.report_violations(
        F.col("risk_score"), F.col("severity"), F.col("mitre"), F.size("evidence")
    ))


def split_valid(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined with their violations)."""
    checked = with_violations(reports)
    return (
        checked.filter(F.size("violations") == 0).drop("violations"),
        checked.filter(F.size("violations") > 0),
    )


def first_usable(attempts: DataFrame, usable: Column, max_attempts: int | None = None) -> DataFrame:
    """Outcome per job of its numbered attempts: the first usable one, else failed. ``max_attempts`` ignores later ones.

    A grouped minimum instead of a ranking: it combines before the shuffle.
    """
    payload = [c for c in attempts.columns if c not in ("job_id", "attempt")]
    considered = F.lit(True) if max_attempts is None else F.col("attempt") <= max_attempts
    ok = considered & F.coalesce(usable, F.lit(False))
    return attempts.groupBy("job_id").agg(
        F.min(F.when(ok, F.col("attempt"))).alias("attempt"),
        F.min_by(F.struct(*payload), F.when(ok, F.col("attempt"))).alias("picked"),
        F.count(F.when(considered, True)).alias("tried"),
    ).select(
        "job_id",
        F.when(F.col("attempt").isNull(), "failed").otherwise("accepted").alias("outcome"),
        "attempt", "tried",
        *[F.when(F.col("attempt").isNotNull(), F.col(f"picked.{c}")).alias(c) for c in payload],
    )


def synthesis_outcomes(responses_df: DataFrame, max_attempts: int | None = None) -> DataFrame:
    """(job_id, attempt, response) to the accepted report per job, or a failure."""
    parsed = responses_df.withColumn("report", responses.synthesis("response"))
    r = F.col("report")
    valid = r.isNotNull() & (F.size(scoring.report_violations(
        r["risk_score"], r["severity"], r["mitre"], F.size(r["evidence"]))) == 0)
    return first_usable(parsed.withColumn("valid", valid), F.col("valid"), max_attempts).drop("valid")


def analysis_outcomes(responses_df: DataFrame, max_attempts: int | None = None) -> DataFrame:
    """(job_id, attempt, response) to the accepted e-mail analysis per job, or a failure."""
    parsed = responses_df.withColumn("analysis", responses.email_analysis("response"))
    return first_usable(parsed, F.col("analysis").isNotNull(), max_attempts)
