"""Risk, severity and verdict arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col, clamp, compact_names, round_half_even

ML_THRESHOLD = 0.7
TECHNIQUE_ID = r"^T\d{4}(\.\d{3})?\n?$"


def verdict(n_rules: Column, ml_score: Column | None = None, threshold: float = ML_THRESHOLD) -> Column:
    """Suspicious when any rule matched or the model score reaches the threshold."""
    hit = n_rules > 0
    if ml_score is not None:
        hit = hit | F.coalesce(ml_score >= threshold, F.lit(False))
    return F.when(hit, "Suspicious").otherwise("Benign")


def rule_family(rule: Column | str) -> Column:
    return F.substring_index(as_col(rule), ":", 1)


def log_risk_score(n_families: Column) -> Column:
    return F.least(F.lit(100), n_families.cast("int") * 15)


def risk_score(rule_score: Column, ml_score: Column, max_intel: Column, phishing: Column) -> Column:
    """Weighted 0-10 risk: rules 4, model 3, intel 2, analyst verdict 1; one digit, half to even."""
    total = (
        rule_score / F.lit(100.0) * 4.0
        + F.coalesce(ml_score, F.lit(0.0)) * 3.0
        + F.coalesce(max_intel, F.lit(0.0)) * 2.0
        + F.when(F.coalesce(phishing, F.lit(False)), 1.0).otherwise(0.0)
    )
    return round_half_even(clamp(total, 0.0, 10.0), 1)


def severity_band(score: Column | str) -> Column:
    s = as_col(score)
    return F.when(s < 2.5, "Low").when(s < 5.0, "Medium").when(s < 7.5, "High").otherwise("Critical")


def normalize_severity(text: Column | str) -> Column:
    t = F.lower(F.coalesce(as_col(text), F.lit("")))
    return F.when(t.isin("critical", "high", "medium"), t).otherwise("low")


def severity_from_risk(risk: Column | str) -> Column:
    """Severity of a 0-1 or 0-100 risk, where no stored severity exists."""
    r = as_col(risk)
    pct = F.when(r <= 1, r * 100).otherwise(r)
    return F.when(pct >= 80, "critical").when(pct >= 60, "high").when(pct >= 40, "medium").otherwise("low")


def row_verdict(risk01: Column, has_severe_finding: Column) -> Column:
    """Verdict of a table row from its 0-1 risk; a severe finding lifts SAFE to SUSPICIOUS."""
    pct = risk01 * 100
    return (
        F.when(pct > 70, "MALICIOUS")
        .when((pct > 40) | F.coalesce(has_severe_finding, F.lit(False)), "SUSPICIOUS")
        .otherwise("SAFE")
    )


def view_status(status: Column | str) -> Column:
    s = as_col(status)
    return F.when(s == "Done", "completed").when(s == "Failed", "failed").otherwise("running")


def processing_seconds(started: Column | str, finished: Column | str) -> Column:
    """Seconds between two timestamps with two digits, null when either is missing."""
    micros = lambda c: F.unix_micros(as_col(c).cast("timestamp"))
    # Clock values count in whole milliseconds; halves round up.
    millis = F.floor(micros(finished) / 1000) - F.floor(micros(started) / 1000)
    return F.floor(millis / 10.0 + 0.5) / 100.0


def risk_bin(score: Column | str) -> Column:
    return F.least(F.lit(4), F.floor(as_col(score) / 2)).cast("int")


def technique_is_valid(technique: Column) -> Column:
    return F.rlike(technique, F.lit(TECHNIQUE_ID))


def number_text(value: Column) -> Column:
    """A double as text without a trailing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def report_violations(
    risk: Column, severity: Column, mitre: Column, n_evidence: Column
) -> Column:
    """Contract violations of a report, empty when it is acceptable."""
    # The wording of the violations.
    bad_score = F.isnan(risk) | (risk < 0) | (risk > 10)
    expected = severity_band(risk)
    first = (
        F.when(bad_score, F.concat(F.lit("risk_score "), number_text(risk), F.lit(" is outside the 0-10 range.")))
        .when(expected != severity, F.concat(
            F.lit("severity '"), severity, F.lit("' does not match risk_score "), number_text(risk),
            F.lit(" (expected '"), expected,
            F.lit("'; bands: 0-2.49 low, 2.5-4.9 medium, 5-7.4 high, 7.5-10 critical)."),
        ))
    )
    no_mitre = F.when(
        F.size(mitre) == 0,
        F.lit("mitre_techniques must not be empty — map the evidence to at least one ATT&CK technique."),
    )
    bad_ids = F.transform(
        F.filter(mitre, lambda t: ~technique_is_valid(t)),
        lambda t: F.concat(
            F.lit("mitre technique '"), t,
            F.lit("' is not a valid ATT&CK technique id (expected Txxxx or Txxxx.yyy)."),
        ),
    )
    no_evidence = F.when(
        n_evidence == 0,
        F.lit("evidence_trail must not be empty — every claim must link to its evidence source."),
    )
    return F.concat(compact_names(first, no_mitre), bad_ids, compact_names(no_evidence))


def email_techniques(has_url: Column, rules: Column) -> Column:
    """ATT&CK techniques of a suspicious e-mail."""
    rule_hit = F.exists(
        rules,
        lambda r: ~F.contains(r, F.lit(":"))
        | F.startswith(r, F.lit("suspicious_domain"))
        | F.startswith(r, F.lit("lookalike_domain")),
    )
    found = compact_names(F.when(has_url, F.lit("T1566.002")), F.when(rule_hit, F.lit("T1566")))
    return F.when(F.size(found) == 0, F.array(F.lit("T1566"))).otherwise(found)


def log_techniques(rules: Column) -> Column:
    """ATT&CK techniques of a suspicious log artifact."""

    def any_prefix(*prefixes: str) -> Column:
        pattern = "^(?:" + "|".join(prefixes) + ")"
        return F.exists(rules, lambda r: F.rlike(r, F.lit(pattern)))

    trail = any_prefix(
        "high_risk_api:DeleteTrail", "high_risk_api:StopLogging",
        "high_risk_api:UpdateTrail", "high_risk_api:PutEventSelectors",
    )
    found = compact_names(
        F.when(any_prefix("recon_burst", "access_denied"), F.lit("T1087")),
        F.when(trail, F.lit("T1562.008")).when(any_prefix("high_risk_api"), F.lit("T1098")),
        F.when(any_prefix(
            "sensitive_event_unseen_ip", "user_event_count_anomaly", "ip_event_count_anomaly",
            "user_event_frequency_spike", "ip_event_frequency_spike",
        ), F.lit("T1078")),
    )
    return F.when(F.size(found) == 0, F.array(F.lit("T1078"))).otherwise(found)
