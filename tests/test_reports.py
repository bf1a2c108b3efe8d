import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from alertloom.functions import prompts, responses, scoring
from alertloom.operators import correlate, report
from alertloom.schemas import ACTIVITY, INTEL, REPORT

T0 = dt.datetime(2026, 3, 1, 12)
FENCE = "`" * 3


@pytest.mark.parametrize("score, band", [(0, "Low"), (2.49, "Low"), (2.5, "Medium"), (4.9, "Medium"), (5.0, "High"), (7.4, "High"), (7.5, "Critical"), (10, "Critical")])
def test_bands(one, score, band):
    assert one(scoring.severity_band, float(score)) == band


@pytest.mark.parametrize("rule, ml, intel, phishing, want", [
    (100, 0.5, 1.0, True, 8.5), (0, None, None, False, 0.0), (100, 1.0, 1.0, True, 10.0), (50, 0.75, 0.0, False, 4.2), (50, 0.15, 0.0, False, 2.4),
])
def test_risk(spark, rule, ml, intel, phishing, want):
    col = scoring.risk_score(F.lit(rule), F.lit(ml).cast("double"), F.lit(intel).cast("double"), F.lit(phishing))
    assert spark.range(1).select(col.alias("r")).first().r == want


@pytest.mark.parametrize("technique, ok", [("T1566", True), ("T1566.001", True), ("TA0001", False), ("T123", False), ("T12345", False), ("t1566", False), ("T1566.1", False), ("T1566.001 extra", False)])
def test_technique_ids(one, technique, ok):
    assert one(scoring.technique_is_valid, technique) is ok


def test_violations(spark):
    rows = [(9.25, "Critical", ["T1078"], 1), (12.0, "Low", [], 0), (3.0, "Low", ["x"], 1), (float("nan"), "Low", ["T1078"], 1)]
    df = spark.createDataFrame(rows, "r double, s string, m array<string>, n int")
    got = [x.v for x in df.select(scoring.report_violations(F.col("r"), F.col("s"), F.col("m"), F.col("n")).alias("v")).collect()]
    assert got[0] == []
    assert got[1][0] == "risk_score 12 is outside the 0-10 range." and len(got[1]) == 3
    assert got[2][0].startswith("severity 'Low' does not match risk_score 3 (expected 'Medium'") and "technique 'x'" in got[2][1]
    assert len(got[3]) == 1


def answer(**over):
    base = {"status": "phishing", "confidence": 0.9, "iocs": [{"type": "url", "value": " http://x "}], "phishing_indicators": ["a", " "], "summary": " bad "}
    base.update(over)
    return json.dumps({k: v for k, v in base.items() if v is not ...})


@pytest.mark.parametrize("raw, status", [
    (answer(), "Phishing"), (f"text {FENCE}json\n{answer()}\n{FENCE} more", "Phishing"), (f"{FENCE}\n{answer()}\n{FENCE}", "Phishing"),
    ("Sure! " + answer(status="SAFE") + " ok?", "Safe"), (answer()[:-1] + ",}", "Phishing"), ("// note\n" + answer(), None), (answer(status="maybe"), None),
    (answer(summary=" "), None), (answer(summary=...), None), (answer(status=...), None), ("", None), (None, None), ("no json", None), ("{broken", None),
    (answer().replace('"status"', '"Status"'), "Phishing"), ('{/* c */ "status": "safe", "summary": "x,}"}', "Safe"), (answer(confidence="x"), None),
])
def test_email_answers(spark, raw, status):
    r = spark.createDataFrame([(raw,)], "raw string").select(responses.email_analysis("raw").alias("a")).first().a
    if raw is not None and raw.startswith("// note"):
        assert r.status == "Phishing"  # the outermost braces leave the leading comment out
    else:
        assert (r.status if r else None) == status


def test_email_answer_details(spark):
    raw = answer(confidence=7, iocs=[{"type": "URL", "value": " u "}, {"type": "planet", "value": "x"}, {"type": "ip", "value": " "}])
    a = spark.createDataFrame([(raw,)], "raw string").select(responses.email_analysis("raw").alias("a")).first().a
    assert (a.confidence, [(i.type, i.value) for i in a.iocs], a.phishing_indicators, a.summary) == (1.0, [("Url", "u")], ["a"], "bad")
    missing = spark.createDataFrame([(answer(confidence=..., iocs=...),)], "raw string").select(responses.email_analysis("raw").alias("a")).first().a
    assert (missing.confidence, missing.iocs) == (0.5, [])


def synth(**over):
    base = {"risk_score": 9.25, "severity": "critical", "summary_markdown": " s ", "mitre_techniques": [" T1078 ", ""], "recommended_actions": ["x"],
            "evidence_trail": [{"claim": "c", "source": " s "}, {"claim": "", "source": "s"}]}
    base.update(over)
    return json.dumps({k: v for k, v in base.items() if v is not ...})


def test_synthesis_answers_and_attempts(spark):
    rows = [("a", 1, "junk"), ("a", 2, synth()), ("b", 1, synth(severity="low")), ("b", 2, synth(risk_score=...)), ("b", 3, synth()), ("c", 1, synth()), ("c", 2, synth(risk_score=8.0))]
    answers = spark.createDataFrame(rows, "job_id string, attempt int, response string")
    every = {r.job_id: r for r in report.synthesis_outcomes(answers).collect()}
    assert (every["b"].outcome, every["b"].attempt, every["b"].tried) == ("accepted", 3, 3)
    out = {r.job_id: r for r in report.synthesis_outcomes(answers, max_attempts=2).collect()}
    assert (out["a"].outcome, out["a"].attempt, out["a"].report.risk_score, out["a"].report.mitre) == ("accepted", 2, 9.25, ["T1078"])
    assert [(e.claim, e.source) for e in out["a"].report.evidence] == [("c", "s")]
    assert (out["b"].outcome, out["b"].attempt, out["b"].tried) == ("failed", None, 2)
    assert (out["c"].attempt, out["c"].report.risk_score) == (1, 9.25)


@pytest.mark.parametrize("text, want", [
    ('{"matchedRules":["a",1,null,"b"],"riskScore":7,"extracted":{"x":1}}', (["a", "b"], 7)), ('{"matchedRules":"a","riskScore":7.5,"extracted":{}}', ([], 0)),
    ('{"matchedRules":["a"]}', None), ("{bad", None), (None, None),
])
def test_rule_report_json(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(responses.rule_report("t").alias("r")).first().r
    assert (r and (r.matched_rules, r.risk_score)) == want


def bundle(spark, kind="Eml", rules=("urgent_action_required",), with_activity=True):
    jobs = spark.createDataFrame([("j", "m.eml", kind)], "id string, file_name string, file_type string")
    tier1 = spark.createDataFrame([("j", "Suspicious", 100, list(rules), 0.5)], "job_id string, verdict string, risk_score int, matched_rules array<string>, ml_score double")
    found = spark.createDataFrame([("j", "Url", "http://x", "Rule", 0), ("j", "Ip", "1.1.1.1", "Llm", 1)], "job_id string, type string, value string, extracted_by string, pos int")
    intel = spark.createDataFrame([("Url", "http://x", "VirusTotal", "", 1.0, True, T0)], INTEL)
    activity = spark.createDataFrame([(T0, "ListUsers", "1.1.1.1", None, "r", "")] if with_activity else [], ACTIVITY)
    analysis = spark.createDataFrame([("j", ("Phishing", 0.9, [], [], "bad"))], "job_id string, analysis struct<status:string,confidence:double,iocs:array<struct<type:string,value:string>>,phishing_indicators:array<string>,summary:string>")
    return correlate.evidence_bundles(jobs, tier1, found, intel, correlate.correlate_activity(found, activity), None, analysis)


def test_deterministic_report(spark):
    r = report.deterministic_reports(bundle(spark), F.lit(T0).cast("timestamp")).first()
    assert (r.risk_score, r.severity, r.mitre) == (8.5, "Critical", ["T1566.002", "T1566"])
    assert r.summary.startswith("[generated without LLM]\n\n## Incident summary")
    assert "  - `Url` `http://x` (Rule) — VirusTotal score 1.00 (live API)\n  - `Ip` `1.1.1.1` (Llm) — not enriched\n" in r.summary
    assert "**Risk score: 8.5/10 — severity: Critical**" in r.summary and len(r.actions) == 4
    assert [e.source for e in r.evidence] == ["tier1.rule_check_results", "ml_score", "intel:VirusTotal", "email_analysis", "cloudtrail", "deterministic_scoring"]
    assert r.evidence[4].claim == "CloudTrail event ListUsers from 1.1.1.1 by unknown identity at 2026-03-01T12:00:00.0000000+00:00."
    ok, bad = report.split_valid(spark.createDataFrame([r], REPORT))
    assert (ok.count(), bad.count()) == (1, 0)


@pytest.mark.parametrize("rules, want", [
    (["recon_burst:x:3", "high_risk_api:StopLogging"], ["T1087", "T1562.008"]), (["high_risk_api:CreateUser"], ["T1098"]),
    (["access_denied:X", "ip_event_frequency_spike:1:count=20"], ["T1087", "T1078"]), (["sigma:x"], ["T1078"]), ([], ["T1078"]),
])
def test_log_techniques(spark, rules, want):
    df = spark.createDataFrame([(rules,)], "r array<string>")
    assert df.select(scoring.log_techniques(F.col("r")).alias("m")).first().m == want


def test_defaults_of_an_unknown_job(spark):
    jobs = spark.createDataFrame([("x", "f", "Csv")], "id string, file_name string, file_type string")
    b = bundle(spark)
    empty = lambda schema: spark.createDataFrame([], schema)
    out = correlate.evidence_bundles(
        jobs, empty("job_id string, verdict string, risk_score int, matched_rules array<string>, ml_score double"),
        empty("job_id string, type string, value string, extracted_by string, pos int"), empty(INTEL),
        empty("job_id string, rn int, event_time timestamp, event_name string, source_ip string, user_identity string, aws_region string")).first()
    assert (out.tier1_verdict, out.rule_score, out.matched_rules, out.iocs, out.activity) == ("Unknown", 0, [], [], [])
    assert b.columns == list(out.__fields__)


def test_prompts(spark):
    df = spark.createDataFrame([("x" * 4001, ["a", "b"])], "p string, r array<string>")
    assert "x" * 4001 in df.select(prompts.email_prompt("p", "r", F.lit("{}")).alias("t")).first().t
    text = df.select(prompts.email_prompt("p", "r", F.lit("{}"), limit=4000).alias("t")).first().t
    assert "matched rules: a, b\n" in text and "x" * 4000 + "\n[... truncated ...]" in text and "x" * 4001 not in text
    none = df.select(prompts.synthesis_prompt(F.lit("{}"), F.array().cast(
        "array<struct<risk_score:double,severity:string,similarity:double,matched_rules:array<string>,excerpt:string>>")).alias("t")).first().t
    assert "Similar past" not in none and none.endswith("instructions.")
    retry = df.select(prompts.validation_retry("r").alias("t")).first().t
    assert "- a\n- b\n" in retry


def test_tampered_report_is_quarantined(spark):
    rows = [("j", 9.0, "Low", "s", [], [], [], T0)]
    ok, bad = report.split_valid(spark.createDataFrame(rows, REPORT))
    assert ok.count() == 0 and len(bad.first().violations) == 3
