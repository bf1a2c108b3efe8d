import datetime as dt

import pytest
from pyspark.sql import functions as F

from alertloom.functions import scoring
from alertloom.operators import kpi as K
from alertloom.plans import stages

T0 = dt.datetime(2026, 3, 1, 12)
JOB = "id string, file_name string, file_type string, status string, current_step string, error_message string, created_at timestamp, started_at timestamp, finished_at timestamp"


def jobs(spark):
    h = lambda n: T0 - dt.timedelta(hours=n)
    return spark.createDataFrame([
        ("q", "q.csv", "Csv", "Queued", "queued", None, h(1), None, None),
        ("a", "a.eml", "Eml", "Analyzing", "tier2.threat_intel", None, h(2), h(1), None),
        ("f", "f.eml", "Eml", "Failed", "tier2.failed", "boom", h(30), h(29), h(28)),
        ("d1", "d1.eml", "Eml", "Done", "done", None, h(24), h(23), h(23) + dt.timedelta(seconds=1, milliseconds=235)),
        ("d2", "d2.json", "Json", "Done", "tier1.done", None, h(40), h(40), h(39)),
    ], JOB)


def reports(spark):
    return spark.createDataFrame([
        ("d1", 9.25, "Critical", '["T1566.002","T1078","X-mark"]', T0), ("d2", 7.5, "High", '["t1566.002"," X-mark ","",null]', T0 + dt.timedelta(1)), ("z", 0.0, "Low", "{bad", T0),
    ], "job_id string, risk_score double, severity string, mitre_json string, created_at timestamp")


def test_stats_row(spark):
    r = K.stats(jobs(spark), reports(spark), F.lit(T0).cast("timestamp")).first().asDict()
    assert (r["total_jobs"], r["total_reports"], r["jobs_done"], r["jobs_filtering"], r["reports_medium"], r["critical_high"]) == (5, 3, 2, 0, 0, 2)
    assert r["avg_risk_score"] == 5.58 and r["last_24h_jobs"] == 3
    empty = K.stats(jobs(spark).limit(0), reports(spark).limit(0), F.lit(T0).cast("timestamp")).first()
    assert (empty.total_jobs, empty.avg_risk_score) == (0, 0.0)


def test_techniques_and_heatmap(spark):
    t = K.technique_stats(reports(spark))
    assert [(r.technique_id, r.tactic, r["count"]) for r in t.collect()] == [
        ("T1566.002", "Initial Access", 2), ("X-mark", "Unknown", 2), ("T1078", "Initial Access", 1)]
    assert [r.tactic for r in K.tactics_present(t).collect()] == ["Initial Access", "Unknown"]
    cells = {r.technique_id: r for r in K.heatmap(t).collect()}
    assert (cells["T1078"].tactic_total, cells["T1078"].intensity) == (3, 0.5)
    assert list(cells) == ["T1566.002", "T1078", "X-mark"]


def test_tactic_fallbacks(spark):
    rows = spark.createDataFrame([("t1078.004",), ("T1566.999",), ("T0000",), (".x",), ("T1078.9.1",)], "t string")
    assert [r.x for r in rows.select(K.tactic_of("t").alias("x")).collect()] == ["Persistence", "Initial Access", "Unknown", "Unknown", "Initial Access"]
    assert len(K.TACTIC_ORDER) == 15 and set(K.TACTIC_OF.values()) < set(K.TACTIC_ORDER)


def test_page_and_states(spark):
    page = K.job_page(jobs(spark), reports(spark), page=1, page_size=2).collect()
    assert [(r.id, r.has_report) for r in page] == [("q", False), ("a", False)]
    assert K.job_page(jobs(spark), reports(spark), page=2, page_size=1000).count() == 0
    with pytest.raises(ValueError):
        K.job_page(jobs(spark), reports(spark), page=0)
    many = spark.range(150).select(
        F.col("id").cast("string").alias("id"), F.lit("Eml").alias("file_type"), F.lit(T0).cast("timestamp").alias("created_at"))
    assert K.job_page(many, reports(spark), page_size=140).count() == 140
    asked = spark.createDataFrame([("d1",), ("f",), ("q",), ("nope",)], "id string")
    assert {r.id: r.state for r in K.report_states(asked, jobs(spark), reports(spark)).collect()} == {
        "d1": "ready", "f": "failed", "q": "pending", "nope": "missing"}


def test_timeline_nodes_and_stages(spark):
    j = K.with_report_flag(jobs(spark), reports(spark))
    tl = K.timeline(j, F.lit(T0).cast("timestamp"))
    ids = lambda job: [r.event_id for r in tl.filter(F.col("job_id") == job).orderBy("ord").collect()]
    assert ids("q") == ["ingest"]
    assert ids("a") == ["ingest", "tier1", "tier2-escalation", "tier2-email", "tier2-threat"]
    assert ids("f") == ["ingest", "failed"]
    assert ids("d1")[-1] == "tier2-synthesis" and ids("d2") == ["ingest", "tier1"]
    assert [r.source for r in K.agent_log(tl, "email").collect()] == ["Email Analyst"] * 2
    nodes = {(r.job_id, r.node): r.node_state for r in K.node_status(jobs(spark)).collect()}
    assert [nodes[("a", n)] for n in ("supervisor", "email", "forensic", "threat")] == ["running", "completed", "completed", "running"]
    assert [nodes[("f", n)] for n in ("supervisor", "email", "forensic", "threat")] == ["error", "error", "idle", "error"]
    assert nodes[("d2", "email")] == "idle" and nodes[("q", "forensic")] == "idle"
    stage = {(r.job_id, r.stage): r.stage_state for r in K.stage_status(j, K.node_status(jobs(spark)), tl).collect()}
    assert [stage[("a", s)] for s in K.PIPELINE_STAGES] == ["completed", "completed", "running", "idle", "idle"]
    assert stage[("f", "verdict")] == "error" and stage[("d1", "verdict")] == "completed"
    cost = {r.job_id: (r.events_processed, round(r.est_cost, 6)) for r in K.trace_counters(tl).collect()}
    assert cost["d1"] == (6, 0.003)
    assert tl.filter("job_id = 'd1'").select(K.trace_node("source").alias("n")).distinct().count() == 4


def test_rows_and_pages(spark):
    findings = spark.createDataFrame([("d1", "email_analysis", "c"), ("d1", "intel:x", "c2")], "job_id string, source string, claim string")
    rows = K.recent_reports(jobs(spark), reports(spark), findings)
    got = {r.job_id: r for r in rows.collect()}
    assert (got["d1"].row_verdict, got["d1"].finding_count, got["d1"].view_status) == ("MALICIOUS", 2, "completed")
    assert (got["d2"].row_verdict, got["q"].row_verdict, got["f"].view_status) == ("MALICIOUS", "SAFE", "failed")
    assert [r.job_id for r in K.alerts_page(rows, sort_key="risk", page_size=2).collect()] == ["d1", "d2"]
    assert [r.job_id for r in K.alerts_page(rows, severity="low", ascending=True).collect()] == ["f", "a", "q"]
    assert K.alerts_page(rows, page=99, page_size=2).count() == 0
    assert K.findings_of_trace(findings, "Email Analyst").count() == 1 and K.findings_of_trace(findings, "Other").count() == 0
    r = K.risk_histogram(reports(spark)).first()
    assert [r[f"bin_{i}"] for i in range(5)] == [1, 0, 0, 1, 1]


def test_scalars(one, spark):
    assert [one(scoring.severity_from_risk, x) for x in (0.8, 0.6, 0.4, 0.39, 80.0)] == ["critical", "high", "medium", "low", "critical"]
    assert [one(scoring.normalize_severity, x) for x in ("CRITICAL", "High", "weird", None)] == ["critical", "high", "low", "low"]
    s = jobs(spark).select("id", scoring.processing_seconds("started_at", "finished_at").alias("s"))
    assert {r.id: r.s for r in s.collect()} == {"q": None, "a": None, "f": 3600.0, "d1": 1.24, "d2": 3600.0}
    assert [one(scoring.risk_bin, x) for x in (0.0, 1.99, 2.0, 9.9, 10.0)] == [0, 0, 1, 4, 4]


def test_stage_routing(spark):
    df = spark.createDataFrame([("Eml", "tier2.email_analysis"), ("Csv", "tier2.synthesis_pending"), ("Eml", "tier2.synthesis_pending"), ("Csv", "other")], "t string, s string")
    got = df.select(stages.path_for("t").alias("p"), stages.next_step("s").alias("n"), stages.entry_step("t", "s").alias("e")).collect()
    assert [len(r.p) for r in got] == [4, 3, 4, 3]
    assert [r.n for r in got] == ["tier2.threat_intel", "tier2.synthesis", "tier2.synthesis", None]
    assert [r.e for r in got] == ["tier2.email_analysis", "tier2.synthesis", "tier2.synthesis", "tier2.threat_intel"]


def test_messages(spark):
    uid = "6F9619FF-8B86-D011-B42D-00CF4FC964FF"
    df = spark.createDataFrame([(f'{{"jobId":"{uid}"}}',), ("junk",), ('{"jobId":"x"}',), (None,)], "value string")
    ok, dead = stages.split_messages(df)
    assert [r.job_id for r in ok.collect()] == [uid.lower()] and dead.count() == 3
