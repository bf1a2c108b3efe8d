"""Operations figures over jobs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.responses import json_strings
from ..functions.text import as_col, round_half_even, strip
from ..schemas import JOB_STATUSES, SEVERITIES, STEP_ORDER

UNKNOWN = "Unknown"

# Tactics in kill-chain order.
TACTIC_ORDER = [
    "Reconnaissance", "Resource Development", "Initial Access", "Execution", "Persistence",
    "Privilege Escalation", "Defense Evasion", "Credential Access", "Discovery", "Lateral Movement",
    "Collection", "Command and Control", "Exfiltration", "Impact", UNKNOWN,
]

# The tactic under which each technique is counted.
TACTIC_OF = {
    "T1566": "Initial Access",
    "T1566.001": "Initial Access",
    "T1566.002": "Initial Access",
    "T1566.003": "Initial Access",
    "T1078": "Initial Access",
    "T1190": "Initial Access",
    "T1189": "Initial Access",
    "T1195": "Initial Access",
    "T1059": "Execution",
    "T1204": "Execution",
    "T1204.002": "Execution",
    "T1078.004": "Persistence",
    "T1098": "Persistence",
    "T1136": "Persistence",
    "T1053": "Persistence",
    "T1068": "Privilege Escalation",
    "T1548": "Privilege Escalation",
    "T1562": "Defense Evasion",
    "T1562.008": "Defense Evasion",
    "T1027": "Defense Evasion",
    "T1070": "Defense Evasion",
    "T1055": "Defense Evasion",
    "T1110": "Credential Access",
    "T1110.003": "Credential Access",
    "T1003": "Credential Access",
    "T1552": "Credential Access",
    "T1552.005": "Credential Access",
    "T1557": "Credential Access",
    "T1087": "Discovery",
    "T1083": "Discovery",
    "T1018": "Discovery",
    "T1046": "Discovery",
    "T1069": "Discovery",
    "T1021": "Lateral Movement",
    "T1080": "Lateral Movement",
    "T1105": "Command and Control",
    "T1071": "Command and Control",
    "T1102": "Command and Control",
    "T1573": "Command and Control",
    "T1041": "Exfiltration",
    "T1048": "Exfiltration",
    "T1567": "Exfiltration",
    "T1567.002": "Exfiltration",
    "T1537": "Exfiltration",
    "T1526": "Impact",
    "T1485": "Impact",
    "T1486": "Impact",
    "T1490": "Impact",
    "T1496": "Impact",
    "T1498": "Impact",
}

# The events of a job's timeline. Columns: id, step that must be reached, only for
# e-mail, type, source, target, description (null where it depends on the job), which time it carries.
TIMELINE = [
    ("ingest", "queued", False, "delegation", "Upload API", "Job Queue", None, "created"),
    ("tier1", "tier1.filtering", False, "artifact", "Tier-1 Filter", "Orchestrator",
     "PII scrubbing, rule checks and ONNX phishing scoring", "started"),
    ("tier2-escalation", "tier2.pending", False, "delegation", "Orchestrator", "Analysis Agents",
     "Artifact suspicious — escalated to the Tier-2 agent pipeline", "started"),
    ("tier2-email", "tier2.email_analysis", True, "artifact", "Email Analyst", "Orchestrator",
     "LLM email analysis: header parsing, IOC extraction, phishing verdict", "started"),
    ("tier2-threat", "tier2.threat_intel", False, "enrichment", "Threat Intel", "Orchestrator",
     "IOC enrichment via VirusTotal / AbuseIPDB (DB-backed cache)", "started"),
    ("tier2-synthesis", "tier2.synthesis", False, "synthesis", "Synthesis", "Final Output", None, "finished"),
]

# The trace sources shown for each agent, and the node a source belongs to.
AGENT_SOURCES = {
    "supervisor": ["Orchestrator", "Upload API"],
    "forensic": ["Tier-1 Filter"],
    "email": ["Email Analyst"],
    "threat": ["Threat Intel"],
}
NODE_OF_SOURCE = {
    "Upload API": "eventbridge", "Orchestrator": "supervisor", "Synthesis": "synthesis", "System": "verdict",
}
# Agent nodes and the step each one works on; the first one supervises.
AGENT_NODES = [
    ("supervisor", "Orchestrator", None),
    ("email", "Email Analyst", "tier2.email_analysis"),
    ("forensic", "Tier-1 Filter", "tier1.filtering"),
    ("threat", "Threat Intel", "tier2.threat_intel"),
]
PIPELINE_STAGES = ["eventbridge", "supervisor", "agents", "synthesis", "verdict"]


def totals(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """One row: total jobs and reports."""
    return _beside(
        jobs.agg(F.count("*").alias("total_jobs")), reports.agg(F.count("*").alias("total_reports"))
    )


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row results side by side."""
    return left.withColumn("one", F.lit(1)).join(right.withColumn("one", F.lit(1)), "one").drop("one")


def counts_of(df: DataFrame, column: str, values: list[str], suffix: str = "") -> DataFrame:
    """One row with a count per listed value, 0 where it does not occur: one pass, no pivot job."""
    return df.agg(*[F.count_if(F.col(column) == v).alias(v.lower() + suffix) for v in values])


def jobs_by_status(jobs: DataFrame) -> DataFrame:
    return counts_of(jobs, "status", JOB_STATUSES)


def reports_by_severity(reports: DataFrame) -> DataFrame:
    return counts_of(reports, "severity", SEVERITIES)


def average_risk(col: Column | str = "risk_score") -> Column:
    """Mean with two digits, half to even; 0 without rows."""
    return F.coalesce(round_half_even(F.avg(as_col(col)), 2), F.lit(0.0))


def jobs_since(jobs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Jobs created in the last hours before ``now``."""
    since = now - F.make_dt_interval(hours=F.lit(hours))
    return jobs.agg(F.count_if(F.col("created_at") >= since).alias("recent_jobs"))


def stats(jobs: DataFrame, reports: DataFrame, now: Column) -> DataFrame:
    """The whole figure strip in one row: one pass over each table."""
    since = now - F.make_dt_interval(hours=F.lit(24))
    left = jobs.agg(
        F.count("*").alias("total_jobs"),
        *[F.count_if(F.col("status") == s).alias(f"jobs_{s.lower()}") for s in JOB_STATUSES],
        F.count_if(F.col("created_at") >= since).alias("last_24h_jobs"),
    )
    right = reports.agg(
        F.count("*").alias("total_reports"),
        *[F.count_if(F.col("severity") == s).alias(f"reports_{s.lower()}") for s in SEVERITIES],
        F.count_if(F.col("severity").isin("High", "Critical")).alias("critical_high"),
        average_risk().alias("avg_risk_score"),
    )
    return _beside(left, right)


def technique_counts(reports: DataFrame, mitre_json: str = "mitre_json",
                     order: list[str] | None = None) -> DataFrame:
    """(technique_id, count): ids trimmed, blank and corrupt ones dropped, counted ignoring case.

    The shown spelling is the one of the first report in the order of ``order``.
    """
    order = order or ["created_at", "job_id"]
    rows = reports.select(
        F.struct(*order).alias("seen"), F.posexplode(json_strings(mitre_json)).alias("pos", "id")
    ).select(F.struct("seen", "pos").alias("seen"), strip("id").alias("technique_id")).filter("technique_id <> ''")
    return rows.groupBy(F.upper("technique_id").alias("folded")).agg(
        F.min_by("technique_id", "seen").alias("technique_id"), F.count("*").alias("count")
    ).drop("folded")


def tactic_of(technique: Column | str) -> Column:
    """Tactic of a technique: its own, else its parent's, else Unknown. A constant map, no join."""
    known = F.create_map(*[x for t, tactic in TACTIC_OF.items() for x in (F.lit(t), F.lit(tactic))])
    folded = F.upper(as_col(technique))
    # A sub-technique's parent is what stands before its first dot, if anything does.
    parent = F.when(F.instr(folded, ".") > 1, F.substring_index(folded, ".", 1))
    return F.coalesce(F.try_element_at(known, folded), F.try_element_at(known, parent), F.lit(UNKNOWN))


def tactic_rank(tactic: Column | str) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TACTIC_ORDER]), as_col(tactic)).cast("int")


def technique_stats(reports: DataFrame, mitre_json: str = "mitre_json",
                    order: list[str] | None = None) -> DataFrame:
    """(technique_id, tactic, count), most frequent first."""
    counted = technique_counts(reports, mitre_json, order)
    return counted.select("technique_id", tactic_of("technique_id").alias("tactic"), "count").orderBy(
        F.col("count").desc(), F.upper("technique_id")
    )


def tactics_present(techniques: DataFrame) -> DataFrame:
    """Tactics that occur, in kill-chain order."""
    return techniques.select("tactic").distinct().select("tactic", tactic_rank("tactic").alias("ord")).orderBy("ord")


def heatmap(techniques: DataFrame) -> DataFrame:
    """Cells with the total of their tactic and their intensity, in display order.

    Totals are joined instead of windowed: malformed ids may make one tactic large, and a join splits it.
    The table of totals has at most one row per listed tactic.
    """
    totals_ = techniques.groupBy("tactic").agg(F.sum("count").alias("tactic_total"))
    peak = techniques.agg(F.greatest(F.max("count"), F.lit(1)).alias("peak"))
    return _beside(techniques.join(F.broadcast(totals_), "tactic"), peak).select(
        "tactic", tactic_rank("tactic").alias("tactic_ord"), "technique_id", "count", "tactic_total",
        (F.col("count") / F.col("peak")).alias("intensity"),
    ).orderBy("tactic_ord", F.col("count").desc(), F.upper("technique_id"))


def report_overview(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """Severity counts, average risk on the 0-1 scale and the number of findings, over all reports."""
    left = reports.agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in reversed(SEVERITIES)],
        F.coalesce(F.avg("risk_score") / 10, F.lit(0.0)).alias("avg_risk_score"),
    )
    return _beside(left, findings.agg(F.count("*").alias("total_findings")))


def risk_histogram(reports: DataFrame) -> DataFrame:
    """One row with the five bins of the 0-10 risk."""
    b = scoring.risk_bin("risk_score")
    return reports.agg(*[F.count_if(b == i).alias(f"bin_{i}") for i in range(5)])


def usage_breakdown(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Agent usage and event types: mail against the rest, and reports."""
    eml = F.col("file_type") == "Eml"
    left = jobs.agg(
        F.count_if(eml).alias("email"), F.count_if(~eml).alias("cloudtrail"),
        F.count_if(F.col("status") == "Done").alias("completed"),
        F.count_if(F.col("status") == "Failed").alias("failed"),
    )
    return _beside(left, reports.agg(F.count("*").alias("threat_intel")))


def recent_reports(jobs: DataFrame, reports: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per job with the figures of its report. Findings are counted before they are joined."""
    per_job = findings.groupBy("job_id").agg(F.count("*").alias("finding_count"))
    severe = F.col("severity").isin("Critical", "High") & (F.col("finding_count") > 0)
    joined = (
        jobs.select(F.col("id").alias("job_id"), "file_type", "status", "created_at")
        .join(reports.select("job_id", "risk_score", "severity"), "job_id", "left")
        .join(per_job, "job_id", "left")
    )
    risk = F.coalesce("risk_score", F.lit(0.0)) / 10
    return joined.select(
        "job_id",
        F.when(F.col("file_type") == "Eml", "email").otherwise("cloudtrail").alias("event_type"),
        scoring.view_status("status").alias("view_status"),
        risk.alias("risk"),
        F.lower("severity").alias("severity"),
        "created_at",
        F.coalesce("finding_count", F.lit(0)).alias("finding_count"),
        scoring.row_verdict(risk, F.coalesce(severe, F.lit(False))).alias("row_verdict"),
    )


def row_severity() -> Column:
    """Severity shown for a row of ``recent_reports``: the stored one, else one from the risk."""
    return scoring.normalize_severity(F.coalesce("severity", scoring.severity_from_risk("risk")))


def alerts_page(rows: DataFrame, severity: str = "all", verdict: str = "all", sort_key: str = "time",
                ascending: bool = False, page: int = 1, page_size: int = 20) -> DataFrame:
    """One page of the filtered and sorted alert rows; a page beyond the end is empty."""
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size begin at 1")
    if severity != "all":
        rows = rows.filter(row_severity() == severity)
    if verdict != "all":
        rows = rows.filter(F.col("row_verdict") == verdict)
    key = F.col("risk" if sort_key == "risk" else "created_at")
    return rows.orderBy(key.asc() if ascending else key.desc(), "job_id").offset((page - 1) * page_size).limit(page_size)


def job_page(jobs: DataFrame, reports: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    """One page of the job list, newest first, with a report flag; only the page is joined.

    The caller chooses the size of a page; a service that answers strangers bounds it before it calls.
    """
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size begin at 1")
    items = jobs.orderBy(F.col("created_at").desc(), "id").offset((page - 1) * page_size).limit(page_size)
    return with_report_flag(items, reports).orderBy(F.col("created_at").desc(), "id")


def with_report_flag(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    flags = reports.select(F.col("job_id").alias("id")).distinct().withColumn("has_report", F.lit(True))
    return jobs.join(flags, "id", "left").withColumn("has_report", F.coalesce("has_report", F.lit(False)))


def job_reports(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Jobs with their report and the state of it: ready, failed or pending."""
    r = reports.select(F.col("job_id").alias("id"), "risk_score", "severity", F.lit(True).alias("found"))
    joined = jobs.join(r, "id", "left")
    state = F.when(F.col("found"), "ready").when(F.col("status") == "Failed", "failed").otherwise("pending")
    return joined.withColumn("state", state).drop("found")


def report_states(requested: DataFrame, jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """State of each requested job id; ids without a job are missing."""
    return requested.select("id").join(job_reports(jobs, reports), "id", "left").withColumn(
        "state", F.coalesce("state", F.lit("missing"))
    )


def report_view(reports: DataFrame) -> DataFrame:
    """Stored JSON arrays as real arrays; corrupt text gives an empty array."""
    items = "array<struct<claim:string,source:string>>"
    return reports.select(
        "job_id", "risk_score", F.lower("severity").alias("severity"), "summary",
        json_strings("mitre_json").alias("mitre"),
        json_strings("actions_json").alias("actions"),
        F.coalesce(F.from_json("evidence_json", items), F.array().cast(items)).alias("evidence"),
        "created_at",
    )


def step_index(step: Column | str) -> Column:
    """Position of a step in the pipeline; unknown and missing ones count as queued."""
    position = F.array_position(F.array(*[F.lit(s) for s in STEP_ORDER]), as_col(step))
    return F.greatest(F.coalesce(position, F.lit(1)) - 1, F.lit(0)).cast("int")


def timeline(jobs: DataFrame, now: Column) -> DataFrame:
    """Events reached so far per job (``has_report`` flag included in ``jobs``), failure last."""
    reached = step_index("current_step")
    started = F.coalesce("started_at", "created_at")
    times = {"created": F.col("created_at"), "started": started, "finished": F.coalesce("finished_at", now)}
    special = {
        "ingest": F.concat(F.lit("Ingested "), F.upper("file_type"), F.lit(" artifact: "), F.col("file_name")),
        "tier2-synthesis": F.when(F.col("has_report"), "Final report generated").otherwise("Synthesizing final report..."),
    }

    def event(shown: Column, ord_: int, id_: str, kind: str, source: str, target: str, text: Column, when: str) -> Column:
        return F.struct(
            shown.alias("shown"),
            F.lit(ord_).alias("ord"), F.lit(id_).alias("event_id"), F.lit(kind).alias("type"),
            F.lit(source).alias("source"), F.lit(target).alias("target"), text.alias("description"),
            times[when].alias("ts"),
        )

    events = []
    for i, (id_, step, only_mail, kind, source, target, text, when) in enumerate(TIMELINE):
        shown = reached >= STEP_ORDER.index(step)
        if only_mail:
            shown = shown & (F.col("file_type") == "Eml")
        text_col = F.lit(text) if text is not None else special[id_]
        events.append(event(shown, i, id_, kind, source, target, text_col, when))
    failure = F.coalesce("error_message", F.concat(F.lit("Job failed at step "), F.col("current_step")))
    events.append(event(
        F.col("status") == "Failed", len(TIMELINE), "failed", "error", "System", "Logger", failure, "finished"
    ))
    # Seven candidates per job, exploded and filtered: both take part in code generation.
    return jobs.select(F.col("id").alias("job_id"), F.explode(F.array(*events)).alias("e")).select(
        "job_id", "e.*"
    ).filter("shown").drop("shown")


def trace_node(source: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for kv in NODE_OF_SOURCE.items() for x in kv])
    return F.coalesce(F.try_element_at(known, as_col(source)), F.lit("agents"))


def agent_log(traces: DataFrame, agent: str) -> DataFrame:
    """Timeline rows of one agent; an unknown agent name is taken as a source."""
    return traces.filter(F.col("source").isin(*AGENT_SOURCES.get(agent, [agent])))


def trace_counters(traces: DataFrame) -> DataFrame:
    """Events and the estimated model cost per job."""
    paid = F.count_if(F.col("type").isin("delegation", "synthesis"))
    return traces.groupBy("job_id").agg(
        F.count("*").alias("events_processed"), (paid * F.lit(0.001)).alias("est_cost")
    )


def node_status(jobs: DataFrame) -> DataFrame:
    """State of the four agents of every job."""
    done, failed = F.col("status") == "Done", F.col("status") == "Failed"
    step = F.coalesce("current_step", F.lit(""))
    idx = step_index("current_step")
    supervisor = F.when(failed, "error").when(done, "completed").otherwise("running")
    nodes = []
    for id_, name, stage in AGENT_NODES:
        if stage is None:
            state = supervisor
        else:
            at = STEP_ORDER.index(stage)
            working = step == stage
            if id_ == "forensic":
                working = working | (F.col("status") == "Filtering")
            blamed = failed & F.startswith(step, F.lit(stage.split(".")[0])) & ((idx == 0) | (idx >= at - 1))
            state = (
                F.when(~done & ~failed & working, "running").when(blamed, "error")
                .when(done | (idx > at), "completed").otherwise("idle")
            )
            if id_ == "email":
                state = F.when(F.col("file_type") != "Eml", "idle").otherwise(state)
        nodes.append(F.struct(F.lit(id_).alias("node"), F.lit(name).alias("name"), state.alias("node_state")))
    return jobs.select(F.col("id").alias("job_id"), F.explode(F.array(*nodes)).alias("n")).select("job_id", "n.*")


def stage_status(jobs: DataFrame, nodes: DataFrame, traces: DataFrame) -> DataFrame:
    """State of the five pipeline stages of every job that exists."""
    agents = nodes.filter(F.col("node") != "supervisor").groupBy("job_id").agg(
        F.bool_or(F.col("node_state") == "running").alias("any_running"),
        F.bool_or(F.col("node_state") == "completed").alias("any_completed"),
    )
    last = traces.groupBy("job_id").agg(
        F.max_by("source", "ord").alias("last_source"), F.count("*").alias("n_traces")
    )
    joined = (
        jobs.select(F.col("id").alias("job_id"), "status", "has_report")
        .join(agents, "job_id", "left").join(last, "job_id", "left")
    )
    view = scoring.view_status("status")
    ready = (view == "completed") | F.col("has_report")
    running = view == "running"
    states = {
        "eventbridge": F.lit("completed"),
        "supervisor": F.when(ready | (F.col("n_traces") > 1), "completed").otherwise("idle"),
        "agents": F.when(ready, "completed").when(F.col("any_running"), "running")
        .when(F.col("any_completed"), "completed").otherwise("idle"),
        "synthesis": F.when(F.col("has_report"), "completed")
        .when(running & (F.col("last_source") == "Synthesis"), "running").otherwise("idle"),
        "verdict": F.when(view == "failed", "error").when(F.col("has_report"), "completed").otherwise("idle"),
    }
    stages = F.array(*[
        F.struct(F.lit(s).alias("stage"), states[s].alias("stage_state")) for s in PIPELINE_STAGES
    ])
    return joined.select("job_id", F.explode(stages).alias("s")).select("job_id", "s.*")


def findings_by_agent(findings: DataFrame) -> DataFrame:
    """Number of findings per job and agent with the first and last claim, without collecting them."""
    return findings.groupBy("job_id", F.col("source").alias("agent")).agg(
        F.count("*").alias("n_findings"), F.min("claim").alias("first_claim"), F.max("claim").alias("last_claim")
    )


def findings_of_trace(findings: DataFrame, trace_source: str) -> DataFrame:
    """Findings that belong to a trace source, matched by the family both names contain."""
    family = first_family(trace_source)
    if family is None:
        return findings.filter(F.lit(False))
    return findings.filter(F.contains(F.lower("source"), F.lit(family)))


def first_family(trace_source: str) -> str | None:
    return next((f for f in ("email", "forensic", "threat") if f in trace_source.lower()), None)


def fallback_view(rows: DataFrame, traces: DataFrame) -> DataFrame:
    """Tier-1 decision and score from the report risk, and a duration from the first and last event."""
    span = traces.groupBy("job_id").agg(
        F.min_by("ts", "ord").alias("first_ts"), F.max_by("ts", "ord").alias("last_ts"), F.count("*").alias("n")
    )
    millis = F.floor(F.unix_micros(F.col("last_ts").cast("timestamp")) / 1000) - F.floor(
        F.unix_micros(F.col("first_ts").cast("timestamp")) / 1000)
    seconds = F.when((F.col("n") > 1) & (millis > 0), F.floor(millis / 10.0 + 0.5) / 100.0)
    return rows.join(span, "job_id", "left").select(
        "job_id",
        F.when(F.col("risk") > 0.4, "SUSPICIOUS").otherwise("CLEAN").alias("decision"),
        F.floor(F.col("risk") * 100 + 0.5).cast("int").alias("static_risk_score"),
        seconds.alias("duration_seconds"),
    )
