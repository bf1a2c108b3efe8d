"""Registered queries on operations figures: jobs from orders, reports and findings from what belongs to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import kpi as K
from ..schemas import STEP_ORDER
from .lens import FINDING_CTE, JOB_CTE, REPORT_CTE, Lens, epoch_seconds, query

_J, _R, _F = f"WITH {JOB_CTE}", f"WITH {REPORT_CTE}", f"WITH {FINDING_CTE}"
_ALL = f"WITH {JOB_CTE}, {REPORT_CTE}, {FINDING_CTE}"
_NOW = "TIMESTAMP '2001-07-15 12:00:00'"
_cnt = lambda cond, name: f"count(*) FILTER (WHERE {cond}) AS {name}"


def now() -> Column:
    return F.lit("2001-07-15 12:00:00").cast("timestamp_ntz")


def seconds(c: str) -> Column:
    """Whole seconds of a timestamp, which compare the same way in both engines."""
    return epoch_seconds(c).alias(c)


_sec = lambda c: f"CAST(epoch({c}) AS BIGINT) AS {c}"


def flagged_jobs(t: Lens) -> DataFrame:
    return K.with_report_flag(t.jobs, t.reports)


def traces(t: Lens) -> DataFrame:
    return K.timeline(flagged_jobs(t), now())


@query("k1_totals", f"WITH {JOB_CTE}, {REPORT_CTE} SELECT (SELECT count(*) FROM jobs) AS total_jobs, (SELECT count(*) FROM reports) AS total_reports")
def _(t):
    return K.totals(t.jobs, t.reports)


@query("k2_jobs_by_status", f"{_J} SELECT " + ", ".join(_cnt(f"status = '{s}'", s.lower()) for s in ["Queued", "Filtering", "Analyzing", "Done", "Failed"]) + " FROM jobs")
def _(t):
    return K.jobs_by_status(t.jobs)


_SEV = ["Low", "Medium", "High", "Critical"]


@query("k3_reports_by_severity", f"{_R} SELECT " + ", ".join(_cnt(f"severity = '{s}'", s.lower()) for s in _SEV) + " FROM reports")
def _(t):
    return K.reports_by_severity(t.reports)


@query("k4_average_risk", f"{_R} SELECT coalesce(round_even(avg(risk_score) * 100, 0) / 100, 0) AS avg_risk_score FROM reports")
def _(t):
    return t.reports.agg(K.average_risk().alias("avg_risk_score"))


@query("k5_recent_jobs", f"{_J} SELECT {_cnt(f'created_at >= {_NOW} - INTERVAL 24 HOUR', 'recent_jobs')} FROM jobs")
def _(t):
    return K.jobs_since(t.jobs, now())


_TECH = """ids AS (SELECT created_at, job_id, pos, trim(l[pos]) AS technique_id FROM (SELECT created_at, job_id, l, unnest(range(1, len(l) + 1)) AS pos
    FROM (SELECT created_at, job_id, CASE WHEN json_valid(mitre_json) THEN CAST(json(mitre_json) AS VARCHAR[]) ELSE [] END AS l FROM reports))),
  tech AS (SELECT arg_min(technique_id, (created_at, job_id, pos)) AS technique_id, count(*) AS count FROM ids WHERE technique_id <> '' GROUP BY upper(technique_id))"""
_MAP = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in K.TACTIC_OF.items()) + "}"
_TACTIC = lambda c: f"coalesce({_MAP}[upper({c})], CASE WHEN instr({c}, '.') > 1 THEN {_MAP}[split_part(upper({c}), '.', 1)] END, 'Unknown')"
_STATS = f"{_R}, {_TECH}, st AS (SELECT technique_id, {_TACTIC('technique_id')} AS tactic, count FROM tech)"
_RANK = "list_position([" + ", ".join(f"'{t}'" for t in K.TACTIC_ORDER) + "], tactic)::INT"


@query("k6_technique_counts", f"{_R}, {_TECH} SELECT * FROM tech")
def _(t):
    return K.technique_counts(t.reports)


# Technique ids derived from the parts cover known, sub- and unknown techniques.
_PART_TECH = "concat(CASE WHEN p_partkey % 2 = 0 THEN 'T' ELSE 't' END, CAST(1000 + p_partkey % 600 AS STRING), CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN '.001' ELSE '.002' END)"


@query("k7_tactic_lookup", f"SELECT p_partkey, t AS technique_id, {_TACTIC('t')} AS tactic FROM (SELECT p_partkey, {_PART_TECH} AS t FROM part)")
def _(t):
    return t.table("part").selectExpr("p_partkey", f"{_PART_TECH} AS technique_id").withColumn("tactic", K.tactic_of("technique_id"))


@query("k7_technique_stats", f"{_STATS} SELECT * FROM st")
def _(t):
    return K.technique_stats(t.reports)


@query("k8_tactics_present", f"{_STATS} SELECT DISTINCT tactic, {_RANK} AS ord FROM st")
def _(t):
    return K.tactics_present(K.technique_stats(t.reports))


@query("k9_heatmap", f"""{_STATS} SELECT tactic, {_RANK} AS tactic_ord, technique_id, count, CAST(sum(count) OVER (PARTITION BY tactic) AS BIGINT) AS tactic_total,
  count / (max(count) OVER ())::DOUBLE AS intensity FROM st""")
def _(t):
    return K.heatmap(K.technique_stats(t.reports))


@query("k10_report_overview", f"""{_ALL} SELECT {', '.join(_cnt(f"severity = '{s}'", s.lower()) for s in _SEV)}, round(coalesce(avg(risk_score) / 10, 0), 9) AS avg_risk_score,
  (SELECT count(*) FROM findings) AS total_findings FROM reports""")
def _(t):
    return K.report_overview(t.reports, t.findings).withColumn("avg_risk_score", F.round("avg_risk_score", 9))


@query("k11_risk_histogram", f"{_R} SELECT " + ", ".join(_cnt(f"least(4, floor(risk_score / 2)) = {i}", f"bin_{i}") for i in range(5)) + " FROM reports")
def _(t):
    return K.risk_histogram(t.reports)


@query("k12_usage_breakdown", f"""WITH {JOB_CTE}, {REPORT_CTE} SELECT {_cnt("file_type = 'Eml'", 'email')}, {_cnt("file_type <> 'Eml'", 'cloudtrail')},
  {_cnt("status = 'Done'", 'completed')}, {_cnt("status = 'Failed'", 'failed')}, (SELECT count(*) FROM reports) AS threat_intel FROM jobs""")
def _(t):
    return K.usage_breakdown(t.jobs, t.reports)


_VIEW = "CASE status WHEN 'Done' THEN 'completed' WHEN 'Failed' THEN 'failed' ELSE 'running' END"
_ROWS = f"""fc AS (SELECT job_id, count(*) AS n FROM findings GROUP BY job_id),
  rows_ AS (SELECT id AS job_id, CASE WHEN file_type = 'Eml' THEN 'email' ELSE 'cloudtrail' END AS event_type, {_VIEW} AS view_status,
    coalesce(risk_score, 0.0::DOUBLE) / 10 AS risk, lower(severity) AS severity, jobs.created_at AS created_at, coalesce(n, 0) AS finding_count
    FROM jobs LEFT JOIN reports ON id = reports.job_id LEFT JOIN fc ON id = fc.job_id),
  view_ AS (SELECT *, CASE WHEN risk * 100 > 70 THEN 'MALICIOUS' WHEN risk * 100 > 40 OR (coalesce(severity IN ('high', 'critical'), false) AND finding_count > 0)
    THEN 'SUSPICIOUS' ELSE 'SAFE' END AS row_verdict FROM rows_)"""


@query("k13_recent_reports", f"{_ALL}, {_ROWS} SELECT job_id, event_type, view_status, risk, severity, {_sec('created_at')}, finding_count FROM view_")
def _(t):
    r = K.recent_reports(t.jobs, t.reports, t.findings)
    return r.select("job_id", "event_type", "view_status", "risk", "severity", seconds("created_at"), "finding_count")


@query("k14_row_verdict", f"{_ALL}, {_ROWS} SELECT job_id, row_verdict FROM view_")
def _(t):
    return K.recent_reports(t.jobs, t.reports, t.findings).select("job_id", "row_verdict")


_FROM_RISK = "CASE WHEN p >= 80 THEN 'critical' WHEN p >= 60 THEN 'high' WHEN p >= 40 THEN 'medium' ELSE 'low' END"


@query("k15_severity_from_risk", f"""SELECT p_partkey, {_FROM_RISK} AS severity, CASE WHEN p_type IN ('HIGH', 'MEDIUM') THEN lower(p_type) ELSE 'low' END AS normalized
  FROM (SELECT p_partkey, p_type, CASE WHEN r <= 1 THEN r * 100 ELSE r END AS p FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'HIGH' WHEN p_size % 5 = 1 THEN 'MEDIUM' ELSE p_type END AS p_type,
    CASE WHEN p_partkey % 2 = 0 THEN p_size / 64.0::DOUBLE ELSE p_size * 2.0::DOUBLE END AS r FROM part))""")
def _(t):
    risk = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") / 64.0).otherwise(F.col("p_size") * 2.0)
    text = F.when(F.col("p_size") % 5 == 0, "HIGH").when(F.col("p_size") % 5 == 1, "Medium").otherwise(F.col("p_type"))
    return t.table("part").select("p_partkey", scoring.severity_from_risk(risk).alias("severity"), scoring.normalize_severity(text).alias("normalized"))


@query("k16_alerts_page", f"""{_ALL}, {_ROWS} SELECT job_id, risk, row_verdict FROM view_ WHERE row_verdict = 'SUSPICIOUS'
  AND coalesce(severity, CASE WHEN risk * 100 >= 80 THEN 'critical' WHEN risk * 100 >= 60 THEN 'high' WHEN risk * 100 >= 40 THEN 'medium' ELSE 'low' END) = 'high'
  ORDER BY risk DESC, job_id LIMIT 25 OFFSET 25""")
def _(t):
    rows = K.recent_reports(t.jobs, t.reports, t.findings)
    return K.alerts_page(rows, "high", "SUSPICIOUS", "risk", False, page=2, page_size=25).select("job_id", "risk", "row_verdict")


@query("k17_processing_seconds", f"{_J} SELECT id, CAST(epoch(finished_at) - epoch(started_at) AS DOUBLE) AS seconds FROM jobs")
def _(t):
    return t.jobs.select("id", scoring.processing_seconds("started_at", "finished_at").alias("seconds"))


@query("k18_kpi_strip", f"""WITH {JOB_CTE}, {REPORT_CTE} SELECT total_jobs, total_reports, critical_high, avg_risk_score, last_24h_jobs FROM
  (SELECT count(*) AS total_jobs, {_cnt(f'created_at >= {_NOW} - INTERVAL 24 HOUR', 'last_24h_jobs')} FROM jobs),
  (SELECT count(*) AS total_reports, {_cnt("severity IN ('High', 'Critical')", 'critical_high')}, round_even(avg(risk_score) * 100, 0) / 100 AS avg_risk_score FROM reports)""")
def _(t):
    return K.stats(t.jobs, t.reports, now()).select("total_jobs", "total_reports", "critical_high", "avg_risk_score", "last_24h_jobs")


@query("k19_job_page", f"""WITH {JOB_CTE}, {REPORT_CTE}, p AS (SELECT id, status, created_at FROM jobs ORDER BY created_at DESC, id LIMIT 150 OFFSET 150)
  SELECT id, status, CAST((id IN (SELECT job_id FROM reports)) AS INT) AS has_report FROM p""")
def _(t):
    return K.job_page(t.jobs, t.reports, page=2, page_size=150).select("id", "status", F.col("has_report").cast("int").alias("has_report"))


_IDX = "greatest(coalesce(list_position([" + ", ".join(f"'{s}'" for s in STEP_ORDER) + "], current_step), 1) - 1, 0)::INT"
_at = STEP_ORDER.index
_TRACE = f"""fj AS (SELECT jobs.*, coalesce(id IN (SELECT job_id FROM reports), false) AS has_report, {_IDX} AS idx,
    coalesce(started_at, created_at) AS st, coalesce(finished_at, {_NOW}) AS fi FROM jobs),
  trace AS (
    SELECT id AS job_id, 0 AS ord, 'ingest' AS event_id, 'delegation' AS type, 'Upload API' AS source, concat('Ingested ', upper(file_type), ' artifact: ', file_name) AS description, created_at AS ts FROM fj
    UNION ALL SELECT id, 1, 'tier1', 'artifact', 'Tier-1 Filter', 'PII scrubbing, rule checks and ONNX phishing scoring', st FROM fj WHERE idx >= {_at('tier1.filtering')}
    UNION ALL SELECT id, 2, 'tier2-escalation', 'delegation', 'Orchestrator', 'Artifact suspicious — escalated to the Tier-2 agent pipeline', st FROM fj WHERE idx >= {_at('tier2.pending')}
    UNION ALL SELECT id, 3, 'tier2-email', 'artifact', 'Email Analyst', 'LLM email analysis: header parsing, IOC extraction, phishing verdict', st FROM fj WHERE idx >= {_at('tier2.email_analysis')} AND file_type = 'Eml'
    UNION ALL SELECT id, 4, 'tier2-threat', 'enrichment', 'Threat Intel', 'IOC enrichment via VirusTotal / AbuseIPDB (DB-backed cache)', st FROM fj WHERE idx >= {_at('tier2.threat_intel')}
    UNION ALL SELECT id, 5, 'tier2-synthesis', 'synthesis', 'Synthesis', CASE WHEN has_report THEN 'Final report generated' ELSE 'Synthesizing final report...' END, fi FROM fj WHERE idx >= {_at('tier2.synthesis')}
    UNION ALL SELECT id, 6, 'failed', 'error', 'System', coalesce(error_message, concat('Job failed at step ', current_step)), fi FROM fj WHERE status = 'Failed')"""
_T = f"WITH {JOB_CTE}, {REPORT_CTE}, {_TRACE}"


@query("k20_timeline", f"{_T} SELECT job_id, CAST(ord AS INT) AS ord, event_id, type, source, description, {_sec('ts')} FROM trace")
def _(t):
    return traces(t).select("job_id", "ord", "event_id", "type", "source", "description", seconds("ts"))


_NODES = f"""nodes AS (SELECT id AS job_id, node, CASE node
    WHEN 'supervisor' THEN CASE status WHEN 'Failed' THEN 'error' WHEN 'Done' THEN 'completed' ELSE 'running' END
    WHEN 'email' THEN CASE WHEN file_type <> 'Eml' THEN 'idle' WHEN status NOT IN ('Done', 'Failed') AND current_step = 'tier2.email_analysis' THEN 'running'
      WHEN status = 'Failed' AND starts_with(current_step, 'tier2') AND (idx = 0 OR idx >= 3) THEN 'error' WHEN status = 'Done' OR idx > 4 THEN 'completed' ELSE 'idle' END
    WHEN 'forensic' THEN CASE WHEN status NOT IN ('Done', 'Failed') AND (current_step = 'tier1.filtering' OR status = 'Filtering') THEN 'running'
      WHEN status = 'Failed' AND starts_with(current_step, 'tier1') AND (idx = 0 OR idx >= 0) THEN 'error' WHEN status = 'Done' OR idx > 1 THEN 'completed' ELSE 'idle' END
    ELSE CASE WHEN status NOT IN ('Done', 'Failed') AND current_step = 'tier2.threat_intel' THEN 'running'
      WHEN status = 'Failed' AND starts_with(current_step, 'tier2') AND (idx = 0 OR idx >= 4) THEN 'error' WHEN status = 'Done' OR idx > 5 THEN 'completed' ELSE 'idle' END END AS node_state
  FROM fj, (VALUES ('supervisor'), ('email'), ('forensic'), ('threat')) n(node))"""


@query("k21_node_status", f"{_T}, {_NODES} SELECT * FROM nodes")
def _(t):
    return K.node_status(t.jobs).select("job_id", "node", "node_state")


@query("k22_report_view", f"""{_R} SELECT job_id, lower(severity) AS severity, CASE WHEN json_valid(mitre_json) THEN array_to_string(CAST(json(mitre_json) AS VARCHAR[]), '|') ELSE '' END AS mitre,
  CAST(CASE WHEN CAST(job_id AS BIGINT) % 3 = 0 THEN 0 ELSE 1 END AS INT) AS n_evidence FROM reports""")
def _(t):
    r = t.reports.withColumn("actions_json", F.lit('["a"]')).withColumn("evidence_json", F.when(
        F.col("job_id").cast("bigint") % 3 == 0, "[{broken").otherwise(F.to_json(F.array(F.struct(F.col("summary").alias("claim"), F.lit("s").alias("source"))))))
    return K.report_view(r).select("job_id", "severity", F.array_join("mitre", "|").alias("mitre"), F.size("evidence").alias("n_evidence"))


@query("k23_agent_log", f"{_T} SELECT job_id, source, {_sec('ts')} FROM trace WHERE source IN ('Orchestrator', 'Upload API')")
def _(t):
    return K.agent_log(traces(t), "supervisor").select("job_id", "source", seconds("ts"))


@query("k24_trace_counters", f"{_T} SELECT job_id, count(*) AS events_processed, count(*) FILTER (WHERE type IN ('delegation', 'synthesis')) * 0.001::DOUBLE AS est_cost FROM trace GROUP BY job_id")
def _(t):
    return K.trace_counters(traces(t))


@query("k25_stage_status", f"""{_T}, {_NODES}, ag AS (SELECT job_id, bool_or(node_state = 'running') AS r, bool_or(node_state = 'completed') AS c FROM nodes WHERE node <> 'supervisor' GROUP BY job_id),
  la AS (SELECT job_id, arg_max(source, ord) AS last_source, count(*) AS n FROM trace GROUP BY job_id)
  SELECT id AS job_id, stage, CASE stage WHEN 'eventbridge' THEN 'completed'
    WHEN 'supervisor' THEN CASE WHEN status = 'Done' OR has_report THEN 'completed' WHEN n > 1 THEN 'completed' ELSE 'idle' END
    WHEN 'agents' THEN CASE WHEN status = 'Done' OR has_report THEN 'completed' WHEN r THEN 'running' WHEN c THEN 'completed' ELSE 'idle' END
    WHEN 'synthesis' THEN CASE WHEN has_report THEN 'completed' WHEN status NOT IN ('Done', 'Failed') AND last_source = 'Synthesis' THEN 'running' ELSE 'idle' END
    ELSE CASE WHEN status = 'Failed' THEN 'error' WHEN has_report THEN 'completed' ELSE 'idle' END END AS stage_state
  FROM fj JOIN ag ON id = ag.job_id JOIN la ON id = la.job_id, (VALUES ('eventbridge'), ('supervisor'), ('agents'), ('synthesis'), ('verdict')) s(stage)""")
def _(t):
    return K.stage_status(flagged_jobs(t), K.node_status(t.jobs), traces(t))


@query("k26_findings_by_agent", f"{_F} SELECT job_id, source AS agent, count(*) AS n_findings, min(claim) AS first_claim, max(claim) AS last_claim FROM findings GROUP BY ALL")
def _(t):
    return K.findings_by_agent(t.findings)


@query("k26_findings_of_trace", f"{_F} SELECT * FROM findings WHERE contains(source, 'threat')")
def _(t):
    return K.findings_of_trace(t.findings, "Threat Intel")


@query("k27_fallback_view", f"""{_ALL}, {_ROWS}, {_TRACE}, sp AS (SELECT job_id, epoch(arg_max(ts, ord)) - epoch(arg_min(ts, ord)) AS s, count(*) AS n FROM trace GROUP BY job_id)
  SELECT job_id, CASE WHEN risk > 0.4 THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS decision, CAST(floor(risk * 100 + 0.5) AS INT) AS static_risk_score,
  CASE WHEN n > 1 AND s > 0 THEN CAST(s AS DOUBLE) END AS duration_seconds FROM view_ JOIN sp USING (job_id)""")
def _(t):
    return K.fallback_view(K.recent_reports(t.jobs, t.reports, t.findings), traces(t))


# --- joins of the job list ------------------------------------------------------------------------------


@query("j11_report_flag", f"WITH {JOB_CTE}, {REPORT_CTE} SELECT id, CAST((id IN (SELECT job_id FROM reports)) AS INT) AS has_report FROM jobs")
def _(t):
    return flagged_jobs(t).select("id", F.col("has_report").cast("int").alias("has_report"))


@query("j12_report_state", f"""WITH {JOB_CTE}, {REPORT_CTE}, a AS (SELECT DISTINCT CAST(l_orderkey + 100 AS STRING) AS id FROM lineitem)
  SELECT a.id, CASE WHEN jobs.id IS NULL THEN 'missing' WHEN reports.job_id IS NOT NULL THEN 'ready' WHEN status = 'Failed' THEN 'failed' ELSE 'pending' END AS state, risk_score
  FROM a LEFT JOIN jobs USING (id) LEFT JOIN reports ON a.id = reports.job_id""")
def _(t):
    asked = t.table("lineitem").select((F.col("l_orderkey") + 100).cast("string").alias("id")).distinct()
    return K.report_states(asked, t.jobs, t.reports).select("id", "state", "risk_score")


@query("j13_similar_reports", f"""WITH {REPORT_CTE}, e AS (SELECT vec_id, label FROM embeddings)
  SELECT vec_id AS query_id, job_id, severity, risk_score, summary AS excerpt FROM e JOIN reports ON CAST(job_id AS BIGINT) = vec_id * 3 + label""")
def _(t):
    """Matches joined with the reports they point to."""
    from ..operators.similarity import attach_reports
    from .catalog_intel import tier1_rows
    matches = t.table("embeddings").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") * 3 + F.col("label")).alias("id"))
    reports = t.reports.withColumn("report_id", F.col("job_id").cast("bigint"))
    found = attach_reports(matches, reports, tier1_rows(t))
    return found.select("query_id", F.col("id").cast("string").alias("job_id"), "severity", "risk_score", "excerpt")
