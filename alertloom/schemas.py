"""Schemas of the triage tables."""

ARTIFACT = (
    "id string, file_name string, file_type string, status string, path string, current_step string, "
    "error_message string, created_at timestamp, started_at timestamp, finished_at timestamp"
)
LOG_EVENT = (
    "artifact_id string, line_no long, event_time string, event_name string, source_ip string, "
    "user_name string, error_code string, error_message string, user_agent string, "
    "fields map<string,string>"
)
EMAIL = "artifact_id string, headers array<struct<name:string,value:string>>, body string"
IOC = "job_id string, type string, value string, extracted_by string"
INTEL_FEED = (
    "source string, type string, value string, http_status int, body string, fetched_at timestamp"
)
INTEL = (
    "type string, value string, source string, raw_response string, malicious_score double, "
    "from_live_api boolean, looked_up_at timestamp"
)
REPORT = (
    "job_id string, risk_score double, severity string, summary string, mitre array<string>, "
    "actions array<string>, evidence array<struct<claim:string,source:string>>, created_at timestamp"
)
ACTIVITY = (
    "event_time timestamp, event_name string, source_ip string, user_identity string, "
    "aws_region string, raw_event string"
)
RULE_REPORT_JSON = (
    "artifactType string, riskScore string, matchedRules array<string>, extracted string"
)

# Enumerations of the data model, in their order.
FILE_TYPES = ["Eml", "Csv", "Json"]
JOB_STATUSES = ["Queued", "Filtering", "Analyzing", "Done", "Failed"]
SEVERITIES = ["Low", "Medium", "High", "Critical"]
IOC_TYPES = ["Ip", "Domain", "Url", "Hash", "Email"]
EMAIL_VERDICTS = ["Phishing", "Suspicious", "Safe"]
STEP_ORDER = [
    "queued",
    "tier1.filtering",
    "tier1.done",
    "tier2.pending",
    "tier2.email_analysis",
    "tier2.threat_intel",
    "tier2.synthesis_pending",
    "tier2.synthesis",
    "done",
]
