"""The given tables seen as triage data.

Each view is a list of SQL expressions that Spark and DuckDB both understand, so that a query and its
oracle start from the same rows: events become log events, documents become mails, orders become jobs
and reports, line items become findings.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from ..sources.eml import parse_messages

LOG_ROWS_PER_ARTIFACT = 500

_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k"
LOG_BASE = f"event_id, ts, user_id, event_type, value, {_K}"
_IP = """CASE WHEN k >= 97 THEN '' WHEN k >= 85 THEN concat('185.220.101.', CAST(k AS STRING))
  WHEN k >= 70 THEN concat('203.0.113.', CAST(k AS STRING)) ELSE concat('10.0.0.', CAST(k AS STRING)) END"""
_EVENT = """CASE
  WHEN event_type = 'signup' THEN CASE WHEN k < 5 THEN 'CreateUser' WHEN k < 10 THEN 'createuser'
    WHEN k < 15 THEN 'AttachUserPolicy' WHEN k < 18 THEN 'CreateAccessKey' ELSE 'GetObject' END
  WHEN event_type = 'error' THEN CASE WHEN k < 30 THEN 'ListBuckets' WHEN k < 40 THEN 'GetBucketAcl'
    WHEN k < 50 THEN 'listbuckets' ELSE 'PutObject' END
  WHEN event_type = 'view' THEN CASE WHEN k < 40 THEN 'DescribeInstances' WHEN k < 60 THEN 'ListUsers'
    WHEN k < 85 THEN 'GetObject' ELSE 'AuthorizeSecurityGroupIngress' END
  WHEN event_type = 'purchase' THEN CASE WHEN k < 15 THEN 'ConsoleLogin' WHEN k < 20 THEN 'AssumeRole'
    WHEN k < 23 THEN 'StopLogging' ELSE 'PutObject' END
  ELSE CASE WHEN k < 3 THEN 'DeleteDetector' WHEN k < 6 THEN 'StopConfigurationRecorder' ELSE 'GetObject' END END"""
_SOURCE = """CASE
  WHEN event_type = 'signup' THEN 'iam.amazonaws.com'
  WHEN event_type = 'purchase' AND k < 15 THEN 'signin.amazonaws.com'
  WHEN event_type = 'purchase' AND k < 20 THEN 'sts.amazonaws.com'
  WHEN event_type = 'purchase' AND k < 23 THEN 'cloudtrail.amazonaws.com'
  WHEN event_type = 'click' AND k < 3 THEN 'guardduty.amazonaws.com'
  WHEN event_type = 'click' AND k < 6 THEN 'config.amazonaws.com'
  WHEN event_type = 'view' THEN 'ec2.amazonaws.com' ELSE 's3.amazonaws.com' END"""
LOG_EXPRS: dict[str, str] = {
    "event_id": "event_id",
    "ts": "ts",
    "k": "k",
    "user_id": "user_id",
    "event_type": "event_type",
    # Consecutive log files of 500 lines each: an artifact has a fixed size, their number grows.
    "artifact_id": f"concat('log-', CAST(CAST(floor(event_id / {LOG_ROWS_PER_ARTIFACT}) AS BIGINT) AS STRING))",
    "line_no": "event_id",
    "event_time": "CAST(ts AS STRING)",
    "event_name": _EVENT,
    "source_ip": _IP,
    "user_name": "CASE WHEN user_id % 41 = 0 THEN '' ELSE concat('u', CAST(user_id AS STRING)) END",
    "error_code": "CASE WHEN event_type = 'error' AND k % 3 = 0 THEN 'Client.AccessDeniedException' ELSE '' END",
    "error_message": "CASE WHEN event_type = 'error' AND k % 3 = 1 THEN 'access DENIED' ELSE '' END",
    "user_agent": "CASE WHEN k % 2 = 0 THEN 'console' ELSE 'aws-cli/2.1' END",
    "event_source": _SOURCE,
    "mfa_used": "CASE WHEN k % 3 = 0 THEN 'yes' WHEN k % 3 = 1 THEN 'No' ELSE NULL END",
    "identity_type": "CASE WHEN user_id % 29 = 0 THEN 'Root' ELSE 'IAMUser' END",
    "cidr_v4": "CASE WHEN event_type = 'view' AND k >= 92 THEN 'cidr 0.0.0.0/0' ELSE NULL END",
    "cidr_v6": "CASE WHEN event_type = 'view' AND k < 88 THEN '::/0' ELSE NULL END",
}
# Names of the map keys a CSV export of these events would have.
LOG_FIELDS = {
    "eventtime": "event_time", "eventname": "event_name", "eventsource": "event_source",
    "sourceipaddress": "source_ip", "useridentityusername": "user_name", "errorcode": "error_code",
    "useragent": "user_agent", "additionaleventdatamfaused": "mfa_used", "useridentitytype": "identity_type",
    "requestparameterscidrip": "cidr_v4", "requestparametersipv6cidrblock": "cidr_v6",
}

_D = "CAST(doc_id AS STRING)"
MAIL_EXPRS: dict[str, str] = {
    "doc_id": "doc_id",
    "source": "source",
    "subject": """CASE doc_id % 14 WHEN 0 THEN 'URGENT: Verify your account today' WHEN 1 THEN 'Reset your password within 24 hours'
      WHEN 2 THEN 'Your account suspended' WHEN 3 THEN 'Click here to claim your prize' WHEN 4 THEN 'Sign in to your portal'
      WHEN 5 THEN 'Wire transfer declined: bank account alert' WHEN 6 THEN 'Enter your password to continue'
      WHEN 7 THEN 'Internal audit: mandatory compliance update' WHEN 8 THEN 'Meeting notes'
      WHEN 9 THEN 'See attached invoice, final warning' WHEN 10 THEN 'Login from new device - secure your account'
      WHEN 11 THEN 'Confirm your identity: social security' WHEN 12 THEN 'Quarterly numbers' ELSE NULL END""",
    "from_header": """CASE doc_id % 11 WHEN 0 THEN '"PayPal" <security@paypa1-alerts.xyz>' WHEN 1 THEN 'Bank <no-reply@secure-mybank-login.com>'
      WHEN 2 THEN 'Alice <alice@example.org>' WHEN 3 THEN '"MS" <help@micros0ft-login.com>' WHEN 4 THEN 'news@mail.paypal.com'
      WHEN 5 THEN 'Undisclosed' WHEN 6 THEN 'Swift Desk <desk@swift-payments.net>' WHEN 7 THEN 'Bob <bob@Example.COM>'
      WHEN 8 THEN 'ops@federal-reserve-notice.org' WHEN 9 THEN 'x <x@12345numbers.com>' ELSE NULL END""",
    "auth_header": """CASE doc_id % 5 WHEN 0 THEN 'mx.example; spf=fail smtp.from=x; dkim=pass; dmarc=fail'
      WHEN 1 THEN 'mx; SPF=SoftFail; dkim=none' WHEN 2 THEN 'mx; spf=pass; dkim=pass; dmarc=pass; spf=fail' ELSE NULL END""",
    "received_1": "concat('from a ([203.0.113.', CAST(doc_id % 200 AS STRING), ']) by mx')",
    "received_2": "CASE WHEN doc_id % 3 = 0 THEN concat('from b (198.51.100.', CAST(doc_id % 100 AS STRING), ')') ELSE NULL END",
    "origin": "CASE WHEN doc_id % 4 = 0 THEN concat('[192.0.2.', CAST(doc_id % 50 AS STRING), ']') ELSE NULL END",
    "body": f"""concat(replace(text, concat(chr(13), chr(10)), chr(10)), chr(10),
      CASE doc_id % 9 WHEN 0 THEN 'Please verify your account immediately.' WHEN 1 THEN 'Your account LOCKED; act now.'
      WHEN 2 THEN 'Open the attachment.' WHEN 3 THEN 'Review your logs; unusual login seen.' WHEN 4 THEN 'Final warning: expires soon'
      WHEN 5 THEN 'You have won' ELSE 'Regards' END,
      CASE doc_id % 6 WHEN 0 THEN concat(' http://185.220.101.', CAST(doc_id % 200 AS STRING), '/login?x=1')
      WHEN 1 THEN ' see https://secure-update-login.example.com/a and index.html'
      WHEN 2 THEN concat(' go https://portal.bank-', CAST(doc_id % 7 AS STRING), '.xyz/in')
      WHEN 3 THEN concat(' or https://www.example.com/p', CAST(doc_id % 10 AS STRING), ' HTTPS://WWW.example.com/P', CAST(doc_id % 10 AS STRING))
      ELSE '' END)""",
}

_O = "CAST(o_orderkey AS STRING)"
_STATUS = """CASE o_orderstatus WHEN 'F' THEN 'Done'
  WHEN 'P' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'Failed' ELSE 'Done' END
  ELSE CASE o_orderkey % 3 WHEN 0 THEN 'Queued' WHEN 1 THEN 'Filtering' ELSE 'Analyzing' END END"""
JOB_BASE = f"o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, {_STATUS} AS status"
_TYPE = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Eml' WHEN o_orderpriority = '3-MEDIUM' THEN 'Json' ELSE 'Csv' END"
JOB_EXPRS: dict[str, str] = {
    "id": _O,
    "file_name": f"concat('artifact-', {_O})",
    "file_type": _TYPE,
    "status": "status",
    "current_step": f"""CASE status WHEN 'Queued' THEN 'queued' WHEN 'Filtering' THEN 'tier1.filtering'
      WHEN 'Done' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'tier1.done' ELSE 'done' END
      WHEN 'Failed' THEN CASE o_orderkey % 12 WHEN 0 THEN 'tier1.failed' ELSE 'tier2.failed' END
      ELSE CASE o_orderkey % 4 WHEN 0 THEN 'tier2.pending' WHEN 1 THEN 'tier2.threat_intel' WHEN 2 THEN 'tier2.synthesis_pending'
        ELSE CASE WHEN {_TYPE} = 'Eml' THEN 'tier2.email_analysis' ELSE 'tier2.synthesis' END END END""",
    "error_message": "CASE WHEN status = 'Failed' AND o_orderkey % 8 = 0 THEN 'boom' ELSE NULL END",
    # The dates have no time of day; a share of the price spreads jobs over it.
    "created_at": "o_orderdate + INTERVAL '1' SECOND * CAST(o_orderkey % 86400 AS INT)",
    "started_at": """CASE WHEN status = 'Queued' THEN NULL
      ELSE o_orderdate + INTERVAL '1' SECOND * CAST(o_orderkey % 86400 + o_custkey % 600 AS INT) END""",
    "finished_at": """CASE WHEN status IN ('Done', 'Failed')
      THEN o_orderdate + INTERVAL '1' SECOND * CAST(o_orderkey % 86400 + o_custkey % 600 + 5 + o_orderkey % 3000 AS INT) ELSE NULL END""",
}
# Only finished jobs that were suspicious have a report.
REPORT_FILTER = "status = 'Done' AND o_orderkey % 2 = 1"
_RISK = "floor(o_totalprice / 5000) / 10.0"
REPORT_EXPRS: dict[str, str] = {
    "job_id": _O,
    "risk_score": f"CAST({_RISK} AS DOUBLE)",
    "severity": f"CASE WHEN {_RISK} < 2.5 THEN 'Low' WHEN {_RISK} < 5.0 THEN 'Medium' WHEN {_RISK} < 7.5 THEN 'High' ELSE 'Critical' END",
    "summary": f"concat('Incident of job ', {_O}, ': customer ', CAST(o_custkey AS STRING))",
    "mitre_json": """CASE o_orderkey % 7 WHEN 0 THEN '["T1566.002","T1566"]' WHEN 1 THEN '["T1087","T1098"]'
      WHEN 2 THEN '["T1562.008", "T1078"]' WHEN 3 THEN '["t1078"," T1110.999 "]' WHEN 4 THEN 'not json'
      WHEN 5 THEN '["T9999","", "T1059.001"]' ELSE '["T1537","T1486"]' END""",
    "created_at": "o_orderdate + INTERVAL '1' SECOND * CAST(o_orderkey % 86400 + 4000 AS INT)",
}
FINDING_EXPRS: dict[str, str] = {
    "job_id": "CAST(l_orderkey AS STRING)",
    "source": """CASE l_linenumber % 4 WHEN 0 THEN 'email_analysis' WHEN 1 THEN 'intel:VirusTotal'
      WHEN 2 THEN 'tier1.rule_check_results' ELSE 'threat_feed' END""",
    "claim": "concat('part ', CAST(l_partkey AS STRING), ' of supplier ', CAST(l_suppkey AS STRING))",
}


def _select(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in exprs.items())


# Common table expressions of the same views for the oracle.
LOG_CTE = f"logs AS (SELECT {_select(LOG_EXPRS)} FROM (SELECT {LOG_BASE} FROM events))"
MAIL_CTE = f"mails AS (SELECT {_select(MAIL_EXPRS)} FROM documents)"
JOB_CTE = f"jobs AS (SELECT {_select(JOB_EXPRS)} FROM (SELECT {JOB_BASE} FROM orders))"
REPORT_CTE = f"reports AS (SELECT {_select(REPORT_EXPRS)} FROM (SELECT {JOB_BASE} FROM orders) WHERE {REPORT_FILTER})"
FINDING_CTE = (
    f"findings AS (SELECT {_select(FINDING_EXPRS)} FROM lineitem JOIN "
    f"(SELECT o_orderkey FROM (SELECT {JOB_BASE} FROM orders) WHERE {REPORT_FILTER}) ON l_orderkey = o_orderkey)"
)


class Lens:
    """Readers of the views for one data folder. Nothing is computed before an action."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        """Documents on all cores: pattern matching on whole texts outweighs moving them."""
        return spread(self.table("documents"))

    def _view(self, df: DataFrame, exprs: dict[str, str]) -> DataFrame:
        return df.selectExpr(*[f"{e} AS {n}" for n, e in exprs.items()])

    @cached_property
    def logs(self) -> DataFrame:
        base = self.table("events").selectExpr(*_split_top(LOG_BASE))
        return self._view(base, LOG_EXPRS)

    @cached_property
    def log_events(self) -> DataFrame:
        """Logs with the field map of a CSV export; absent fields are left out of the map."""
        pairs = [F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in LOG_FIELDS.items()]
        fields = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))
        return self.logs.withColumn("fields", fields)

    @cached_property
    def mails(self) -> DataFrame:
        return self._view(self.documents, MAIL_EXPRS)

    @cached_property
    def raw_mails(self) -> DataFrame:
        """Mails as raw text with CRLF line ends, a folded header and a broken header line."""
        header = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value))
        head = F.concat_ws(
            "\r\n",
            header("From", F.col("from_header")), F.lit("no colon here"), header("SUBJECT", F.col("subject")),
            header("Authentication-Results", F.col("auth_header")),
            header("Received", F.replace(F.col("received_1"), F.lit("a ("), F.lit("a\r\n\t("))),
            header("Received", F.col("received_2")), header("X-Originating-IP", F.col("origin")),
            F.concat(F.lit("Message-ID: <m"), F.col("doc_id").cast("string"), F.lit("@example.org>")),
        )
        return self.mails.select(
            F.col("doc_id").cast("string").alias("artifact_id"),
            F.concat(head, F.lit("\r\n\r\n"), F.col("body")).alias("raw"),
        )

    @cached_property
    def messages(self) -> DataFrame:
        return parse_messages(self.raw_mails)

    @cached_property
    def jobs(self) -> DataFrame:
        return self._view(self.table("orders").selectExpr(*_split_top(JOB_BASE)), JOB_EXPRS)

    @cached_property
    def reports(self) -> DataFrame:
        base = self.table("orders").selectExpr(*_split_top(JOB_BASE)).filter(REPORT_FILTER)
        return self._view(base, REPORT_EXPRS)

    @cached_property
    def findings(self) -> DataFrame:
        keys = self.table("orders").selectExpr(*_split_top(JOB_BASE)).filter(REPORT_FILTER).select("o_orderkey")
        items = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        return self._view(items.join(keys, items.l_orderkey == keys.o_orderkey, "left_semi"), FINDING_EXPRS)


def _split_top(text: str) -> list[str]:
    """Split a select list at its top-level commas."""
    parts, depth, start, quoted = [], 0, 0, False
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 0:
                parts.append(text[start:i])
                start = i + 1
    return [p.strip() for p in [*parts, text[start:]]]


def epoch_seconds(column: str) -> Column:
    """Whole seconds of the wall-clock time since 1970, whatever the session's time zone is."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query on the views, with its oracle where SQL can express it."""

    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Lens(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
