"""Registered queries on log events: detection rules, statistics, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import log_checks as L
from ..operators import rules as R
from ..session import materialize
from ..sources.csv_logs import normalize_key
from ..sources.rule_pack import load_rules, parse_rule
from .lens import LOG_CTE, LOG_FIELDS, Lens, query

PACK = load_rules()
# The data has no outlier beyond three deviations, so the queries use a lower threshold.
Z = 2.2


def column_lookup(t: Lens) -> R.FieldLookup:
    """Field lookup on the columns that a CSV export would have put into the map."""
    return R.column_fields(t.logs, {k: F.col(c) for k, c in LOG_FIELDS.items()})


# --- single predicates ------------------------------------------------------------------------------

_W = f"WITH {LOG_CTE}"


def _rule_query(name: str, detection: str, where: str) -> None:
    rule = parse_rule(f"title: {name}\ndetection:\n{detection}\n")
    query(name, f"{_W} SELECT event_id, event_name FROM logs WHERE {where}")(
        lambda t: t.log_events.filter(R.rule_column(rule)).select("event_id", "event_name")
    )


_rule_query("c2_exact", "  s: {eventName: [listBUCKETS, createuser]}\n  condition: s",
            "lower(event_name) IN ('listbuckets', 'createuser')")
_rule_query("c3_contains", "  s: {eventName|contains: BUCKET}\n  condition: s", "contains(lower(event_name), 'bucket')")
_rule_query("c4_startswith", "  s: {eventName|startswith: create}\n  condition: s", "starts_with(lower(event_name), 'create')")
_rule_query("c5_endswith", "  s: {eventName|endswith: USER}\n  condition: s", "ends_with(lower(event_name), 'user')")
_rule_query("c6_wildcards", "  s: {eventName|contains: ['get*ACL', 'list?sers']}\n  condition: s",
            "regexp_matches(lower(event_name), '^get.*acl$|^list.sers$')")
_rule_query("c7_missing_field", "  s: {eventSource: signin.amazonaws.com}\n  m: {additionalEventData.MFAUsed: 'Yes'}\n  condition: s and not m",
            "event_source = 'signin.amazonaws.com' AND NOT coalesce(lower(mfa_used) = 'yes', false)")
_rule_query("c8_or_values_and_fields", "  s:\n    eventName: [ListUsers, PutObject]\n    userAgent|contains: CLI\n  condition: s",
            "lower(event_name) IN ('listusers', 'putobject') AND contains(lower(user_agent), 'cli')")
_rule_query("c9_condition", "  a: {eventName: ListUsers}\n  b: {userAgent: console}\n  c: {userIdentity.type: root}\n  condition: not (a or b) and c or a and not c",
            "(NOT (lower(event_name) = 'listusers' OR user_agent = 'console') AND identity_type = 'Root') "
            "OR (lower(event_name) = 'listusers' AND identity_type <> 'Root')")
_rule_query("c10_quantifiers", "  x1: {eventName: ListUsers}\n  x2: {userAgent: console}\n  y: {userIdentity.type: root}\n  condition: all of x* or 1 of nothing* or y and 1 of them",
            "(lower(event_name) = 'listusers' AND user_agent = 'console') OR identity_type = 'Root'")


@query("c1_field_keys", "SELECT p_partkey, lower(regexp_replace(concat(p_brand, '.', p_name), '[^\\p{L}\\p{Nd}]', '', 'g')) AS key FROM part")
def _(t):
    return t.table("part").select("p_partkey", normalize_key(F.concat("p_brand", F.lit("."), "p_name")).alias("key"))


# --- the shipped pack -------------------------------------------------------------------------------

_PACK_SQL = {
    "aws_cloudtrail_logging_disabled_or_tampered": ("c15", "event_source = 'cloudtrail.amazonaws.com' AND lower(event_name) IN ('stoplogging', 'deletetrail', 'updatetrail', 'puteventselectors')"),
    "aws_config_recording_disabled": ("c16", "event_source = 'config.amazonaws.com' AND lower(event_name) IN ('stopconfigurationrecorder', 'deletedeliverychannel', 'deleteconfigurationrecorder')"),
    "aws_console_login_without_mfa": ("c17", "event_source = 'signin.amazonaws.com' AND lower(event_name) = 'consolelogin' AND NOT coalesce(lower(mfa_used) = 'yes', false)"),
    "aws_guardduty_detector_disruption": ("c18", "event_source = 'guardduty.amazonaws.com' AND lower(event_name) IN ('deletedetector', 'deleteipset', 'deletethreatintelset', 'stopmonitoringmembers', 'updatedetector', 'disassociatefrommasteraccount')"),
    "aws_iam_backdoor_via_new_access_key": ("c19", "event_source = 'iam.amazonaws.com' AND lower(event_name) = 'createaccesskey'"),
    "aws_iam_privilege_escalation_by_policy_attachment": ("c20", "event_source = 'iam.amazonaws.com' AND lower(event_name) IN ('attachuserpolicy', 'attachrolepolicy', 'attachgrouppolicy', 'putuserpolicy', 'putrolepolicy', 'putgrouppolicy', 'createpolicyversion', 'setdefaultpolicyversion')"),
    "aws_root_account_usage": ("c21", "identity_type = 'Root' AND error_code = ''"),
    "aws_security_group_opened_to_the_world": ("c22", "lower(event_name) = 'authorizesecuritygroupingress' AND (coalesce(contains(cidr_v4, '0.0.0.0/0'), false) OR coalesce(contains(cidr_v6, '::/0'), false))"),
    "aws_sts_assumerole_from_external_account": ("c23", "event_source = 'sts.amazonaws.com' AND lower(event_name) IN ('assumerole', 'assumerolewithsaml', 'assumerolewithwebidentity')"),
}


def _register_pack_rule(rule) -> None:
    label, where = _PACK_SQL[rule.slug]
    # The predicate is evaluated on real columns here, so nothing builds a map.
    query(f"{label}_{rule.slug}", f"{_W} SELECT event_id, event_name, user_name FROM logs WHERE {where}")(
        lambda t: t.logs.filter(R.rule_column(rule, column_lookup(t))).select("event_id", "event_name", "user_name")
    )


for _rule in PACK.rules:
    _register_pack_rule(_rule)

_SLUGS = [r.slug for r in PACK.rules]
_MATCHED = "list_filter([" + ", ".join(f"CASE WHEN {_PACK_SQL[s][1]} THEN '{s}' END" for s in _SLUGS) + "], lambda x: x IS NOT NULL)"
_TITLES = "CASE slug " + " ".join(f"WHEN '{r.slug}' THEN '{r.title}'" for r in PACK.rules) + " END"
_LEVELS = "CASE slug " + " ".join(f"WHEN '{r.slug}' THEN '{r.level}'" for r in PACK.rules) + " END"


@query("c13_matched_rules", f"{_W} SELECT event_id, array_to_string({_MATCHED}, '|') AS rules FROM logs")
def _(t):
    return t.log_events.select("event_id", F.array_join(R.matched_rules(PACK), "|").alias("rules"))


_HITS = f"hits AS (SELECT artifact_id, slug, count(*) AS hits FROM (SELECT artifact_id, unnest({_MATCHED}) AS slug FROM logs) GROUP BY ALL)"


@query("c14_rule_hits", f"{_W}, {_HITS} SELECT artifact_id, slug, {_TITLES} AS title, {_LEVELS} AS level, hits FROM hits")
def _(t):
    return R.rule_hits(t.logs, PACK, ["artifact_id"], column_lookup(t))


@query("c12_rule_slugs", "SELECT p_partkey, trim(regexp_replace(lower(trim(concat(p_name, ' - ', p_type, '!'))), '[^\\p{L}\\p{Nd}]+', '_', 'g'), '_') AS slug FROM part")
def _(t):
    """Part names as rule titles."""
    title = F.concat("p_name", F.lit(" - "), "p_type", F.lit("!"))
    return t.table("part").select("p_partkey", R.slug_column(title).alias("slug"))


# --- checks -----------------------------------------------------------------------------------------

_IN = lambda names: "lower(event_name) IN (" + ", ".join(f"'{n.lower()}'" for n in names) + ")"
_DENIED = "(contains(lower(error_code), 'accessdenied') OR lower(error_message) = 'access denied')"
_A2 = f"""a2 AS (SELECT artifact_id, 'high_risk_api:' || arg_min(event_name, line_no) AS rule FROM logs
  WHERE {_IN(L.HIGH_RISK_EVENTS)} GROUP BY artifact_id, lower(event_name))"""
_A3 = f"""a3 AS (SELECT artifact_id, 'access_denied:' || arg_min(event_name, line_no) AS rule FROM logs
  WHERE {_DENIED} AND event_name <> '' GROUP BY artifact_id, lower(event_name))"""
_A4 = f"""a4 AS (SELECT artifact_id, concat('recon_burst:', user_name, ':', count(*)) AS rule FROM logs
  WHERE {_IN(L.RECON_EVENTS)} GROUP BY artifact_id, user_name HAVING count(*) >= 3)"""


def _freq_sql(key: str, dim: str) -> str:
    """CTEs with z-score and spike rules of one dimension."""
    return f"""{dim}_c AS (SELECT artifact_id, {key} AS key, count(*) AS c FROM logs WHERE {key} <> '' GROUP BY ALL),
{dim}_s AS (SELECT artifact_id, count(*) AS n_keys, avg(c) AS mean, stddev_pop(c) AS std,
  CAST(list_sort(list(c))[count(*) // 2 + 1] AS DOUBLE) AS median FROM {dim}_c GROUP BY artifact_id),
{dim}_z AS (SELECT *, CASE WHEN std > 0 THEN (c - mean) / std ELSE 0 END AS z, greatest(15.0, 5 * median) AS spike_floor
  FROM {dim}_c JOIN {dim}_s USING (artifact_id) WHERE n_keys >= 2),
{dim}_a AS (SELECT artifact_id, CASE WHEN z >= {Z} THEN concat('{dim}_event_count_anomaly:', key, ':z=', printf('%.2f', z))
  ELSE concat('{dim}_event_frequency_spike:', key, ':count=', c) END AS rule FROM {dim}_z WHERE z >= {Z} OR c >= spike_floor)"""


_A5 = _freq_sql("user_name", "user") + ",\n" + _freq_sql("source_ip", "ip")
_A7 = f"""p7 AS (SELECT artifact_id, user_name, source_ip, bool_and({_IN(L.SENSITIVE_EVENTS)}) AS lonely FROM logs
  WHERE user_name <> '' AND source_ip <> '' GROUP BY ALL),
u7 AS (SELECT artifact_id, user_name FROM p7 GROUP BY ALL HAVING count(DISTINCT source_ip) > 1),
a7 AS (SELECT DISTINCT artifact_id, concat_ws(':', 'sensitive_event_unseen_ip', event_name, user_name, source_ip) AS rule
  FROM logs JOIN p7 USING (artifact_id, user_name, source_ip) JOIN u7 USING (artifact_id, user_name)
  WHERE lonely AND {_IN(L.SENSITIVE_EVENTS)})"""
_A8 = f"{_HITS}, a8 AS (SELECT artifact_id, 'sigma:' || slug AS rule FROM hits)"
_ALL = f"""{_W}, {_A2}, {_A3}, {_A4}, {_A5}, {_A7}, {_A8}, r AS (SELECT * FROM a2 UNION ALL SELECT * FROM a3
  UNION ALL SELECT * FROM a4 UNION ALL SELECT * FROM user_a UNION ALL SELECT * FROM ip_a UNION ALL SELECT * FROM a7
  UNION ALL SELECT * FROM a8)"""


def counts_of(t: Lens):
    return L.activity_counts(t.logs)


@query("a1_log_summary", f"""{_W} SELECT artifact_id, CAST(count(*) AS BIGINT) AS record_count,
  count(DISTINCT nullif(user_name, '')) AS user_count, count(DISTINCT nullif(source_ip, '')) AS ip_count FROM logs GROUP BY ALL""")
def _(t):
    return L.summary(counts_of(t))


@query("a1_unique_ips", f"""{_W} SELECT artifact_id, source_ip, min(line_no) AS first_line FROM logs WHERE source_ip <> '' GROUP BY ALL""")
def _(t):
    return L.unique_ips(counts_of(t))


@query("a2_high_risk_api", f"{_W}, {_A2} SELECT * FROM a2")
def _(t):
    return L.high_risk(counts_of(t)).select("artifact_id", "rule")


@query("a3_access_denied", f"{_W}, {_A3} SELECT * FROM a3")
def _(t):
    return L.access_denied(counts_of(t)).select("artifact_id", "rule")


@query("a4_recon_burst", f"{_W}, {_A4} SELECT * FROM a4")
def _(t):
    return L.recon_bursts(counts_of(t)).select("artifact_id", "rule")


@query("a5_frequency_stats", f"""{_W}, {_freq_sql('user_name', 'user')} SELECT artifact_id, n_keys, round(mean, 6) AS mean,
  round(std, 6) AS std, median, greatest(15.0, 5 * median)::DOUBLE AS spike_floor FROM user_s""")
def _(t):
    s = L.frequency_stats(L.key_counts(counts_of(t), "user_name"))
    return s.select("artifact_id", "n_keys", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "median", "spike_floor")


@query("a5_user_anomalies", f"{_W}, {_freq_sql('user_name', 'user')} SELECT * FROM user_a")
def _(t):
    return L.frequency_anomalies(counts_of(t), "user_name", "user", Z).select("artifact_id", "rule")


@query("a5_ip_anomalies", f"{_W}, {_freq_sql('source_ip', 'ip')} SELECT * FROM ip_a")
def _(t):
    return L.frequency_anomalies(counts_of(t), "source_ip", "ip", Z).select("artifact_id", "rule")


# The whole log as one artifact: every name is far above the floor, so only the factor decides.
_WHOLE = LOG_CTE.replace("logs AS (SELECT", "logs AS (SELECT * REPLACE ('all' AS artifact_id) FROM (SELECT", 1) + ")"


@query("a6_frequency_spikes", f"""WITH {_WHOLE}, c AS (SELECT artifact_id, event_name AS key, count(*) AS c FROM logs GROUP BY ALL),
  s AS (SELECT artifact_id, list_sort(list(c))[count(*) // 2 + 1] AS median FROM c GROUP BY ALL)
  SELECT key, CAST(c AS BIGINT) AS c FROM c JOIN s USING (artifact_id) WHERE c >= greatest(15, 5.0 * median)""")
def _(t):
    """Spikes among event names of the whole log, with the anomaly threshold out of reach."""
    keyed = t.logs.select(F.lit("all").alias("artifact_id"), F.col("event_name").alias("user_name"))
    counts = keyed.groupBy("artifact_id", "user_name").agg(F.count("*").alias("n"))
    hits = L.frequency_anomalies(counts, "user_name", "user", float("inf"))
    count = F.regexp_extract("rule", r":count=(\d+)$", 1).cast("bigint")
    return hits.select(F.col("sub").alias("key"), count.alias("c"))


@query("a7_unseen_ip", f"{_W}, {_A7} SELECT * FROM a7")
def _(t):
    return L.unseen_ip(counts_of(t)).select("artifact_id", "rule")


@query("a8_sigma_checks", f"""{_W}, {_HITS} SELECT artifact_id, 'sigma:' || slug AS rule,
  concat({_TITLES}, ' [', {_LEVELS}, '] × ', hits) AS detail FROM hits""")
def _(t):
    return L.sigma_checks(t.logs, PACK, column_lookup(t)).select("artifact_id", "rule", "detail")


@query("a9_log_verdicts", f"""{_ALL}, g AS (SELECT artifact_id, count(*) AS n, count(DISTINCT split_part(rule, ':', 1)) AS f FROM r GROUP BY ALL)
  SELECT artifact_id, CAST(coalesce(n, 0) AS BIGINT) AS rule_count, CAST(least(100, 15 * coalesce(f, 0)) AS INT) AS risk_score,
  CASE WHEN coalesce(n, 0) > 0 THEN 'Suspicious' ELSE 'Benign' END AS verdict
  FROM (SELECT DISTINCT artifact_id FROM logs) LEFT JOIN g USING (artifact_id)""")
def _(t):
    counts = materialize(counts_of(t), "log-counts")
    rules = L.log_rules(t.logs, PACK, Z, fields=column_lookup(t), counts=counts)
    return L.verdicts(rules, counts.select("artifact_id").distinct())


@query("a10_log_rules", f"{_ALL} SELECT artifact_id, rule FROM r")
def _(t):
    counts = materialize(counts_of(t), "log-counts")
    return L.log_rules(t.logs, PACK, Z, fields=column_lookup(t), counts=counts).select("artifact_id", "rule")


@query("a10_log_reports", f"""{_ALL}, g AS (SELECT artifact_id, count(*) AS n, count(DISTINCT split_part(rule, ':', 1)) AS f,
    string_agg(rule, '|' ORDER BY rule) AS rules FROM r GROUP BY ALL),
  c AS (SELECT artifact_id, count(*) AS record_count, count(DISTINCT nullif(user_name, '')) AS user_count FROM logs GROUP BY ALL),
  i AS (SELECT artifact_id, string_agg(source_ip, '|' ORDER BY first_line) AS unique_ips FROM
    (SELECT artifact_id, source_ip, min(line_no) AS first_line FROM logs WHERE source_ip <> '' GROUP BY ALL) GROUP BY ALL)
  SELECT artifact_id, CAST(least(100, 15 * f) AS INT) AS risk_score, rules, record_count, user_count, unique_ips
  FROM g JOIN c USING (artifact_id) JOIN i USING (artifact_id)""")
def _(t):
    """Assembled reports. An artifact has 500 lines here, so its arrays are bounded."""
    artifacts = t.logs.select("artifact_id").distinct()
    r = L.log_reports(artifacts, t.logs, PACK, Z, in_key_order=False, fields=column_lookup(t))
    return r.select(
        "artifact_id", "risk_score", F.array_join(F.array_sort("matched_rules"), "|").alias("rules"),
        "extracted.record_count", "extracted.user_count", F.array_join("extracted.unique_ips", "|").alias("unique_ips"),
    )


@query("a11_empty_artifacts", f"""{_W}, a AS (SELECT DISTINCT artifact_id FROM logs UNION ALL
    SELECT DISTINCT 'empty-' || artifact_id FROM logs), {_A4}, g AS (SELECT artifact_id, count(*) AS n FROM a4 GROUP BY ALL)
  SELECT artifact_id, CAST(coalesce(n, 0) AS BIGINT) AS rule_count, CAST(CASE WHEN n > 0 THEN 15 ELSE 0 END AS INT) AS risk_score,
  CASE WHEN n > 0 THEN 'Suspicious' ELSE 'Benign' END AS verdict FROM a LEFT JOIN g USING (artifact_id)""")
def _(t):
    """Artifacts without rows stay in the result as benign."""
    ids = t.logs.select("artifact_id").distinct()
    both = ids.unionByName(ids.select(F.concat(F.lit("empty-"), "artifact_id").alias("artifact_id")))
    return L.verdicts(L.recon_bursts(counts_of(t)), both)


@query("e16_verdict_policy", f"""WITH l AS (SELECT doc_id, toxic, quality FROM labels)
  SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR (CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 0.5 + 0.1 * (doc_id % 5) END) >= 0.7
    THEN 'Suspicious' ELSE 'Benign' END AS verdict FROM l""")
def _(t):
    from ..functions.scoring import verdict
    ml = F.when(F.col("doc_id") % 3 != 0, F.round(F.lit(0.5) + F.col("doc_id") % 5 * 0.1, 6))
    n_rules = F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)
    return t.table("labels").select("doc_id", verdict(n_rules, ml).alias("verdict"))


@query("s8_rule_pack", "SELECT slug, level, CAST(count(*) AS BIGINT) AS hits FROM (" + f"{_W} SELECT unnest({_MATCHED}) AS slug FROM logs) JOIN (VALUES " + ", ".join(f"('{r.slug}', '{r.level}')" for r in PACK.rules) + ") v(slug, level) USING (slug) GROUP BY ALL")
def _(t):
    """Rules as loaded from the files, with their hits over the whole log."""
    return R.rule_hits(t.logs, PACK, [], column_lookup(t)).select("slug", "level", "hits")


@query("c11_load_errors", f"""{_W} SELECT CAST(sum(CASE WHEN event_name = 'ListUsers' THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(6 AS INT) AS refused FROM logs""")
def _(t):
    """Broken rules are refused one by one; the good one next to them still runs over the log."""
    from ..sources.rule_pack import RuleError
    texts = [
        "detection: {a: {eventName: x}, condition: a}", "title: t", "title: t\ndetection: {a: {eventName: x}}",
        "title: t\ndetection: {condition: a}", "title: t\ndetection: {a: [x, y], condition: a}",
        "title: t\ndetection: {a: {eventName|re: x}, condition: a}",
        "title: good\ndetection: {a: {eventName: ListUsers}, timeframe: 5m, condition: a}",
    ]
    good, refused = [], 0
    for text in texts:
        try:
            good.append(parse_rule(text))
        except RuleError:
            refused += 1
    hit = R.rule_column(good[0], column_lookup(t))
    return t.logs.agg(F.count_if(hit).alias("hits")).withColumn("refused", F.lit(refused))
