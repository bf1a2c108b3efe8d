"""Registered queries on indicators: extraction, scores, feed answers, cache, correlation, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import heuristics as H
from ..functions import network as N
from ..operators import correlate, intel, iocs
from ..operators.email_checks import email_reports
from ..session import scratch_path
from ..sources import activity as activity_table
from ..sources import sinks
from ..sources.intel_feed import parse_feed
from .catalog_email import _REPORT, q
from .lens import JOB_BASE, JOB_EXPRS, LOG_CTE, REPORT_FILTER, Lens, _select, query

# --- lenses of this file ------------------------------------------------------------------------------

# An indicator per part key, of the type that the key selects.
_X_TYPE = "CASE x % 5 WHEN 0 THEN 'Ip' WHEN 1 THEN 'Domain' WHEN 2 THEN 'Url' WHEN 3 THEN 'Hash' ELSE 'Email' END"
_X_VALUE = """CASE x % 5
  WHEN 0 THEN concat('10.', CAST(x % 200 AS STRING), '.', CAST(CAST(floor(x / 200) AS BIGINT) % 200 AS STRING), '.7')
  WHEN 1 THEN concat('D', CAST(x AS STRING), '.example.net') WHEN 2 THEN concat('http://h', CAST(x AS STRING), '.example.org/a')
  WHEN 3 THEN md5(CAST(x AS STRING)) ELSE concat('m', CAST(x AS STRING), '@e.org') END"""
PART_INTEL = {
    "type": _X_TYPE, "value": _X_VALUE, "x": "x",
}
ITEM_CTE = f"""suspicious AS (SELECT o_orderkey FROM (SELECT {JOB_BASE} FROM orders) WHERE {REPORT_FILTER}),
items AS (SELECT CAST(l_orderkey AS STRING) AS job_id, CAST(l_linenumber AS INT) AS pos, {_X_TYPE} AS type, {_X_VALUE} AS value
  FROM (SELECT l_orderkey, l_linenumber, l_partkey AS x FROM lineitem) JOIN suspicious ON l_orderkey = o_orderkey)"""
INTEL_CTE = f"""known AS (SELECT {_select(PART_INTEL)} FROM (SELECT p_partkey AS x FROM part)),
intel AS (SELECT type, value, 'VirusTotal' AS source, x % 100 / 100.0::DOUBLE AS score, x % 2 = 0 AS live FROM known WHERE type <> 'Email'
  UNION ALL SELECT type, value, 'AbuseIpDb', x % 37 / 50.0::DOUBLE, x % 3 = 0 FROM known WHERE type = 'Ip')"""
_ACT_IP = _X_VALUE.replace("x", "(k * 5)").replace("e(k * 5)ample", "example")


def item_iocs(t: Lens) -> DataFrame:
    """Candidates of the suspicious jobs, from their line items."""
    keys = t.table("orders").selectExpr("*").selectExpr(*_job_base()).filter(REPORT_FILTER).select("o_orderkey")
    items = t.table("lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey AS x")
    return items.join(keys, items.l_orderkey == keys.o_orderkey, "left_semi").selectExpr(
        "CAST(l_orderkey AS STRING) AS job_id", "CAST(l_linenumber AS INT) AS pos", f"{_X_TYPE} AS type", f"{_X_VALUE} AS value"
    )


def _job_base() -> list[str]:
    from .lens import _split_top
    return _split_top(JOB_BASE)


def part_intel(t: Lens) -> DataFrame:
    known = t.table("part").selectExpr("p_partkey AS x").selectExpr(f"{_X_TYPE} AS type", f"{_X_VALUE} AS value", "x")
    rows = intel.with_sources(known)
    vt = F.col("source") == "VirusTotal"
    return rows.select(
        "type", "value", "source",
        F.when(vt, F.col("x") % 100 / 100.0).otherwise(F.col("x") % 37 / 50.0).alias("malicious_score"),
        F.when(vt, F.col("x") % 2 == 0).otherwise(F.col("x") % 3 == 0).alias("from_live_api"),
    )


def item_activity(t: Lens) -> DataFrame:
    """Log rows whose addresses are those of indicators."""
    return t.logs.selectExpr(
        "ts AS event_time", "event_name", f"{_ACT_IP} AS source_ip", "user_name AS user_identity",
        "'us-east-1' AS aws_region", "event_id",
    )


TIER1_EXPRS = {
    "job_id": "id",
    "verdict": "'Suspicious'",
    "risk_score": "CAST(CAST(id AS BIGINT) % 101 AS INT)",
    "ml_score": "CASE WHEN file_type = 'Eml' THEN CAST(CAST(id AS BIGINT) % 1000 AS DOUBLE) / 1000 ELSE NULL END",
    "matched_rules": """CASE WHEN file_type = 'Json' THEN array('unsupported_artifact_escalated')
      WHEN file_type = 'Eml' THEN CASE CAST(id AS BIGINT) % 3 WHEN 0 THEN array('urgent_action_required', 'suspicious_domain:a.com')
        WHEN 1 THEN array('lookalike_domain:b.com') ELSE array('other:c') END
      ELSE CASE CAST(id AS BIGINT) % 5 WHEN 0 THEN array('high_risk_api:StopLogging', 'access_denied:ListBuckets')
        WHEN 1 THEN array('high_risk_api:CreateUser', 'recon_burst:u1:3') WHEN 2 THEN array('user_event_count_anomaly:u:z=3.10')
        WHEN 3 THEN array('sigma:some_rule') ELSE array('ip_event_frequency_spike:1.1.1.1:count=20', 'high_risk_api:DeleteTrail') END END""",
}
# DuckDB spells an array differently.
TIER1_CTE = f"""tier1 AS (SELECT {_select(TIER1_EXPRS).replace('array(', 'list_value(')}, file_type, file_name
  FROM (SELECT {_select(JOB_EXPRS)} FROM (SELECT {JOB_BASE} FROM orders) WHERE {REPORT_FILTER}))"""


def suspicious_jobs(t: Lens) -> DataFrame:
    return t.table("orders").selectExpr(*_job_base()).filter(REPORT_FILTER).selectExpr(
        *[f"{e} AS {n}" for n, e in JOB_EXPRS.items()]
    )


def tier1_rows(t: Lens) -> DataFrame:
    return suspicious_jobs(t).selectExpr(*[f"{e} AS {n}" for n, e in TIER1_EXPRS.items()])


# --- heuristics ---------------------------------------------------------------------------------------


def heur_ip_sql(v: str) -> tuple[str, str]:
    """(score, flags joined by |) of an address in the oracle's dialect."""
    private = f"regexp_matches({v}, {q(H.PRIVATE_RANGES)})"
    tor = "(" + " OR ".join(f"starts_with({v}, '{p}')" for p in H.TOR_PREFIXES) + ")"
    octet = f"try_cast(split_part({v}, '.', 1) AS INT)"
    geo = f"(regexp_matches({v}, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$') AND ({octet} BETWEEN 176 AND 185 OR {octet} BETWEEN 36 AND 41))"
    score = f"CASE WHEN {private} THEN 0.0::DOUBLE ELSE CASE WHEN {tor} THEN 0.40::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN {geo} THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END END"
    flags = f"CASE WHEN {private} THEN 'internal_ip' ELSE concat_ws('|', CASE WHEN {tor} THEN 'known_tor_exit_prefix' END, CASE WHEN {geo} THEN 'high_risk_geo_range' END) END"
    return score, flags


def heur_domain_sql(v: str) -> tuple[str, str]:
    labels = f"list_filter(string_split(rtrim(trim({v}), '.'), '.'), lambda l: l <> '')"
    tld, second = f"lower({labels}[-1])", f"CASE WHEN len({labels}) >= 2 THEN {labels}[-2] END"
    trusted = f"(lower(concat_ws('.', {second}, {tld})) IN (" + ", ".join(f"'{d}'" for d in H.TRUSTED_DOMAINS) + "))"
    risky = f"({tld} IN (" + ", ".join(f"'{d}'" for d in H.RISKY_TLDS) + "))"
    words = f"regexp_matches(lower({v}), {q('|'.join(H.MALICIOUS_WORDS))})"
    hyphens = f"coalesce(length({second}) - length(replace({second}, '-', '')) >= 2, false)"
    add = lambda c, n: f"CASE WHEN {c} THEN {n}::DOUBLE ELSE 0.0::DOUBLE END"
    score = f"CASE WHEN {trusted} THEN 0.0::DOUBLE ELSE {add(risky, 0.25)} + {add(words, 0.30)} + {add(hyphens, 0.15)} END"
    flags = f"CASE WHEN {trusted} THEN 'whitelisted_domain' ELSE concat_ws('|', CASE WHEN {risky} THEN concat('high_risk_tld:.', {tld}) END, CASE WHEN {words} THEN 'brand_impersonation_pattern' END, CASE WHEN {hyphens} THEN 'multi_hyphen_domain' END) END"
    return score, flags


_IP_EXPR = """CASE WHEN o_orderkey % 20 = 0 THEN concat('185.220.101.', CAST(o_custkey % 256 AS STRING))
  WHEN o_orderkey % 20 = 1 THEN concat('192.168.1.', CAST(o_custkey % 256 AS STRING))
  WHEN o_orderkey % 20 = 2 THEN concat('172.', CAST(o_custkey % 40 AS STRING), '.0.1') WHEN o_orderkey % 20 = 3 THEN 'fe80::1'
  ELSE concat(CAST(o_orderkey % 250 AS STRING), '.', CAST(o_custkey % 256 AS STRING), '.3.4') END"""
_DOMAIN_EXPR = """CASE p_partkey % 9 WHEN 0 THEN 'mail.Google.com' WHEN 1 THEN concat(replace(p_name, ' ', '-'), '-login.XYZ.')
  WHEN 2 THEN concat('citi.', replace(p_name, ' ', '-'), '-a-b.com') WHEN 3 THEN 'localhost' WHEN 4 THEN concat('c2.', replace(lower(p_brand), '#', ''), '.top')
  WHEN 5 THEN concat('bank..', replace(p_name, ' ', '.'), '.ml') WHEN 6 THEN concat(' www.', replace(p_name, ' ', ''), '.org ') ELSE concat(replace(p_name, ' ', '.'), '.net') END"""

_s, _f = heur_ip_sql("ip")


@query("h1_ip_heuristic", f"SELECT o_orderkey, ip, {_s} AS score, {_f} AS flags FROM (SELECT o_orderkey, {_IP_EXPR} AS ip FROM orders)")
def _(t):
    ips = t.table("orders").selectExpr("o_orderkey", f"{_IP_EXPR} AS ip").withColumn("h", H.score_ip("ip"))
    return ips.select("o_orderkey", "ip", "h.score", F.array_join("h.flags", "|").alias("flags"))


_s, _f = heur_domain_sql("d")


@query("h2_domain_heuristic", f"SELECT p_partkey, {_s} AS score, {_f} AS flags FROM (SELECT p_partkey, {_DOMAIN_EXPR} AS d FROM part)")
def _(t):
    d = t.table("part").selectExpr("p_partkey", f"{_DOMAIN_EXPR} AS d").withColumn("h", H.score_domain("d"))
    return d.select("p_partkey", "h.score", F.array_join("h.flags", "|").alias("flags"))


@query("h3_url_heuristic", f"SELECT p_partkey, {_s} AS score, {_f} AS flags FROM (SELECT p_partkey, lower(trim({_DOMAIN_EXPR})) AS d FROM part)")
def _(t):
    u = t.table("part").selectExpr("p_partkey", f"concat('https://u@', trim({_DOMAIN_EXPR}), ':80/p?q=1') AS u").withColumn("h", H.score_url("u"))
    return u.select("p_partkey", "h.score", F.array_join("h.flags", "|").alias("flags"))


_hi, _hd, _hu = heur_ip_sql("value")[0], heur_domain_sql("value")[0], heur_domain_sql("regexp_extract(value, '://([^/:]*)', 1)")[0]
_HEUR = f"CASE type WHEN 'Ip' THEN {_hi} WHEN 'Domain' THEN {_hd} WHEN 'Url' THEN {_hu} ELSE 0.0::DOUBLE END"


@query("h4_heuristic_by_type", f"WITH {INTEL_CTE} SELECT type, value, {_HEUR} AS score FROM known")
def _(t):
    known = t.table("part").selectExpr("p_partkey AS x").selectExpr(f"{_X_TYPE} AS type", f"{_X_VALUE} AS value")
    return known.withColumn("h", H.heuristic("type", "value")).select("type", "value", "h.score")


@query("s11_lookup_path", f"""WITH {INTEL_CTE}, u AS (SELECT type, value FROM known UNION ALL SELECT 'Url', url FROM pages)
  SELECT type, value, CASE type WHEN 'Ip' THEN concat('ip_addresses/', value) WHEN 'Domain' THEN concat('domains/', value)
   WHEN 'Hash' THEN concat('files/', value)
   WHEN 'Url' THEN concat('urls/', translate(rtrim(to_base64(encode(value)), '='), '+/', '-_')) END AS path FROM u""")
def _(t):
    known = t.table("part").selectExpr("p_partkey AS x").selectExpr(f"{_X_TYPE} AS type", f"{_X_VALUE} AS value")
    urls = t.table("pages").select(F.lit("Url").alias("type"), F.col("url").alias("value"))
    return known.unionByName(urls).withColumn("path", N.vt_lookup_path("type", "value"))


# --- feed answers --------------------------------------------------------------------------------------

_FEED = """event_id, k, CASE WHEN event_id % 2 = 0 THEN 'VirusTotal' ELSE 'AbuseIpDb' END AS source,
  CASE WHEN event_id % 17 = 5 THEN 'Domain' ELSE 'Ip' END AS type, concat('10.9.0.', CAST(k AS STRING)) AS value,
  CASE event_id % 11 WHEN 0 THEN 404 WHEN 1 THEN 400 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN NULL ELSE 200 END AS http_status,
  CASE event_id % 13 WHEN 0 THEN 'oops' WHEN 1 THEN '{"data":{}}'
    WHEN 2 THEN '{"data":{"attributes":{"last_analysis_stats":{"malicious":0,"harmless":0}},"abuseConfidenceScore":"high"}}'
    ELSE concat('{"data":{"attributes":{"last_analysis_stats":{"malicious":', CAST(k % 7 AS STRING), ',"harmless":', CAST(k AS STRING),
      ',"note":"n/a"}},"abuseConfidenceScore":', CAST(k * 2 AS STRING), '}}') END AS body,
  ts AS fetched_at"""


def feed(t: Lens) -> DataFrame:
    from .lens import _split_top
    return t.logs.selectExpr(*_split_top(_FEED))


_BASE_EVENTS = "(SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events)"
_VT = """CASE WHEN http_status IS NULL THEN 'timeout' WHEN http_status IN (400, 404) THEN NULL WHEN http_status <> 200 THEN concat('http_', http_status)
  WHEN event_id % 13 = 0 THEN 'malformed_response' WHEN event_id % 13 = 1 THEN 'missing_last_analysis_stats' END"""
_AB = """CASE WHEN type <> 'Ip' THEN 'unsupported_ioc_type:Domain' WHEN http_status IS NULL THEN 'timeout' WHEN http_status <> 200 THEN concat('http_', http_status)
  WHEN event_id % 13 = 0 THEN 'malformed_response' WHEN event_id % 13 IN (1, 2) THEN 'missing_abuse_confidence_score' END"""


@query("s9_vt_answers", f"""WITH f AS (SELECT {_FEED} FROM {_BASE_EVENTS}) SELECT event_id, {_VT} AS reason,
  CASE WHEN {_VT} IS NOT NULL THEN NULL WHEN http_status IN (400, 404) OR event_id % 13 = 2 OR k + k % 7 = 0 THEN 0.0::DOUBLE
    ELSE (k % 7)::DOUBLE / (k + k % 7) END AS score FROM f WHERE source = 'VirusTotal'""")
def _(t):
    parsed = feed(t).filter("source = 'VirusTotal'")
    from ..sources.intel_feed import feed_outcome
    return parsed.withColumn("o", feed_outcome()).select("event_id", "o.reason", "o.score")


@query("s10_abuse_answers", f"""WITH f AS (SELECT {_FEED} FROM {_BASE_EVENTS}) SELECT event_id, {_AB} AS reason,
  CASE WHEN {_AB} IS NULL THEN least(1.0::DOUBLE, (k * 2) / 100.0::DOUBLE) END AS score FROM f WHERE source = 'AbuseIpDb'""")
def _(t):
    from ..sources.intel_feed import feed_outcome
    return feed(t).filter("source = 'AbuseIpDb'").withColumn("o", feed_outcome()).select("event_id", "o.reason", "o.score")


# --- indicators ----------------------------------------------------------------------------------------

_CAND = f"""{_REPORT}, c0 AS (SELECT artifact_id AS job_id, list_concat(
    list_transform(urls, lambda v: {{'type': 'Url', 'value': v}}), list_transform(domains, lambda v: {{'type': 'Domain', 'value': v}}),
    list_transform(ips, lambda v: {{'type': 'Ip', 'value': v}}), list_transform(header_ips, lambda v: {{'type': 'Ip', 'value': v}}),
    CASE WHEN sender IS NULL THEN [] ELSE [{{'type': 'Email', 'value': sender}}] END) AS l FROM s),
  cand AS (SELECT job_id, CAST(pos AS INT) AS pos, l[pos + 1].type AS type, l[pos + 1].value AS value
    FROM (SELECT job_id, l, unnest(range(len(l))) AS pos FROM c0))"""
_FIRST = "first_seen AS (SELECT job_id, type, arg_min(value, pos) AS value, min(pos) AS pos FROM cand GROUP BY job_id, type, lower(value))"


def mail_candidates(t: Lens) -> DataFrame:
    return iocs.extracted_candidates(email_reports(t.messages))


@query("j1_ioc_candidates", f"{_CAND} SELECT * FROM cand")
def _(t):
    return mail_candidates(t)


@query("j2_first_spelling", f"{_CAND}, {_FIRST} SELECT * FROM first_seen")
def _(t):
    return iocs.first_spelling(mail_candidates(t))


@query("j3_seed_new_iocs", f"""{_CAND}, {_FIRST} SELECT job_id, type, value, 'Rule' AS extracted_by FROM first_seen
  WHERE NOT (type = 'Domain' AND CAST(job_id AS BIGINT) % 3 = 0)""")
def _(t):
    cands = mail_candidates(t)
    existing = cands.filter((F.col("type") == "Domain") & (F.col("job_id").cast("bigint") % 3 == 0)).withColumn("value", F.upper("value"))
    return iocs.seed(cands, existing).drop("pos")


_MODEL = """model AS (SELECT job_id, 'Url' AS type, upper(value) AS value, pos FROM cand WHERE type = 'Url'
  UNION ALL SELECT DISTINCT job_id, 'Domain', concat('model-', job_id, '.example'), 1000 FROM cand)"""


@query("j4_merge_model_iocs", f"""{_CAND}, {_FIRST}, {_MODEL}, u AS (SELECT *, 0 AS prio FROM first_seen UNION ALL BY NAME SELECT *, 1 AS prio FROM model)
  SELECT job_id, type, arg_min(value, prio * 1000000 + pos) AS value, CASE WHEN min(prio) = 0 THEN 'Rule' ELSE 'Llm' END AS extracted_by
  FROM u GROUP BY job_id, type, lower(value)""")
def _(t):
    cands = mail_candidates(t)
    model = cands.filter("type = 'Url'").withColumn("value", F.upper("value")).unionByName(
        cands.select("job_id").distinct().select(
            "job_id", F.lit(1000).alias("pos"), F.lit("Domain").alias("type"), F.concat(F.lit("model-"), "job_id", F.lit(".example")).alias("value"))
    )
    return iocs.merge_model_iocs(iocs.first_spelling(cands), model).drop("pos")


@query("j5_applicable_sources", f"""WITH {ITEM_CTE} SELECT job_id, type, value, source FROM items
  JOIN (VALUES ('Ip', 'VirusTotal'), ('Ip', 'AbuseIpDb'), ('Domain', 'VirusTotal'), ('Url', 'VirusTotal'), ('Hash', 'VirusTotal')) s(type, source) USING (type)""")
def _(t):
    return intel.with_sources(item_iocs(t).drop("pos"))


_LOOK = """asks AS (SELECT event_id, 'Ip' AS type, source_ip AS value, 'VirusTotal' AS source, ts AS at FROM logs WHERE event_type = 'click'),
  cache AS (SELECT 'Ip' AS type, source_ip AS value, 'VirusTotal' AS source, k / 100.0::DOUBLE AS malicious_score, event_id % 2 = 0 AS from_live_api, ts AS looked_up_at
    FROM logs WHERE event_type IN ('view', 'signup'))"""


def cache(t: Lens) -> DataFrame:
    return t.logs.filter(F.col("event_type").isin("view", "signup")).select(
        F.lit("Ip").alias("type"), F.col("source_ip").alias("value"), F.lit("VirusTotal").alias("source"),
        F.concat(F.lit("cached "), F.col("event_id").cast("string")).alias("raw_response"),
        (F.col("k") / 100.0).alias("malicious_score"), (F.col("event_id") % 2 == 0).alias("from_live_api"),
        F.col("ts").alias("looked_up_at"),
    )


@query("j6_cache_as_of", f"""WITH {LOG_CTE}, {_LOOK} SELECT event_id, arg_max(c.malicious_score, c.looked_up_at) AS malicious_score,
    CAST(arg_max(c.from_live_api, c.looked_up_at) AS INT) AS from_live_api
  FROM asks a LEFT JOIN cache c ON a.value = c.value AND c.looked_up_at <= a.at AND c.looked_up_at > a.at - INTERVAL 24 HOUR GROUP BY event_id""")
def _(t):
    asks = t.logs.filter("event_type = 'click'").select(
        "event_id", F.lit("Ip").alias("type"), F.col("source_ip").alias("value"), F.lit("VirusTotal").alias("source"), F.col("ts").alias("at"))
    found = intel.cached_as_of(asks, cache(t))
    return found.select("event_id", "malicious_score", F.col("from_live_api").cast("int").alias("from_live_api"))


_AT = "TIMESTAMP '2024-01-16 00:00:00'"


@query("j6_cache_now", f"""WITH {LOG_CTE}, {_LOOK} SELECT value, arg_max(malicious_score, looked_up_at) AS malicious_score FROM cache
  WHERE looked_up_at > {_AT} - INTERVAL 24 HOUR AND looked_up_at <= {_AT} GROUP BY value""")
def _(t):
    at = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return intel.cached_at(cache(t), at).select("value", "malicious_score")


@query("j7_enrich", f"""WITH {LOG_CTE}, {_LOOK}, keys AS (SELECT DISTINCT 'Ip' AS type, source_ip AS value FROM logs
    UNION SELECT 'Domain', lower(regexp_extract(url, '://([^/:?#]*)', 1)) FROM pages UNION SELECT 'Url', url FROM pages),
  ks AS (SELECT type, value, unnest(CASE WHEN type = 'Ip' THEN ['VirusTotal', 'AbuseIpDb'] ELSE ['VirusTotal'] END) AS source FROM keys),
  hit AS (SELECT value, arg_max(malicious_score, looked_up_at) AS score, arg_max(from_live_api, looked_up_at) AS live FROM cache
    WHERE looked_up_at > {_AT} - INTERVAL 24 HOUR AND looked_up_at <= {_AT} GROUP BY value),
  fd AS (SELECT source, source_ip AS value, arg_max({{'ok': http_status = 200, 'score': least(1.0::DOUBLE, (k * 2) / 100.0::DOUBLE), 's': http_status}}, ts) AS a
    FROM (SELECT *, 'AbuseIpDb' AS source, CASE WHEN event_id % 3 = 0 THEN 429 ELSE 200 END AS http_status FROM logs WHERE event_type = 'error') GROUP BY ALL)
  SELECT ks.type, ks.value, ks.source, CASE WHEN hit.value IS NOT NULL THEN hit.score WHEN fd.a.ok THEN fd.a.score ELSE {_HEUR.replace('value', 'ks.value').replace('CASE type', 'CASE ks.type')} END AS malicious_score,
    CAST(CASE WHEN hit.value IS NOT NULL THEN hit.live ELSE coalesce(fd.a.ok, false) END AS INT) AS from_live_api,
    CAST((hit.value IS NOT NULL) AS INT) AS cached,
    CASE WHEN hit.value IS NOT NULL OR coalesce(fd.a.ok, false) THEN NULL WHEN fd.a IS NOT NULL THEN 'http_429' ELSE 'missing_api_key' END AS reason
  FROM ks LEFT JOIN hit ON ks.value = hit.value AND ks.type = 'Ip' AND ks.source = 'VirusTotal'
    LEFT JOIN fd ON ks.value = fd.value AND ks.source = fd.source AND ks.type = 'Ip'""")
def _(t):
    p = t.table("pages")
    found = (
        t.logs.select(F.lit("Ip").alias("type"), F.col("source_ip").alias("value"))
        .unionByName(p.select(F.lit("Domain").alias("type"), N.url_host("url").alias("value")))
        .unionByName(p.select(F.lit("Url").alias("type"), F.col("url").alias("value")))
    )
    answers = t.logs.filter("event_type = 'error'").select(
        F.lit("AbuseIpDb").alias("source"), F.lit("Ip").alias("type"), F.col("source_ip").alias("value"),
        F.when(F.col("event_id") % 3 == 0, 429).otherwise(200).alias("http_status"),
        F.concat(F.lit('{"data":{"abuseConfidenceScore":'), (F.col("k") * 2).cast("string"), F.lit("}}")).alias("body"),
        F.col("ts").alias("fetched_at"),
    )
    at = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    e = intel.enrich(found, cache(t), answers, at)
    fallback = F.get_json_object("raw_response", "$.reason")
    return e.select("type", "value", "source", "malicious_score", F.col("from_live_api").cast("int").alias("from_live_api"),
                    F.col("cached").cast("int").alias("cached"), fallback.alias("reason"))


@query("j8_lookup_keys", f"""WITH {ITEM_CTE} SELECT DISTINCT type, value, source FROM items
  JOIN (VALUES ('Ip', 'VirusTotal'), ('Ip', 'AbuseIpDb'), ('Domain', 'VirusTotal'), ('Url', 'VirusTotal'), ('Hash', 'VirusTotal')) s(type, source) USING (type)""")
def _(t):
    return intel.lookup_keys(item_iocs(t))


# --- correlation ---------------------------------------------------------------------------------------

_CUST = "custs AS (SELECT CAST(c_custkey AS STRING) AS job_id, concat('10.0.0.', CAST(c_custkey % 110 AS STRING)) AS ip FROM customer UNION ALL SELECT CAST(c_custkey AS STRING), concat('203.0.113.', CAST(70 + c_custkey % 15 AS STRING)) FROM customer)"


@query("j9_activity_top20", f"""WITH {LOG_CTE}, {_CUST}, r AS (SELECT job_id, event_id, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id) AS rn
    FROM custs JOIN logs ON source_ip = ip) SELECT job_id, event_id, CAST(rn AS INT) AS rn FROM r WHERE rn <= 20""")
def _(t):
    c = F.col("c_custkey")
    ips = lambda col: t.table("customer").select(c.cast("string").alias("job_id"), F.lit("Ip").alias("type"), col.alias("value"))
    found = ips(F.concat(F.lit("10.0.0."), (c % 110).cast("string"))).unionByName(ips(F.concat(F.lit("203.0.113."), (70 + c % 15).cast("string"))))
    logs = t.logs.select(F.col("ts").alias("event_time"), "event_id", "source_ip")
    return correlate.correlate_activity(found, logs, tie_break="event_id").select("job_id", "event_id", "rn")


_SEEDED = "iocs AS (SELECT job_id, type, arg_min(value, pos) AS value, min(pos) AS pos FROM items GROUP BY job_id, type, lower(value))"
_ACTS = f"""acts AS (SELECT ts, event_id, event_name, user_name, {_ACT_IP} AS source_ip FROM logs),
  near AS (SELECT * FROM (SELECT job_id, acts.*, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id) AS rn
    FROM (SELECT DISTINCT job_id, value FROM iocs WHERE type = 'Ip') i JOIN acts ON acts.source_ip = i.value) WHERE rn <= 20)"""
EVIDENCE_CTE = f"""{LOG_CTE}, {ITEM_CTE}, {INTEL_CTE}, {TIER1_CTE}, {_SEEDED}, {_ACTS},
  joined AS (SELECT job_id, pos, i.type, i.value, source, score, live FROM iocs i LEFT JOIN intel USING (type, value)),
  per_job AS (SELECT job_id, count(DISTINCT (type, value)) AS n_iocs, count(source) AS n_intel, max(score) AS max_intel,
    bool_or(type = 'Url') AS has_url FROM joined GROUP BY job_id),
  per_act AS (SELECT job_id, count(*) AS n_activity FROM (SELECT DISTINCT job_id, value FROM iocs WHERE type = 'Ip') i JOIN acts ON acts.source_ip = i.value GROUP BY job_id)"""


def bundles(t: Lens) -> DataFrame:
    """Evidence of the suspicious jobs, equal intel rows as one entry."""
    empty = t.spark.createDataFrame([], "job_id string, type string, value string")
    found = iocs.seed(item_iocs(t), empty)
    near = correlate.correlate_activity(found, item_activity(t), tie_break="event_id")
    totals = correlate.activity_totals(found, item_activity(t))
    return correlate.evidence_bundles(suspicious_jobs(t), tier1_rows(t), found, part_intel(t), near, totals=totals, runs=True)


@query("j10_evidence_bundles", f"""WITH {EVIDENCE_CTE} SELECT tier1.job_id, file_type AS artifact_type, verdict AS tier1_verdict, risk_score AS rule_score,
    CAST(len(matched_rules) AS INT) AS n_rules, CAST(coalesce(n_iocs, 0) AS INT) AS n_iocs, CAST(coalesce(n_intel, 0) AS INT) AS n_intel,
    max_intel, CAST(coalesce(n_activity, 0) AS INT) AS n_activity, CAST(0 AS INT) AS n_similar
  FROM tier1 LEFT JOIN per_job USING (job_id) LEFT JOIN per_act USING (job_id)""")
def _(t):
    from ..operators.report import intel_rows, max_intel
    return bundles(t).select(
        "job_id", "artifact_type", "tier1_verdict", "rule_score", F.size("matched_rules").alias("n_rules"), F.size("iocs").alias("n_iocs"),
        intel_rows(F.col("iocs"), runs=True).alias("n_intel"),
        max_intel(F.col("iocs")).alias("max_intel"), F.col("activity_total").cast("int").alias("n_activity"), F.size("similar").alias("n_similar"),
    )


@query("s7_activity_scan", f"""WITH {LOG_CTE} SELECT event_id, source_ip FROM logs WHERE source_ip = '10.0.0.7' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-21'""")
def _(t):
    """The activity table is written partitioned by day; the scan reads the wanted days only."""
    path = scratch_path(t.spark, "activity")
    activity_table.write_activity(
        t.logs.select(F.col("ts").alias("event_time"), "event_id", "event_name", "source_ip", F.col("user_name").alias("user_identity")), path)
    days = activity_table.read_activity(t.spark, path, "2024-01-10", "2024-01-20")
    return days.filter(F.col("source_ip") == "10.0.0.7").select("event_id", "source_ip")


@query("s12_result_sink", f"WITH {ITEM_CTE}, {_SEEDED} SELECT type, count(*) AS n FROM iocs GROUP BY type")
def _(t):
    """A batch written twice leaves one copy of its rows."""
    root = scratch_path(t.spark, "sink")
    found = iocs.seed(item_iocs(t), t.spark.createDataFrame([], "job_id string, type string, value string"))
    even = F.length("job_id") % 2 == 0
    for batch_id, part in [(0, found.filter(even)), (1, found.filter(~even)), (0, found.filter(even))]:
        sinks.write_batch(part, root, "iocs", batch_id)
    stored = sinks.read_table(t.spark, root, "iocs", "job_id string, type string, value string, extracted_by string, pos int")
    return stored.groupBy("type").agg(F.count("*").alias("n"))


__all__ = ["EVIDENCE_CTE", "bundles", "parse_feed"]
