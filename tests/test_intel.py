import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from alertloom.functions import heuristics as H
from alertloom.operators import correlate, intel, iocs
from alertloom.schemas import INTEL, INTEL_FEED
from alertloom.sources.intel_feed import parse_feed

T0 = dt.datetime(2026, 3, 1, 12)


@pytest.mark.parametrize("kind, value, score, flags", [
    ("Ip", "192.168.1.1", 0, ["internal_ip"]), ("Ip", "10.0.0.5", 0, ["internal_ip"]), ("Ip", "172.16.8.4", 0, ["internal_ip"]),
    ("Ip", "127.0.0.1", 0, ["internal_ip"]), ("Ip", "185.220.101.1", 0.55, ["known_tor_exit_prefix", "high_risk_geo_range"]),
    ("Ip", "8.8.8.8", 0, []), ("Ip", "172.32.0.1", 0, []), ("Ip", "41.1.1.1", 0.15, ["high_risk_geo_range"]), ("Ip", "180::1", 0, []),
    ("Domain", "mail.google.com", 0, ["whitelisted_domain"]), ("Domain", "random-name.xyz", 0.25, ["high_risk_tld:.xyz"]),
    ("Domain", "paypal-secure.xyz", 0.55, ["high_risk_tld:.xyz", "brand_impersonation_pattern"]),
    ("Domain", "account-verify-portal.com", 0.15, ["multi_hyphen_domain"]), ("Domain", " GitHub.COM. ", 0, ["whitelisted_domain"]),
    ("Domain", "", 0, []), ("Domain", "localhost", 0, []), ("Url", "http://evil.xyz/login?u=1", 0.25, ["high_risk_tld:.xyz"]),
    ("Hash", "d41d8cd98f00b204e9800998ecf8427e", 0, []), ("Email", "a@paypal.xyz", 0, []),
])
def test_heuristics(one, kind, value, score, flags):
    out = one(H.heuristic, kind, value)
    assert out["score"] == pytest.approx(score) and out["flags"] == flags


def vt(**stats):
    return json.dumps({"data": {"attributes": {"last_analysis_stats": stats}}})


@pytest.mark.parametrize("source, kind, status, body, want", [
    ("VirusTotal", "Domain", 200, vt(malicious=3, harmless=9), (True, 0.25, None)),
    ("VirusTotal", "Domain", 200, vt(malicious=0, harmless=0), (True, 0.0, None)),
    ("VirusTotal", "Domain", 200, vt(malicious="x", harmless=2), (True, 0.0, None)),
    ("VirusTotal", "Domain", 404, "whatever", (True, 0.0, None)), ("VirusTotal", "Domain", 400, None, (True, 0.0, None)),
    ("VirusTotal", "Domain", 429, "{}", (False, None, "http_429")),
    ("VirusTotal", "Domain", 200, '{"data":{}}', (False, None, "missing_last_analysis_stats")),
    ("VirusTotal", "Domain", 200, "{oops", (False, None, "malformed_response")),
    ("VirusTotal", "Domain", None, None, (False, None, "timeout")),
    ("AbuseIpDb", "Ip", 200, '{"data":{"abuseConfidenceScore":85}}', (True, 0.85, None)),
    ("AbuseIpDb", "Ip", 200, '{"data":{"abuseConfidenceScore":185}}', (True, 1.0, None)),
    ("AbuseIpDb", "Ip", 200, '{"data":{"abuseConfidenceScore":"85"}}', (False, None, "missing_abuse_confidence_score")),
    ("AbuseIpDb", "Ip", 404, "", (False, None, "http_404")), ("AbuseIpDb", "Ip", 200, "", (False, None, "malformed_response")),
    ("AbuseIpDb", "Domain", 200, "{}", (False, None, "unsupported_ioc_type:Domain")),
])
def test_feed_answers(spark, source, kind, status, body, want):
    r = parse_feed(spark.createDataFrame([(source, kind, "v", status, body, T0)], INTEL_FEED)).first()
    assert (r.success, r.score, r.reason) == want


def test_known_answer_keeps_a_note(spark):
    r = parse_feed(spark.createDataFrame([("VirusTotal", "Url", "http://x", 404, "", T0)], INTEL_FEED)).first()
    assert json.loads(r.raw) == {"source": "VirusTotal", "ioc": "http://x", "note": "not_found_in_virustotal", "http_status": 404}


def ioc_frame(spark, rows):
    return spark.createDataFrame(rows, "job_id string, type string, value string")


def enrich(spark, found, cache=(), feed=()):
    at = F.lit(T0).cast("timestamp")
    rows = intel.enrich(ioc_frame(spark, found), spark.createDataFrame(list(cache), INTEL), spark.createDataFrame(list(feed), INTEL_FEED), at)
    return {(r.type, r.value, r.source): r for r in rows.collect()}


def test_one_row_serves_many_jobs(spark):
    out = enrich(spark, [("1", "Ip", "8.8.8.8"), ("2", "Ip", "8.8.8.8"), ("2", "Email", "a@b.c")])
    assert set(out) == {("Ip", "8.8.8.8", "VirusTotal"), ("Ip", "8.8.8.8", "AbuseIpDb")}


def test_fresh_cache_row_is_reused_as_it_is(spark):
    fresh, stale = T0 - dt.timedelta(hours=1), T0 - dt.timedelta(hours=48)
    cache = [("Domain", "a.com", "VirusTotal", "older", 0.1, False, T0 - dt.timedelta(hours=2)),
             ("Domain", "a.com", "VirusTotal", "cached", 0.9, False, fresh), ("Domain", "b.com", "VirusTotal", "old", 0.9, True, stale),
             ("Domain", "c.com", "VirusTotal", "edge", 0.9, True, T0 - dt.timedelta(hours=24))]
    feed = [("VirusTotal", "Domain", v, 200, vt(malicious=1, harmless=1), T0) for v in ("a.com", "b.com", "c.com")]
    out = enrich(spark, [("1", "Domain", v) for v in ("a.com", "b.com", "c.com")], cache, feed)
    a, b, c = (out[("Domain", v, "VirusTotal")] for v in ("a.com", "b.com", "c.com"))
    assert (a.raw_response, a.from_live_api, a.looked_up_at, a.cached) == ("cached", False, fresh, True)
    assert (b.malicious_score, b.from_live_api, b.cached) == (0.5, True, False)
    assert (c.malicious_score, c.cached) == (0.5, False)


def test_fallback_explains_itself(spark):
    r = enrich(spark, [("1", "Domain", "paypal-secure.xyz")], feed=[("VirusTotal", "Domain", "paypal-secure.xyz", 503, "", T0)])
    row = r[("Domain", "paypal-secure.xyz", "VirusTotal")]
    assert row.malicious_score == pytest.approx(0.55) and not row.from_live_api
    raw = json.loads(row.raw_response)
    assert (raw["fallback"], raw["source"], raw["ioc"], raw["reason"]) == (True, "VirusTotal", "paypal-secure.xyz", "http_503")
    assert raw["flags"] == ["high_risk_tld:.xyz", "brand_impersonation_pattern"]


def test_as_of_against_brute_force(spark):
    """A hot key, ties, gaps longer than the limit, and lookups before any row."""
    rng = random.Random(3)
    at = lambda: T0 + dt.timedelta(seconds=rng.randrange(0, 5 * 86400, 600))
    key = lambda: "hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}"
    seen, cache = set(), []
    for i in range(400):
        k, t = key(), at()
        if (k, t) not in seen:
            seen.add((k, t))
            cache.append(("Ip", k, "VirusTotal", f"r{i}", i / 400, i % 2 == 0, t))
    asks = [(i, "Ip", key(), "VirusTotal", at()) for i in range(500)]
    lookups = spark.createDataFrame(asks, "ask_id int, type string, value string, source string, at timestamp")
    for hours, minutes in [(24, 60), (24, 7), (2, 60)]:
        got = {r.ask_id: r.raw_response for r in intel.cached_as_of(lookups, spark.createDataFrame(cache, INTEL), hours, minutes).collect()}
        for ask_id, _, value, _, t in asks:
            valid = [(c[6], c[3]) for c in cache if c[1] == value and t - dt.timedelta(hours=hours) < c[6] <= t]
            assert got[ask_id] == (max(valid)[1] if valid else None)
        assert len(got) == len(asks)


def test_candidates_and_idempotent_seeding(spark):
    js = json.dumps({"urls": ["http://A.example", " ", 7], "domains": ["A.example", "a.EXAMPLE"], "ips": ["1.1.1.1"], "headerIps": ["1.1.1.1"], "sender": "x@y.z"})
    cands = iocs.candidates_from_json(spark.createDataFrame([("j", js), ("k", "{bad")], "job_id string, extracted string"), "extracted")
    none = ioc_frame(spark, [])
    first = iocs.seed(cands, none)
    assert sorted((r.type, r.value) for r in first.collect()) == [("Domain", "A.example"), ("Email", "x@y.z"), ("Ip", "1.1.1.1"), ("Url", "http://A.example")]
    assert iocs.seed(cands, first).count() == 0
    model = spark.createDataFrame([("j", 0, "Url", "HTTP://a.example"), ("j", 1, "Hash", "abc")], "job_id string, pos int, type string, value string")
    merged = {(r.type, r.value): r.extracted_by for r in iocs.merge_model_iocs(first, model).collect()}
    assert merged[("Hash", "abc")] == "Llm" and merged[("Url", "http://A.example")] == "Rule" and len(merged) == 5


def test_correlation_with_a_hot_address(spark):
    log = spark.range(5000).select(
        (F.lit(T0).cast("timestamp") + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).alias("event_time"),
        F.col("id").alias("event_id"), F.when(F.col("id") % 3 != 1, "hot").otherwise(F.concat(F.lit("ip"), (F.col("id") % 50).cast("string"))).alias("source_ip"),
    )
    found = ioc_frame(spark, [(f"j{i}", "Ip", "hot") for i in range(40)] + [("j0", "Ip", "ip1"), ("j1", "Domain", "hot"), ("z", "Ip", "none")])
    got = {}
    for r in correlate.correlate_activity(found, log, 20, tie_break="event_id").collect():
        got.setdefault(r.job_id, []).append((r.rn, r.event_id))
    rows = [(r.event_id, r.source_ip) for r in log.collect()]
    for job in [f"j{i}" for i in range(40)]:
        ips = {"hot", "ip1"} if job == "j0" else {"hot"}
        want = sorted((e for e, ip in rows if ip in ips), reverse=True)[:20]
        assert [e for _, e in sorted(got[job])] == want
    assert "z" not in got


def test_every_intel_row_of_a_value_counts(spark):
    found = spark.createDataFrame([("j", "Ip", "1.1.1.1", "Rule", 0)], "job_id string, type string, value string, extracted_by string, pos int")
    rows = [("Ip", "1.1.1.1", "VirusTotal", 0.25, False)] * 2 + [("Ip", "1.1.1.1", "AbuseIpDb", s, True) for s in (0.3, 0.1)]
    known = spark.createDataFrame(rows, "type string, value string, source string, malicious_score double, from_live_api boolean")
    nested = correlate.intel_of_iocs(found, known).first().intel
    assert [(r.source, r.malicious_score) for r in nested] == [("AbuseIpDb", 0.1), ("AbuseIpDb", 0.3), ("VirusTotal", 0.25), ("VirusTotal", 0.25)]


def test_equal_answers_travel_once_and_are_all_reported(spark):
    from alertloom.operators import report

    found = spark.createDataFrame([("j", "Ip", "1.1.1.1", "Rule", 0), ("j", "Hash", "ab", "Rule", 1)], "job_id string, type string, value string, extracted_by string, pos int")
    rows = [("Ip", "1.1.1.1", "VirusTotal", 0.255, True)] * 500 + [("Ip", "1.1.1.1", "AbuseIpDb", s, live) for s in (0.3, 0.1) for live in (True, False)] * 3
    known = spark.createDataFrame(rows, "type string, value string, source string, malicious_score double, from_live_api boolean")
    jobs = spark.createDataFrame([("j", "f", "Csv")], "id string, file_name string, file_type string")
    tier1 = spark.createDataFrame([("j", "Suspicious", 40, ["access_denied:x"], None)], "job_id string, verdict string, risk_score int, matched_rules array<string>, ml_score double")
    log = spark.createDataFrame([], "job_id string, rn int, event_time timestamp, event_name string, source_ip string, user_identity string, aws_region string")
    both = [correlate.evidence_bundles(jobs, tier1, found, known, log, runs=runs) for runs in (False, True)]
    assert [len(b.first().iocs[0].intel) for b in both] == [512, 5]
    assert both[1].select(report.intel_rows(F.col("iocs"), runs=True)).first()[0] == 512
    every, once = ([r.asDict(True) for r in report.deterministic_reports(b, F.lit(None)).collect()] for b in both)
    assert every == once and len(once[0]["evidence"]) == 514 and once[0]["summary"].count("VirusTotal score") == 500
