import math
import random

from pyspark.sql import functions as F

from alertloom.operators import log_checks as L
from alertloom.sources.rule_pack import load_rules

COLUMNS = ["artifact_id", "line_no", "event_time", "event_name", "source_ip", "user_name", "error_code", "error_message", "user_agent"]


def events(spark, rows, artifact="a"):
    """rows: (event, ip, user[, error code[, error message]])."""
    data = []
    for i, r in enumerate(rows):
        event, ip, user, code, message = (*r, "", "")[:5]
        fields = {"eventname": event, "errorcode": code, "eventsource": "sts.amazonaws.com" if event.startswith("Assume") else "x"}
        data.append((artifact, i, "t", event, ip, user, code, message, "ua", fields))
    schema = ", ".join(f"{c} {'bigint' if c == 'line_no' else 'string'}" for c in COLUMNS) + ", fields map<string,string>"
    return spark.createDataFrame(data, schema)


def report(spark, rows, pack=None, **kw):
    ids = spark.createDataFrame([("a",)], "artifact_id string")
    return L.log_reports(ids, events(spark, rows), pack, **kw).first()


def many(n_users, n, heavy=None):
    rows = [("GetObject", f"10.0.0.{u}", f"user{u:02d}") for u in range(1, n_users + 1) for _ in range(n)]
    return rows + [("GetObject", "10.9.9.9", "heavy")] * (heavy or 0)


def test_empty_artifact(spark):
    r = report(spark, [])
    assert (r.verdict, r.risk_score, r.matched_rules, r.extracted.record_count) == ("Benign", 0, [], 0)
    assert [(c.name, c.result) for c in r.checks] == [("parse", "info")]


def test_high_risk_keeps_first_spelling_and_order(spark):
    r = report(spark, [("stoplogging", "", ""), ("AssumeRole", "", ""), ("StopLogging", "", "")])
    assert r.matched_rules == ["high_risk_api:stoplogging", "high_risk_api:AssumeRole"]
    assert r.risk_score == 15


def test_access_denied(spark):
    r = report(spark, [("B", "", "", "Client.ACCESSDENIED", ""), ("A", "", "", "", "access denied"), ("C", "", "", "", "Access Denied!"), ("b", "", "", "AccessDenied")])
    assert r.matched_rules == ["access_denied:B", "access_denied:A"]


def test_recon_burst(spark):
    calls = ["ListBuckets", "listusers", "GetAccountAuthorizationDetails"]
    assert report(spark, [(c, "", "eve") for c in calls]).matched_rules == ["recon_burst:eve:3"]
    assert report(spark, [(c, "", u) for c, u in zip(calls, "abc")]).matched_rules == []
    assert report(spark, [(c, "", "") for c in calls]).matched_rules == ["recon_burst::3"]


def test_spike_where_the_score_just_misses(spark):
    r = report(spark, many(9, 2, 20))
    assert "user_event_frequency_spike:heavy:count=20" in r.matched_rules


def test_anomaly(spark):
    r = report(spark, many(11, 2, 50))
    assert any(x.startswith("user_event_count_anomaly:heavy:z=3.3") for x in r.matched_rules)
    assert not any("spike:heavy" in x for x in r.matched_rules)


def test_even_activity_is_quiet(spark):
    assert report(spark, many(12, 3)).matched_rules == []


def test_unseen_ip(spark):
    usual = [("GetObject", "10.0.0.99", "backup")] * 2
    hit = report(spark, usual + [("AssumeRole", "203.0.113.50", "backup")])
    assert "sensitive_event_unseen_ip:AssumeRole:backup:203.0.113.50" in hit.matched_rules
    same = report(spark, usual + [("AssumeRole", "10.0.0.99", "backup")])
    assert not any(x.startswith("sensitive") for x in same.matched_rules)
    only = report(spark, [("AssumeRole", "203.0.113.50", "backup")])
    assert not any(x.startswith("sensitive") for x in only.matched_rules)


def test_full_report(spark):
    rows = [(e, f"10.0.0.{i}", f"u{i:02d}") for i in range(1, 10) for e in ("GetObject", "PutObject")]
    rows += [("ListBuckets", "10.0.0.99", "backup", "AccessDenied"), ("ListUsers", "10.0.0.99", "backup"), ("ListRoles", "10.0.0.99", "backup")]
    rows += [("GetObject", "10.0.0.99", "backup")] * 15 + [("AssumeRole", "203.0.113.50", "backup")] * 2
    r = report(spark, rows, load_rules())
    assert r.matched_rules == [
        "high_risk_api:AssumeRole", "access_denied:ListBuckets", "recon_burst:backup:3",
        "user_event_frequency_spike:backup:count=20", "ip_event_count_anomaly:10.0.0.99:z=3.16",
        "sensitive_event_unseen_ip:AssumeRole:backup:203.0.113.50", "sigma:aws_sts_assumerole_from_external_account",
    ]
    assert (r.risk_score, r.verdict) == (100, "Suspicious")
    assert report(spark, rows).risk_score == 90
    assert r.extracted.unique_ips[:2] == ["10.0.0.1", "10.0.0.2"]
    checks = {c.name: c for c in r.checks}
    assert checks["user_frequency"].detail.startswith("10 user(s), mean=3.8, std=5.40, median=2, spike floor=15. Flagged: ")
    assert checks["sigma_rules"].detail == "AWS STS AssumeRole From External Account [medium] × 2"


def test_statistics_against_plain_python(spark):
    rng = random.Random(7)
    rows = [("GetObject", f"10.0.0.{int(rng.expovariate(0.2)) % 40}", f"u{int(rng.expovariate(0.1)) % 60}") for _ in range(3000)]
    ev = events(spark, rows)
    counts = L.activity_counts(ev)
    per = L.key_counts(counts, "user_name")
    plain = {}
    for _, _, u in rows:
        plain[u] = plain.get(u, 0) + 1
    values = [plain[k] for k in sorted(plain)]
    mean = sum(values) / len(values)
    std = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    for stats in (L.frequency_stats(per), L.frequency_stats_in_key_order(per)):
        s = stats.first()
        assert (s.n_keys, s.median) == (len(values), float(sorted(values)[len(values) // 2]))
        assert math.isclose(s.mean, mean) and math.isclose(s.std, std)
        assert s.spike_floor == max(15.0, 5 * s.median)
    want = {k for k, c in plain.items() if (c - mean) / std >= 1.5 or c >= max(15, 5 * sorted(values)[len(values) // 2])}
    for ordered in (True, False):
        got = L.frequency_anomalies(counts, "user_name", "user", 1.5, ordered)
        assert {r["sub"] for r in got.collect()} == want


def test_statistics_of_counts_beyond_a_long_product(spark):
    from pyspark.sql import functions as F

    counts = L.activity_counts(events(spark, [("GetObject", "10.0.0.1", "u1"), ("GetObject", "10.0.0.1", "u2")]))
    per = L.key_counts(counts, "user_name").withColumn("c", F.lit(5_000_000_000) * F.col("c"))
    s = L.frequency_stats(per).first()
    assert s.n_keys == 2 and s.mean > 2e9


def test_row_form_and_reports_agree(spark):
    rows = many(9, 2, 20) + [("AssumeRole", "1.1.1.1", "user01"), ("ListUsers", "", "", "AccessDenied")]
    ev = events(spark, rows)
    ids = ev.select("artifact_id").distinct().unionByName(spark.createDataFrame([("empty",)], "artifact_id string"))
    rules = L.log_rules(ev, load_rules())
    got = {r.artifact_id: r for r in L.verdicts(rules, ids).collect()}
    rep = report(spark, rows, load_rules(), in_key_order=False)
    assert (got["a"].rule_count, got["a"].risk_score) == (len(rep.matched_rules), rep.risk_score)
    assert (got["empty"].rule_count, got["empty"].verdict) == (0, "Benign")
    assert sorted(r.rule for r in rules.collect()) == sorted(rep.matched_rules)


def test_median_window_reads_few_rows(spark):
    """A single artifact with very many keys: the median works on distinct counts, not on keys."""
    per = spark.range(200_000).select(F.lit("a").alias("artifact_id"), F.col("id").cast("string").alias("key"), (F.col("id") % 7 + 1).alias("c"))
    s = L.frequency_stats(per).first()
    assert (s.n_keys, s.median) == (200_000, 4.0)
