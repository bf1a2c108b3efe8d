import pytest
from pyspark.sql import functions as F

from alertloom.functions import email as E
from alertloom.functions import network as N
from alertloom.operators.email_checks import email_reports
from alertloom.sources.eml import parse_messages


def messages(spark, *raws):
    df = spark.createDataFrame([(str(i), r) for i, r in enumerate(raws)], "artifact_id string, raw string")
    return parse_messages(df)


def report(spark, raw):
    return email_reports(messages(spark, raw)).first()


def mail(subject="Hi", body="Hello", sender="a@example.org", extra=""):
    return f"From: {sender}\nSubject: {subject}\n{extra}\n{body}"


def headers(spark, raw):
    return [(h.name, h.value) for h in messages(spark, raw).first().headers]


def test_hostile_name_does_not_overflow_the_matcher(spark):
    raw = mail(body="a." * 4000 + "com and x.evil.org")
    found = messages(spark, raw).select(N.domains("body").alias("d")).first().d
    assert "x.evil.org" in found


def test_folding_and_broken_lines(spark):
    raw = "  lost fold\nA: 1\nbroken\n more\t\nB :x:y \r\n\tz\n: no name\nA: 2\n\nbody\n\nrest"
    assert headers(spark, raw) == [("A", "1 more"), ("B", "x:y z"), ("A", "2")]
    assert messages(spark, raw).first().body == "body\n\nrest"


def test_empty_first_line_of_a_folded_header(spark):
    assert headers(spark, "Subject:\n folded\n\nb") == [("Subject", " folded")]


def test_no_blank_line_means_no_body(spark):
    m = messages(spark, "8.8.8.8\n1.1.1.1").first()
    assert (m.headers, m.body) == ([], "")


def test_header_lookup_ignores_case_and_takes_the_first(spark):
    m = messages(spark, "received: a\nRECEIVED: b\n\nx")
    row = m.select(E.header("headers", "Received").alias("h"), E.header_values("headers", "Received").alias("v"),
                   E.header("headers", "none").alias("n")).first()
    assert (row.h, row.v, row.n) == ("a", ["a", "b"], None)


def test_auth_failures(spark):
    r = report(spark, mail(extra="Authentication-Results: mx; SPF=softfail; dkim=FAIL; spf=pass\n"))
    assert r.matched_rules == ["spf_fail", "dkim_fail"]
    assert [(c.name, c.result, c.detail) for c in r.checks[:3]] == [
        ("auth_spf", "fail", "spf=softfail"), ("auth_dkim", "fail", "dkim=fail"),
        ("auth_dmarc", "not_present", "No Authentication-Results entry."),
    ]


@pytest.mark.parametrize("subject, rule", [
    ("Urgent: verify your account", "urgent_action_required"),
    ("Please verify your account today", "verify_account"),
    ("Your account suspended immediately", "suspended_account"),
    ("Click here to claim your prize", "click_link"),
    ("Enter your password to continue", "credential_harvest"),
    ("Reset your password within 24 hours", "password_reset"),
    ("mother's maiden name", "personal_info_request"),
    ("requires an important update", "compliance_pressure"),
    ("login from a new device", "device_login_scare"),
    ("FINANCE   OFFICER", "impersonation_authority"),
])
def test_keyword_rules(one, subject, rule):
    assert rule in one(E.keyword_rules, subject)


def test_every_guard_lets_its_own_rule_through(spark):
    """The literals searched first must never hide a match."""
    samples = [
        "immediate action", "act now", "action required", "urgent", "confirm your identity", "change your password",
        "password expired", "account permanently", "follow this link", "log in page", "sign in to your", "login portal",
        "credit card", "payment failed", "unauthorized transaction", "wire transfer", "bank account", "you have won",
        "congratulations", "claim your refund", "social security", "ssn", "date of birth", "routing number", "see attached",
        "open the attachment", "download the file", "within 3 hours", "expires today", "final warning", "security alert",
        "unusual login", "unrecognized device", "unauthorized access", "suspicious activity", "domain credential",
        "enter password", "log in credentials", "federal reserve", "regulatory", "compliance update", "internal audit", "ceo",
        "swift transfer", "mandatory", "must be applied", "required an update", "http://1.2.3.4/x", "login from my ip",
        "secure your account", "review the logs",
    ]
    df = spark.createDataFrame([(s,) for s in samples], "t string").select(
        "t", E.keyword_rules("t").alias("fast"),
        F.array(*[F.when(F.rlike("t", F.lit("(?idU)" + p)), F.lit(n)) for n, p in E.PHISHING_RULES]).alias("plain"),
    )
    for row in df.collect():
        assert row.fast == [n for n in row.plain if n], row.t
        assert row.fast, row.t


def test_non_ascii_letters_are_part_of_words(one):
    assert one(E.keyword_rules, "éceo ceoß") == []


@pytest.mark.parametrize("domain, brand", [
    ("paypa1.com", "paypal"), ("paypal-secure.xyz", "paypal"), ("micros0ft-login.com", "microsoft"),
    ("vvellsfargo.net", "wellsfargo"), ("apple.com.evil.example", "apple"),
    ("paypal.com", None), ("mail.paypal.com", None), ("amazonaws.com", None), ("example.com", None),
])
def test_lookalike(one, domain, brand):
    assert one(E.lookalike_brand, domain) == brand


def test_suspicious_domains_count_twice(spark):
    r = report(spark, mail(sender="x@secure-banking-login.com", body="see secure-banking-login.com"))
    assert r.matched_rules == ["suspicious_domain:secure-banking-login.com"] * 2
    assert r.risk_score == 16 + 20
    assert r.verdict == "Suspicious"


def test_ip_url_fires_two_rules(spark):
    r = report(spark, mail(body="go http://10.0.0.1/a", extra="Received: from x ([1.2.3.4])\nX-Originating-IP: [1.2.3.4]\n"))
    assert r.matched_rules == ["ip_in_url_lure", "ip_in_url_detected"]
    assert r.extracted.header_ips == ["1.2.3.4"]
    assert r.risk_score == 16 + 3 + 3 + 3 + 15


def test_lure_like_the_published_sample(spark):
    body = (
        "Please verify your account immediately via\n<a href=\"http://globalsecure-bank-verify-login.com/session/review\">\n"
        "Confirm Your Account Now\n</a> or access may be restricted within <b>12 hours</b>."
    )
    r = report(spark, mail("Urgent Action Required: limits", body, '"GSB" <security-alert@globalsecure-bank-support.com>'))
    assert r.matched_rules == [
        "urgent_action_required", "verify_account", "compliance_pressure",
        "suspicious_domain:globalsecure-bank-verify-login.com", "suspicious_domain:globalsecure-bank-support.com",
    ]
    assert r.risk_score == 53


def test_clean_mail(spark):
    r = report(spark, mail("Lunch on Thursday?", "Are you free around noon?"))
    assert (r.matched_rules, r.risk_score, r.verdict) == ([], 0, "Benign")


def test_network_entities_fold_case(one):
    out = one(N.network_entities, "http://A.example/x HTTP://a.EXAMPLE/X b.org B.org 1.2.3.4 1.2.3.4 https://z.example:8/q")
    assert out == {
        "urls": ["http://A.example/x", "https://z.example:8/q"], "domains": ["a.example", "b.org", "z.example"], "ips": ["1.2.3.4"],
    }


def test_parsed_email_cuts_the_body_only_on_demand(spark):
    m = messages(spark, mail(body="x" * 2001))
    assert m.select(E.parsed_email("headers", "body").alias("p")).first().p.bodyText == "x" * 2001
    p = m.select(E.parsed_email("headers", "body", 2000).alias("p")).first().p
    assert p.bodyText == "x" * 2000 + "\n[... truncated ...]"
    assert p.metadata.messageId is None


def test_lookup_paths(spark):
    rows = [("Ip", "1.2.3.4", "ip_addresses/1.2.3.4"), ("Domain", "a b.example", "domains/a%20b.example"),
            ("Hash", "abc", "files/abc"), ("Email", "a@b.c", None),
            ("Url", "http://x/?>~" + "y" * 100, None)]
    got = spark.createDataFrame(rows, "t string, v string, w string").select(N.vt_lookup_path("t", "v").alias("p")).collect()
    assert [r.p for r in got[:4]] == [r[2] for r in rows[:4]]
    import base64
    assert got[4].p == "urls/" + base64.urlsafe_b64encode(rows[4][1].encode()).decode().rstrip("=")


def test_keyword_rules_are_found_as_the_plain_patterns_find_them(spark):
    import random

    from pyspark.sql import functions as F

    from alertloom.functions import email

    rng = random.Random(17)
    words = sorted({w for groups in email._GUARDS.values() for g in groups for w in g})
    words += "act action log sign in see open date of birth you have won to the your this here mother's logs é a".split()
    signs = [" ", "  ", "\n", "-", "", "\u00a0", "é", ". ", "s "]
    texts = ["".join(rng.choice(words) + rng.choice(signs) for _ in range(rng.randrange(1, 40))) for _ in range(2000)]
    texts += ["éurgent", "urgenté", "_act now", "act\u00a0now", "xurgent urgent", "ssn", "a\u0301urgent", "Log In to your", "HTTPS://1.2.3.4", "within 24 hours", ""]
    texts += [p[2:].replace("(", "").split("|")[0].replace(r"\s+", " ") for _, p in email.PHISHING_RULES]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = [F.rlike(F.lower("t"), F.lit("(?dU)" + p)).alias(n) for n, p in email.PHISHING_RULES]
    fast = [F.rlike(F.lower("t"), F.lit("(?dU)" + email.fast_rule(p))) for _, p in email.PHISHING_RULES]
    rows = df.select("t", F.struct(*plain).alias("want"), F.array(*fast).alias("got"), email.keyword_rules("t").alias("names")).collect()
    for r in rows:
        assert list(r.want) == r.got, r.t
        assert [n for n, hit in r.want.asDict().items() if hit] == r.names, r.t
    assert all(any(r.want[n] for r in rows) for n, _ in email.PHISHING_RULES)
    assert all(email.fast_rule(p).startswith(("(?=", "http")) for _, p in email.PHISHING_RULES)


def test_sentence_ends_are_no_names(spark):
    from pyspark.sql import functions as F

    from alertloom.functions import network

    texts = ["at the end. a.b-c.de. Next.to x-.y.zz 3.5 a..bc a.-b.cd a." + "b" * 64 + ".ef", "end.", ".", "a.b.", "x" * 70 + ".com", "1.a2.c3.com9.org"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", F.regexp_extract_all("t", F.lit(network.DOMAIN), F.lit(0)).alias("want"), network.all_domains("t").alias("got")).collect():
        assert r.want == r.got, r.t
    assert r"\.[a-zA-Z0-9])" in network.FAST_DOMAIN
