"""Statistical and known-event checks on activity logs.

One pre-aggregation (artifact, user, address, event) shrinks the log with a map-side combine; every
check after it reads that compact table. Checks are rows ``(artifact_id, ord, sub, rule, detail)``,
so no group is ever collected; arrays appear only in ``log_reports``, which is meant for artifacts
that passed the 10 MB intake limit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.email import check
from ..functions.scoring import log_risk_score, rule_family
from ..session import materialize
from ..sources.rule_pack import RulePack
from .rules import FieldLookup, rule_hits

Z_THRESHOLD = 3.0
SPIKE_FLOOR = 15
SPIKE_FACTOR = 5.0
RECON_THRESHOLD = 3

# API calls by kind, compared without case.
HIGH_RISK_EVENTS = [
    "AssumeRole", "CreateUser", "CreateAccessKey", "AttachUserPolicy",
    "AttachRolePolicy", "PutUserPolicy", "PutRolePolicy",
    "CreateLoginProfile", "UpdateLoginProfile", "DeleteTrail",
    "StopLogging", "UpdateTrail", "PutEventSelectors",
    "DisableKey", "ScheduleKeyDeletion",
    "AuthorizeSecurityGroupIngress", "CreateSecurityGroup",
    "DeleteFlowLogs", "DeleteBucket", "PutBucketPolicy",
    "ConsoleLogin",
]
RECON_EVENTS = [
    "ListBuckets", "ListUsers", "ListRoles", "ListAccessKeys",
    "DescribeInstances", "DescribeSecurityGroups", "GetBucketAcl",
    "ListAttachedUserPolicies", "ListGroupsForUser",
    "GetAccountAuthorizationDetails",
]
SENSITIVE_EVENTS = ["ConsoleLogin", "AssumeRole", "CreateAccessKey", "CreateLoginProfile"]

ART = "artifact_id"
# Order of the checks in a report.
ORD = {
    "high_risk_api": 1, "access_denied": 2, "recon_burst": 3, "user_frequency": 4,
    "ip_frequency": 5, "sensitive_event_unseen_ip": 6, "sigma_rules": 7,
}


def _one_of(event: Column, names: list[str]) -> Column:
    return F.lower(event).isin(*[n.lower() for n in names])


def is_denied(error_code: Column, error_message: Column) -> Column:
    return F.contains(F.lower(error_code), F.lit("accessdenied")) | (F.lower(error_message) == "access denied")


def activity_counts(events: DataFrame) -> DataFrame:
    """Counts and first line per (artifact, user, address, event); the only pass over the log."""
    denied = is_denied(F.col("error_code"), F.col("error_message"))
    return events.groupBy(ART, "user_name", "source_ip", "event_name").agg(
        F.count("*").alias("n"),
        F.min("line_no").alias("first_line"),
        F.min(F.when(denied, F.col("line_no"))).alias("first_denied"),
    )


def summary(counts: DataFrame) -> DataFrame:
    """Records, users and addresses per artifact; empty names do not count."""
    return counts.groupBy(ART).agg(
        F.sum("n").alias("record_count"),
        F.count_distinct(F.when(F.col("user_name") != "", F.col("user_name"))).alias("user_count"),
        F.count_distinct(F.when(F.col("source_ip") != "", F.col("source_ip"))).alias("ip_count"),
    )


def unique_ips(counts: DataFrame) -> DataFrame:
    """One row per artifact and address with the line it was first seen on."""
    return (
        counts.filter(F.col("source_ip") != "").groupBy(ART, "source_ip")
        .agg(F.min("first_line").alias("first_line"))
    )


def _first_spelling(rows: DataFrame, line: str) -> DataFrame:
    """Distinct event names ignoring case, each in its first spelling."""
    return rows.groupBy(ART, F.lower("event_name").alias("folded")).agg(
        F.min_by("event_name", line).alias("event_name"), F.min(line).alias("line")
    )


def high_risk(counts: DataFrame) -> DataFrame:
    hits = counts.filter(_one_of(F.col("event_name"), HIGH_RISK_EVENTS))
    return _first_spelling(hits, "first_line").select(
        ART, F.lit(ORD["high_risk_api"]).alias("ord"), F.col("line").cast("string").alias("sub"),
        F.concat(F.lit("high_risk_api:"), F.col("event_name")).alias("rule"),
        F.col("event_name").alias("detail"),
    )


def access_denied(counts: DataFrame) -> DataFrame:
    hits = counts.filter(F.col("first_denied").isNotNull() & (F.col("event_name") != ""))
    return _first_spelling(hits, "first_denied").select(
        ART, F.lit(ORD["access_denied"]).alias("ord"), F.col("line").cast("string").alias("sub"),
        F.concat(F.lit("access_denied:"), F.col("event_name")).alias("rule"),
        F.col("event_name").alias("detail"),
    )


def recon_bursts(counts: DataFrame, threshold: int = RECON_THRESHOLD) -> DataFrame:
    """Users, the nameless one included, with many reconnaissance calls."""
    return (
        counts.filter(_one_of(F.col("event_name"), RECON_EVENTS))
        .groupBy(ART, "user_name").agg(F.sum("n").alias("n"), F.min("first_line").alias("line"))
        .filter(F.col("n") >= threshold)
        .select(
            ART, F.lit(ORD["recon_burst"]).alias("ord"), F.col("line").cast("string").alias("sub"),
            F.concat(F.lit("recon_burst:"), F.col("user_name"), F.lit(":"), F.col("n").cast("string")).alias("rule"),
            F.concat(F.col("user_name"), F.lit(" made "), F.col("n").cast("string"), F.lit(" recon calls")).alias("detail"),
        )
    )


def key_counts(counts: DataFrame, key: str) -> DataFrame:
    """Events per artifact and non-empty user or address."""
    return counts.filter(F.col(key) != "").groupBy(ART, F.col(key).alias("key")).agg(F.sum("n").alias("c"))


def frequency_stats(per_key: DataFrame) -> DataFrame:
    """Per artifact: number of keys, mean, population deviation, upper median and spike floor.

    Works on how often each count occurs. An artifact with n events has fewer than sqrt(2n) distinct
    counts, so the window that finds the median stays small even if one artifact holds most keys.
    """
    freq = per_key.groupBy(ART, "c").agg(F.count("*").alias("f"))
    w = Window.partitionBy(ART)
    upto = w.orderBy("c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = freq.select(
        ART, "c", "f",
        F.sum("f").over(w).alias("n"),
        F.sum("f").over(upto).alias("seen"),
    )
    whole = "decimal(19,0)"  # products of counts leave the range of a long
    stats = marked.groupBy(ART).agg(
        F.first("n").alias("n"),
        F.sum(F.col("f") * F.col("c")).alias("s1"),
        F.sum(F.col("f").cast(whole) * F.col("c").cast(whole) * F.col("c").cast(whole)).alias("s2"),
        # Upper median: element n div 2 (from 0) of the sorted counts.
        F.min(F.when(F.col("seen") > F.floor(F.col("n") / 2), F.col("c"))).alias("median"),
    )
    n, s1 = F.col("n").cast("double"), F.col("s1").cast("double")
    # Sums of integers are exact; the two terms are subtracted as integers before any division.
    spread = F.col("n").cast("decimal(19,0)") * F.col("s2") - F.col("s1").cast("decimal(19,0)") * F.col("s1").cast("decimal(19,0)")
    return stats.select(
        ART, F.col("n").alias("n_keys"), (s1 / n).alias("mean"),
        (F.sqrt(spread.cast("double")) / n).alias("std"),
        F.col("median").cast("double").alias("median"),
        F.greatest(F.lit(float(SPIKE_FLOOR)), F.col("median") * SPIKE_FACTOR).alias("spike_floor"),
    )


def frequency_stats_in_key_order(per_key: DataFrame) -> DataFrame:
    """The same figures, summed one by one in key order.

    Differs from ``frequency_stats`` in the last bits only, which matters when a z-score hits the
    threshold exactly. It collects the keys of an artifact: use it for artifacts below the intake limit.
    """
    pairs = F.array_sort(F.collect_list(F.struct("key", "c")))
    values = per_key.groupBy(ART).agg(F.transform(pairs, lambda p: p["c"].cast("double")).alias("v"))
    add = lambda acc, x: acc + x
    n = F.size("v")
    with_mean = values.withColumn("mean", F.aggregate("v", F.lit(0.0), add) / n)
    squares = F.transform("v", lambda x: (x - F.col("mean")) * (x - F.col("mean")))
    median = F.get(F.array_sort("v"), F.floor(n / 2).cast("int"))
    return with_mean.select(
        ART, n.cast("long").alias("n_keys"), "mean",
        F.sqrt(F.aggregate(squares, F.lit(0.0), add) / n).alias("std"),
        median.alias("median"),
        F.greatest(F.lit(float(SPIKE_FLOOR)), median * SPIKE_FACTOR).alias("spike_floor"),
    )


def frequency_anomalies(counts: DataFrame, key: str, dimension: str, z_threshold: float = Z_THRESHOLD,
                        in_key_order: bool = False, stats: DataFrame | None = None) -> DataFrame:
    """z-score anomalies, and spikes among the keys that are no anomaly. Needs two keys."""
    per_key = key_counts(counts, key)
    if stats is None:
        stats = (frequency_stats_in_key_order if in_key_order else frequency_stats)(per_key)
    z = F.when(F.col("std") > 0, (F.col("c") - F.col("mean")) / F.col("std")).otherwise(0.0)
    scored = per_key.join(stats.filter(F.col("n_keys") >= 2), ART).withColumn("z", z)
    anomaly = F.col("z") >= z_threshold
    return scored.filter(anomaly | (F.col("c") >= F.col("spike_floor"))).select(
        ART, F.lit(ORD[f"{dimension}_frequency"]).alias("ord"), F.col("key").alias("sub"),
        F.when(anomaly, F.concat(
            F.lit(f"{dimension}_event_count_anomaly:"), F.col("key"), F.lit(":z="), F.format_string("%.2f", "z")
        )).otherwise(F.concat(
            F.lit(f"{dimension}_event_frequency_spike:"), F.col("key"), F.lit(":count="), F.col("c").cast("string")
        )).alias("rule"),
    ).withColumn("detail", F.col("rule"))


def unseen_ip(counts: DataFrame) -> DataFrame:
    """Sensitive events from an address where the user did nothing else, if the user has others."""
    named = counts.filter((F.col("user_name") != "") & (F.col("source_ip") != ""))
    sensitive = _one_of(F.col("event_name"), SENSITIVE_EVENTS)
    pairs = named.groupBy(ART, "user_name", "source_ip").agg(F.bool_and(sensitive).alias("only_sensitive"))
    # Two different addresses exist exactly when the least differs from the greatest.
    users = (
        pairs.groupBy(ART, "user_name").agg(F.min("source_ip").alias("lo"), F.max("source_ip").alias("hi"))
        .filter(F.col("lo") != F.col("hi")).select(ART, "user_name")
    )
    lonely = pairs.filter("only_sensitive").select(ART, "user_name", "source_ip")
    return (
        named.filter(sensitive)
        .join(lonely, [ART, "user_name", "source_ip"], "left_semi")
        .join(users, [ART, "user_name"], "left_semi")
        .select(
            ART, F.lit(ORD["sensitive_event_unseen_ip"]).alias("ord"), F.col("first_line").cast("string").alias("sub"),
            F.concat_ws(":", F.lit("sensitive_event_unseen_ip"), "event_name", "user_name", "source_ip").alias("rule"),
        ).withColumn("detail", F.col("rule"))
    )


def sigma_checks(events: DataFrame, pack: RulePack, fields: FieldLookup | None = None) -> DataFrame:
    """Rule-pack hits as check rows, most hits first."""
    hits = rule_hits(events, pack, [ART], fields)
    return hits.select(
        ART, F.lit(ORD["sigma_rules"]).alias("ord"),
        F.concat(F.lpad((F.lit(10**18) - F.col("hits")).cast("string"), 19, "0"), F.lit(" "), "title").alias("sub"),
        F.concat(F.lit("sigma:"), "slug").alias("rule"),
        F.concat("title", F.lit(" ["), "level", F.lit("] × "), F.col("hits").cast("string")).alias("detail"),
    )


def log_rules(events: DataFrame, pack: RulePack | None = None, z_threshold: float = Z_THRESHOLD,
              in_key_order: bool = False, fields: FieldLookup | None = None,
              counts: DataFrame | None = None) -> DataFrame:
    """All check rows of a log table. Pass ``counts`` when the pre-aggregation is already written."""
    counts = counts if counts is not None else activity_counts(events)
    parts = [
        high_risk(counts), access_denied(counts), recon_bursts(counts),
        frequency_anomalies(counts, "user_name", "user", z_threshold, in_key_order),
        frequency_anomalies(counts, "source_ip", "ip", z_threshold, in_key_order),
        unseen_ip(counts),
    ]
    if pack is not None and pack.rules:
        parts.append(sigma_checks(events, pack, fields))
    return reduce(DataFrame.unionByName, parts)


def verdicts(rules: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(artifact_id, rule_count, risk_score, verdict); artifacts without a rule are benign."""
    scored = rules.groupBy(ART).agg(
        F.count("*").alias("rule_count"), F.count_distinct(rule_family("rule")).alias("families")
    )
    n = F.coalesce(F.col("rule_count"), F.lit(0))
    return artifacts.select(ART).join(scored, ART, "left").select(
        ART, n.alias("rule_count"),
        log_risk_score(F.coalesce(F.col("families"), F.lit(0))).alias("risk_score"),
        F.when(n > 0, "Suspicious").otherwise("Benign").alias("verdict"),
    )


def _dimension_check(flags: Column, stats: Column, name: str, dimension: str) -> Column:
    """Frequency check entry; null when the artifact has fewer than two keys."""
    text = F.concat(
        F.format_string(f"%d {dimension}(s), mean=%.1f, std=%.2f, median=%.0f, spike floor=%.0f.",
                        stats["n_keys"], stats["mean"], stats["std"], stats["median"], stats["spike_floor"]),
        F.when(F.size(flags) > 0, F.concat(F.lit(" Flagged: "), F.array_join(flags, ", "))).otherwise(""),
    )
    return F.when(stats["n_keys"] >= 2, check(
        F.lit(name), F.when(F.size(flags) > 0, "flag").otherwise("pass"), text
    ))


def log_reports(artifacts: DataFrame, events: DataFrame, pack: RulePack | None = None,
                z_threshold: float = Z_THRESHOLD, in_key_order: bool = False,
                fields: FieldLookup | None = None, reuse: bool = True) -> DataFrame:
    """One report row per artifact: matched rules in check order, checks, extracted facts, verdict.

    ``reuse`` writes the pre-aggregation to the shared folder once instead of computing it per check.
    """
    counts = activity_counts(events)
    if reuse:
        counts = materialize(counts, "log-counts")
    rules = log_rules(events, pack, z_threshold, in_key_order, fields, counts)
    per_artifact = rules.groupBy(ART).agg(
        F.array_sort(F.collect_list(F.struct(
            "ord", F.when(F.col("ord").isin(4, 5, 7), F.col("sub"))
            .otherwise(F.lpad("sub", 19, "0")).alias("sub"), "rule", "detail"
        ))).alias("hits")
    )
    ips = unique_ips(counts).groupBy(ART).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("first_line", "source_ip"))), lambda s: s["source_ip"]
        ).alias("unique_ips")
    )
    stat = frequency_stats_in_key_order if in_key_order else frequency_stats
    def stats_of(key: str, name: str) -> DataFrame:
        s = stat(key_counts(counts, key))
        return s.select(ART, F.struct(*[c for c in s.columns if c != ART]).alias(name))

    n_rules = len(pack.rules) if pack is not None else 0
    joined = (
        artifacts.select(ART)
        .join(summary(counts), ART, "left")
        .join(ips, ART, "left")
        .join(per_artifact, ART, "left")
        .join(stats_of("user_name", "user_stats"), ART, "left")
        .join(stats_of("source_ip", "ip_stats"), ART, "left")
        .withColumn("hits", F.coalesce("hits", F.array().cast(
            "array<struct<ord:int,sub:string,rule:string,detail:string>>")))
    )

    def details(name: str, field: str = "detail") -> Column:
        return F.transform(
            F.filter("hits", lambda h: h["ord"] == ORD[name]), lambda h: h[field]
        )

    def flagged(name: str, text: Column, none: str) -> Column:
        hit = F.size(details(name)) > 0
        return check(F.lit(name), F.when(hit, "flag").otherwise("pass"), F.when(hit, text).otherwise(none))

    checks = F.array_compact(F.array(
        flagged("high_risk_api", F.concat(F.lit("High-risk events: "), F.array_join(details("high_risk_api"), ", ")), "None found."),
        flagged("access_denied", F.concat(F.lit("Access denied on: "), F.array_join(details("access_denied"), ", ")), "None found."),
        flagged("recon_burst", F.array_join(details("recon_burst"), "; "), "No per-user recon burst."),
        _dimension_check(details("user_frequency"), F.col("user_stats"), "user_frequency", "user"),
        _dimension_check(details("ip_frequency"), F.col("ip_stats"), "ip_frequency", "ip"),
        flagged("sensitive_event_unseen_ip", F.concat(
            F.size(details("sensitive_event_unseen_ip")).cast("string"),
            F.lit(" sensitive event(s) from previously unseen IPs.")), "None found."),
        flagged("sigma_rules", F.array_join(details("sigma_rules"), "; "),
                f"No match across {n_rules} loaded rules." if n_rules else "No rules loaded."),
    ))
    rules_array = F.transform("hits", lambda h: h["rule"])
    families = F.size(F.array_distinct(F.transform("hits", lambda h: rule_family(h["rule"]))))
    empty = F.col("record_count").isNull()
    return joined.select(
        ART,
        F.lit("Csv").alias("artifact_type"),
        log_risk_score(families).alias("risk_score"),
        F.when(F.size("hits") > 0, "Suspicious").otherwise("Benign").alias("verdict"),
        rules_array.alias("matched_rules"),
        F.when(empty, F.array(check(F.lit("parse"), F.lit("info"), F.lit("No data rows found."))))
        .otherwise(checks).alias("checks"),
        F.struct(
            F.coalesce("record_count", F.lit(0)).alias("record_count"),
            F.coalesce("user_count", F.lit(0)).alias("user_count"),
            F.coalesce("unique_ips", F.array().cast("array<string>")).alias("unique_ips"),
            F.lit(n_rules).alias("sigma_rules_loaded"),
        ).alias("extracted"),
    )
