"""Rule report of e-mails: a projection over parsed messages, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import email as E
from ..functions import network as N
from ..functions.text import compact


def email_reports(messages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(artifact_id, headers, body) to one report row each, like ``log_reports``.

    Columns named in ``keep`` are passed through, which spares a join with the messages later.
    """
    keep = keep or []
    found = messages.select(
        "artifact_id", *keep,
        E.combined_text(E.header("headers", "Subject"), "body").alias("text"),
        E.auth_results("headers").alias("auth"),
        E.header_ips("headers").alias("header_ips"),
        E.sender_address(E.header("headers", "From")).alias("sender"),
    ).select(
        "artifact_id", *keep, "auth", "header_ips", "sender",
        E.sender_domain("sender").alias("sender_domain"),
        E.keyword_rules("text").alias("keywords"),
        N.urls("text").alias("urls"),
        N.ips("text").alias("ips"),
        N.domains("text").alias("domains"),
        E.has_ip_url("text").alias("ip_url"),
    ).withColumn(
        "suspicious", E.suspicious_domain_rules("domains", "sender_domain")
    ).withColumn("brand", E.lookalike_brand("sender_domain"))

    lookalike = F.when(
        F.col("brand").isNotNull(), F.concat(F.lit("lookalike_domain:"), F.col("sender_domain"))
    )
    rules = F.concat(
        E.auth_rules(F.col("auth")), F.col("keywords"), F.col("suspicious"), compact(lookalike),
        compact(F.when(F.col("ip_url"), F.lit("ip_in_url_detected"))),
    )
    d = F.col("sender_domain")
    checks = F.concat(
        E.auth_checks(F.col("auth")),
        F.array(
            E.check(
                F.lit("lookalike_domain"),
                F.when(F.col("brand").isNotNull(), "flag").otherwise("pass"),
                F.when(F.col("brand").isNotNull(), F.concat(
                    F.lit("Sender domain '"), d, F.lit("' impersonates brand '"), F.col("brand"), F.lit("'.")))
                .when(d.isNull(), "No sender domain.")
                .otherwise(F.concat(F.lit("Sender domain '"), d, F.lit("' is clean."))),
            ),
            E.check(
                F.lit("ip_in_url"), F.when(F.col("ip_url"), "flag").otherwise("pass"),
                F.when(F.col("ip_url"), "URL with literal IP host found.").otherwise("No IP-based URLs."),
            ),
        ),
    )
    score = E.email_risk_score(
        F.size("matched_rules"), F.size("urls"), F.size("ips"), F.size("header_ips"), F.col("ip_url"),
        (F.size("suspicious") > 0) | F.col("brand").isNotNull(),
    )
    return found.withColumn("matched_rules", rules).select(
        "artifact_id", *keep,
        F.lit("Eml").alias("artifact_type"),
        score.alias("risk_score"),
        F.when(F.size("matched_rules") > 0, "Suspicious").otherwise("Benign").alias("verdict"),
        "matched_rules",
        checks.alias("checks"),
        F.struct(
            "sender", F.col("sender_domain").alias("sender_domain"), "urls", "ips", "domains", "header_ips"
        ).alias("extracted"),
    )
