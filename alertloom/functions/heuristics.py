"""Scores for indicators without any feed answer: plain arithmetic over pattern tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .network import url_host
from .text import as_col, clamp, compact_names, let, strip

# Address prefixes, top-level domains, words and domains the scores depend on.
TOR_PREFIXES = [
    "185.220.", "185.129.", "176.10.", "198.98.", "195.176.",
    "62.210.", "51.15.", "163.172.", "212.47.", "151.115.",
]
RISKY_TLDS = [
    "xyz", "top", "tk", "ml", "ga", "cf", "pw", "buzz", "club",
    "work", "icu", "cam", "rest", "surf", "monster", "loan",
]
MALICIOUS_WORDS = [
    r"(bank|paypal|chase|wells.?fargo|citi|secure.?login)",
    r"(phishing|malware|exploit|ransomware|c2|command.?control)",
]
TRUSTED_DOMAINS = [
    "google.com", "microsoft.com", "amazon.com", "apple.com",
    "cloudflare.com", "amazonaws.com", "azure.com", "github.com",
    "office.com", "outlook.com", "live.com", "facebook.com",
    "twitter.com", "linkedin.com", "akamai.com", "fastly.com",
]
DOTTED_QUAD = r"^\d{1,3}(\.\d{1,3}){3}$"
PRIVATE_RANGES = (
    r"^(10\.\d{1,3}\.\d{1,3}\.\d{1,3}"
    r"|172\.(1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}"
    r"|192\.168\.\d{1,3}\.\d{1,3}"
    r"|127\.\d{1,3}\.\d{1,3}\.\d{1,3})$"
)


def _result(score: Column, flags: Column) -> Column:
    return F.struct(clamp(score, 0.0, 1.0).alias("score"), flags.alias("flags"))


def score_ip(ip: Column | str) -> Column:
    """struct(score, flags) of an address."""
    value = as_col(ip)
    private = F.rlike(value, F.lit(PRIVATE_RANGES))
    tor = F.lit(False)
    for prefix in TOR_PREFIXES:
        tor = tor | F.startswith(value, F.lit(prefix))
    octet = F.when(
        F.rlike(value, F.lit(DOTTED_QUAD)), F.substring_index(value, ".", 1).try_cast("int")
    )
    geo = F.coalesce(octet.between(176, 185) | octet.between(36, 41), F.lit(False))
    score = F.when(private, 0.0).otherwise(
        F.when(tor, 0.40).otherwise(0.0) + F.when(geo, 0.15).otherwise(0.0)
    )
    flags = F.when(private, F.array(F.lit("internal_ip"))).otherwise(compact_names(
        F.when(tor, F.lit("known_tor_exit_prefix")), F.when(geo, F.lit("high_risk_geo_range"))
    ))
    return _result(score, flags)


def score_domain(domain: Column | str) -> Column:
    """struct(score, flags) of a domain; the registered name is taken as its last two labels."""
    value = as_col(domain)
    labels = F.filter(
        F.transform(F.split(F.rtrim(strip(value), F.lit(".")), r"\."), strip), lambda l: l != ""
    )
    return let(labels, lambda parts: _score_labels(parts, value))


def _score_labels(parts: Column, value: Column) -> Column:
    tld = F.try_element_at(parts, F.lit(-1))
    second = F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2)))
    registered = F.lower(F.concat_ws(".", second, tld))
    trusted = F.coalesce(registered.isin(*TRUSTED_DOMAINS), F.lit(False))
    risky = F.coalesce(F.lower(tld).isin(*RISKY_TLDS), F.lit(False))
    words = F.rlike(F.lower(value), F.lit("(?d)" + "|".join(MALICIOUS_WORDS)))
    hyphens = F.coalesce(
        F.length(second) - F.length(F.replace(second, F.lit("-"), F.lit(""))) >= 2, F.lit(False)
    )
    empty = F.size(parts) == 0
    score = F.when(empty | trusted, 0.0).otherwise(
        F.when(risky, 0.25).otherwise(0.0)
        + F.when(words, 0.30).otherwise(0.0)
        + F.when(hyphens, 0.15).otherwise(0.0)
    )
    flags = (
        F.when(empty, F.array().cast("array<string>"))
        .when(trusted, F.array(F.lit("whitelisted_domain")))
        .otherwise(compact_names(
            F.when(risky, F.concat(F.lit("high_risk_tld:."), F.lower(tld))),
            F.when(words, F.lit("brand_impersonation_pattern")),
            F.when(hyphens, F.lit("multi_hyphen_domain")),
        ))
    )
    return _result(score, flags)


def score_url(url: Column | str) -> Column:
    return score_domain(url_host(url))


def heuristic(type_col: Column | str, value_col: Column | str) -> Column:
    """struct(score, flags) by indicator type; hashes and mail addresses score 0."""
    kind, value = as_col(type_col), as_col(value_col)
    nothing = _result(F.lit(0.0), F.array().cast("array<string>"))
    # URLs and domains share one expression: only the text it looks at differs.
    host = F.when(kind == "Url", url_host(value)).otherwise(value)
    return (
        F.when(kind == "Ip", score_ip(value))
        .when(kind.isin("Domain", "Url"), score_domain(host))
        .otherwise(nothing)
    )
