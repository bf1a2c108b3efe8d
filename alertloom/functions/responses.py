"""Parsing of model answers that arrive as text in a table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EMAIL_VERDICTS, IOC_TYPES, SEVERITIES
from .text import as_col, clamp, compact, is_blank, let, nonblank, strip

FENCE = "`" * 3
FENCED = rf"(?sU){FENCE}(?:json)?\s*\n?(.*?)\s*\n?{FENCE}"
# A comma before a closing bracket, outside of strings: strings are matched first and kept.
TRAILING_COMMA = r'("(?:[^"\\]|\\.)*+")|,(?=\s*[}\]])'

_JSON_OPTIONS = {"allowComments": "true", "mode": "PERMISSIVE"}


def extract_json(raw: Column | str) -> Column:
    """The JSON object of an answer: a fenced block, else the outermost braces, else null."""
    text = as_col(raw)
    braces = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.rlike(text, F.lit(FENCED)), strip(F.regexp_extract(text, FENCED, 1))).otherwise(braces)


def _lower_keys(json: Column, keys: list[str]) -> Column:
    """Spell the expected keys in lower case, since JSON field lookup is case-sensitive."""
    out = json
    for key in keys:
        out = F.regexp_replace(out, rf'(?i)"{key}"(?=\s*:)', f'"{key}"')
    return out


def _parsed(raw: Column | str, schema: str, keys: list[str]) -> Column:
    json = F.regexp_replace(extract_json(raw), TRAILING_COMMA, "$1")
    return F.from_json(_lower_keys(json, keys), schema + ", _bad string", {
        **_JSON_OPTIONS, "columnNameOfCorruptRecord": "_bad",
    })


def _enum(value: Column, names: list[str]) -> Column:
    """Canonical spelling of an enumeration name, ignoring case; null when unknown."""
    folded = F.lower(strip(value))
    return F.coalesce(*[F.when(folded == n.lower(), F.lit(n)) for n in names])


def email_analysis(raw: Column | str) -> Column:
    """struct(status, confidence, iocs, phishing_indicators, summary), null when unusable.

    Numeric enumeration values are not accepted.
    """
    schema = (
        "status string, confidence double, iocs array<struct<type:string,value:string>>, "
        "phishing_indicators array<string>, summary string"
    )
    keys = ["status", "confidence", "iocs", "phishing_indicators", "summary", "type", "value"]

    def build(p: Column) -> Column:
        iocs = F.filter(
            F.transform(
                F.coalesce(p["iocs"], F.array().cast("array<struct<type:string,value:string>>")),
                lambda i: F.struct(
                    _enum(i["type"], IOC_TYPES).alias("type"), strip(i["value"]).alias("value")
                ),
            ),
            lambda i: i["type"].isNotNull() & ~is_blank(i["value"]),
        )
        status = _enum(p["status"], EMAIL_VERDICTS)
        result = F.struct(
            status.alias("status"),
            clamp(F.coalesce(p["confidence"], F.lit(0.5)), 0.0, 1.0).alias("confidence"),
            iocs.alias("iocs"),
            nonblank(F.coalesce(p["phishing_indicators"], F.array().cast("array<string>")))
            .alias("phishing_indicators"),
            strip(p["summary"]).alias("summary"),
        )
        return F.when(p["_bad"].isNull() & status.isNotNull() & ~is_blank(p["summary"]), result)

    return let(_parsed(raw, schema, keys), build)


def synthesis(raw: Column | str) -> Column:
    """struct(risk_score, severity, summary, mitre, actions, evidence), null when unusable."""
    schema = (
        "risk_score double, severity string, summary_markdown string, mitre_techniques array<string>, "
        "recommended_actions array<string>, evidence_trail array<struct<claim:string,source:string>>"
    )
    keys = [
        "risk_score", "severity", "summary_markdown", "mitre_techniques", "recommended_actions",
        "evidence_trail", "claim", "source",
    ]

    def build(p: Column) -> Column:
        texts = lambda c: F.transform(
            nonblank(F.coalesce(c, F.array().cast("array<string>"))), strip
        )
        severity = _enum(p["severity"], SEVERITIES)
        evidence = F.transform(
            F.filter(
                F.coalesce(p["evidence_trail"], F.array().cast("array<struct<claim:string,source:string>>")),
                lambda e: ~is_blank(e["claim"]) & ~is_blank(e["source"]),
            ),
            lambda e: F.struct(strip(e["claim"]).alias("claim"), strip(e["source"]).alias("source")),
        )
        result = F.struct(
            p["risk_score"].alias("risk_score"),
            severity.alias("severity"),
            strip(p["summary_markdown"]).alias("summary"),
            texts(p["mitre_techniques"]).alias("mitre"),
            texts(p["recommended_actions"]).alias("actions"),
            evidence.alias("evidence"),
        )
        usable = (
            p["_bad"].isNull() & p["risk_score"].isNotNull() & severity.isNotNull()
            & ~is_blank(p["summary_markdown"])
        )
        return F.when(usable, result)

    return let(_parsed(raw, schema, keys), build)


def rule_report(json: Column | str) -> Column:
    """struct(matched_rules, extracted, risk_score) of a stored rule report; corrupt text gives null.

    Entries that are not strings are dropped, a missing or non-integer score is 0, and a report
    without ``extracted`` is null.
    """
    value = F.try_parse_json(as_col(json))

    def build(v: Column) -> Column:
        entries = F.try_variant_get(v, "$.matchedRules", "array<variant>")
        rules = F.array_compact(F.transform(
            F.coalesce(entries, F.array().cast("array<variant>")),
            lambda e: F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string")),
        ))
        score_kind = F.schema_of_variant(F.try_variant_get(v, "$.riskScore", "variant"))
        score = F.when(score_kind == "BIGINT", F.try_variant_get(v, "$.riskScore", "int"))
        extracted = F.try_variant_get(v, "$.extracted", "variant")
        return F.when(extracted.isNotNull(), F.struct(
            rules.alias("matched_rules"),
            F.to_json(extracted).alias("extracted"),
            F.coalesce(score, F.lit(0)).alias("risk_score"),
        ))

    return let(value, build)


def json_strings(json: Column | str) -> Column:
    """Array of strings from JSON text; corrupt text gives an empty array."""
    return F.coalesce(F.from_json(as_col(json), "array<string>"), F.array().cast("array<string>"))


__all__ = ["compact", "email_analysis", "extract_json", "json_strings", "rule_report", "synthesis"]
