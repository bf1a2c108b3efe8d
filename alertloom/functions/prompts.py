"""Prompt texts as columns, for a batch-inference job over a table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .email import TRUNCATED
from .text import as_col, truncate

# The wording of all prompts below.


def rules_or_none(rules: Column) -> Column:
    return F.when(F.size(rules) > 0, F.array_join(rules, ", ")).otherwise("none")


def email_prompt(payload: Column | str, rules: Column | str, tool_json: Column | str,
                 limit: int | None = None) -> Column:
    """User prompt for the e-mail analysis of one scrubbed message, whole unless the caller sets a limit."""
    return F.concat(
        F.lit("Analyze this email for phishing indicators.\n\nTier 1 static filter matched rules: "),
        rules_or_none(as_col(rules)),
        F.lit("\n\nPre-computed tool output (parsed structure + extracted network entities):\n"),
        as_col(tool_json),
        F.lit("\n\nEmail content (PII-redacted):\n"),
        truncate(payload, limit, TRUNCATED),
        F.lit("\n\nProvide your final analysis as the JSON object described in the system instructions."),
    )


def similar_section(similar: Column | str, max_rules: int | None = None) -> Column:
    """Text about similar past incidents, empty when there are none; all their rules unless a number is given.

    ``similar`` is array<struct<risk_score, severity, matched_rules, excerpt, similarity>>.
    """
    items = as_col(similar)
    lines = F.transform(items, lambda s: F.concat(
        F.format_string("- risk %.1f (%s), similarity %.2f, rules: ", s["risk_score"], s["severity"], s["similarity"]),
        rules_or_none(s["matched_rules"] if max_rules is None else F.slice(s["matched_rules"], 1, max_rules)),
        F.lit("\n  summary: "),
        s["excerpt"],
    ))
    head = (
        "Similar past incidents (retrieved by embedding similarity — background\n"
        "context only; never present their conclusions as observed facts of THIS job):\n"
    )
    return F.when(
        F.size(items) > 0, F.rtrim(F.concat(F.lit(head), F.array_join(lines, "\n")), F.lit(" \n\r\t"))
    ).otherwise("")


def synthesis_prompt(evidence_json: Column | str, similar: Column | str) -> Column:
    """User prompt for the final report of one job."""
    section = similar_section(similar)
    return F.concat(
        F.lit(
            "Synthesize the final incident report for this job.\n\n"
            "Evidence bundle (all fields are observed data; reason only about these):\n"
        ),
        as_col(evidence_json),
        F.lit("\n"),
        F.when(section != "", F.concat(F.lit("\n"), section, F.lit("\n"))).otherwise(""),
        F.lit("\nProvide the report as the JSON object described in the system instructions."),
    )


def validation_retry(violations: Column | str) -> Column:
    """Instruction for a second attempt that names what was wrong with the first."""
    return F.concat(
        F.lit("Your previous response violated the report contract:\n"),
        F.array_join(F.transform(as_col(violations), lambda v: F.concat(F.lit("- "), v)), "\n"),
        F.lit("\n\nRespond with ONLY the corrected JSON object — no markdown fences, no commentary."),
    )
