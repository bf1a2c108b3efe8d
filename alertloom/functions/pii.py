"""Redaction of personal data and secrets as one chain of native ``regexp_replace`` calls.

Rules run on raw text; everything that goes to a model or is kept as payload uses the scrubbed text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .network import FAST_EMAIL
from .text import as_col

# What is redacted, in the order of application, and by what it is replaced.
# An address of version 6 is either eight full groups or has exactly one "::" with well-formed ends.
# The leading look-ahead of it and of the phone pattern only makes most positions fail early.
IPV6 = (
    r"(?d)(?=[0-9A-Fa-f]{0,4}+:)(?<![0-9A-Fa-f:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|(?=[0-9A-Fa-f:]*[0-9A-Fa-f])(?=[0-9A-Fa-f:]*::)(?![0-9A-Fa-f:]*::[0-9A-Fa-f:]*::)"
    r"(?![0-9A-Fa-f:]*:::)(?!:[0-9A-Fa-f])(?![0-9A-Fa-f:]*[0-9A-Fa-f]:(?![0-9A-Fa-f:]))"
    r"(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4})(?![0-9A-Fa-f:])"
)
AWS_KEY = r"(?U)\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"
AWS_SECRET = r"""(?dU)(?<=['"\s=:])[A-Za-z0-9/+=]{40}(?=['"\s,}]|$)"""
CARD = r"(?U)\b(?:\d{4}[\s\-]?){3}\d{4}\b"
SSN = r"(?U)\b\d{3}-\d{2}-\d{4}\b"
IPV4 = (
    r"(?U)\b(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}"
    r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\b"
)
PHONE = r"(?U)(?=[+(\d])(?<!\d)(?:\+?\d{1,3}[\s\-])?(?:\(?\d{2,4}\)?[\s\-])?\d{3,4}[\s\-]\d{4}(?!\d)"
# Phone numbers as an engine without look-around finds them: the sign on either side belongs to the hit, so of two
# numbers with one sign between them the second is found in part or not at all. Digits and white space are ASCII.
PHONE_CONSUMING = (
    r"(?=[^0-9]?[+(0-9])(^|[^0-9])(?:\+?[0-9]{1,3}[\t\n\f\r \-])?(?:\(?[0-9]{2,4}\)?[\t\n\f\r \-])?"
    r"[0-9]{3,4}[\t\n\f\r \-][0-9]{4}(\z|[^0-9])"
)
ACCOUNT_ID = r"""(?iU)((?:account[_\-\s]?(?:id)?|arn:aws)[:\s"']*)\d{12}\b"""

RULES: list[tuple[str, str, str]] = [
    ("ipv6", IPV6, "[REDACTED_IP]"),
    ("aws_key", AWS_KEY, "[REDACTED_AWS_KEY]"),
    ("aws_secret", AWS_SECRET, "[REDACTED_AWS_SECRET]"),
    ("card", CARD, "[REDACTED_CARD]"),
    ("ssn", SSN, "[REDACTED_SSN]"),
    ("email", FAST_EMAIL, "$1[REDACTED_EMAIL]"),
    ("ipv4", IPV4, "[REDACTED_IP]"),
    ("phone", PHONE, "[REDACTED_PHONE]"),
    ("account_id", ACCOUNT_ID, "$1[REDACTED_ACCOUNT_ID]"),
]
# The rules as the SQL of the registered queries states them.
SQL_RULES = [(n, PHONE_CONSUMING, "$1[REDACTED_PHONE]$2") if n == "phone" else (n, p, r) for n, p, r in RULES]


def redact(col: Column | str, kind: str, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """Apply a single redaction rule."""
    pattern, replacement = next((p, r) for name, p, r in rules if name == kind)
    return F.regexp_replace(as_col(col), F.lit(pattern), F.lit(replacement))


def scrub(col: Column | str, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """Apply every rule in order; null becomes the empty string."""
    out = F.coalesce(as_col(col), F.lit(""))
    for name, _, _ in rules:
        out = redact(out, name, rules)
    return out
