"""E-mail columns: headers, authentication, keyword rules, sender and look-alike checks."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import network
from .text import as_col, compact, compact_names, first_or_null, is_blank, let, strip, truncate

# Authentication protocols and the results that count as failure.
AUTH_PROTOCOLS = ["spf", "dkim", "dmarc"]
AUTH_FAILURES = ["fail", "softfail"]

# Phishing wording, rule name and pattern over the lower-cased subject and body.
PHISHING_RULES: list[tuple[str, str]] = [
    ("urgent_action_required", r"\b(urgent|immediate\s+action|act\s+now|action\s+required)\b"),
    ("verify_account", r"\b(verify\s+your\s+(account|identity)|confirm\s+your\s+(identity|account))\b"),
    ("password_reset", r"\b(reset\s+your\s+password|change\s+your\s+password|password\s+expir)"),
    ("suspended_account", r"\b(account\s+(suspended|locked|disabled|compromised|permanently))\b"),
    ("click_link", r"\b(click\s+(here|this\s+link|below|the\s+secure\s+link)|follow\s+this\s+link)\b"),
    ("fake_login_page", r"\b(login|log\s+in|sign\s+in)\s+(to\s+your|page|portal)\b"),
    ("financial_threat", r"\b(bank\s+account|credit\s+card|payment\s+(declined|failed)|unauthorized\s+transaction|wire\s+transfer)\b"),
    ("reward_lure", r"\b(you\s+have\s+won|congratulations|claim\s+your\s+(prize|reward|refund))\b"),
    ("personal_info_request", r"\b(social\s+security|ssn|date\s+of\s+birth|mother.?s\s+maiden|routing\s+number|account\s+number)\b"),
    ("attachment_lure", r"\b(see\s+attached|open\s+the\s+attachment|download\s+the\s+file)\b"),
    ("time_pressure", r"\b(within\s+\d+\s+hours?|expires?\s+(today|soon|immediately)|final\s+warning)\b"),
    ("security_alert", r"\b(security\s+alert|unusual\s+login|unrecognized\s+device|unauthorized\s+access|suspicious\s+activity)\b"),
    ("credential_harvest", r"\b(domain\s+credentials?|enter\s+(your\s+)?(password|credentials?)|log\s*in\s+credentials?)\b"),
    ("impersonation_authority", r"\b(federal\s+reserve|regulatory|compliance\s+update|internal\s+audit|ceo|finance\s+officer|swift\s+transfer)\b"),
    ("compliance_pressure", r"\b(mandatory|must\s+be\s+applied|require[ds]?\s+.{0,20}update|immediately)\b"),
    ("ip_in_url_lure", r"https?://\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"),
    ("device_login_scare", r"\b(login\s+from.{0,30}(device|location|ip)|secure\s+your\s+account|review\s+(the|your)\s+logs)\b"),
]


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of ``\\b(...)``, split at the bars outside of inner groups."""
    out, depth = [""], 0
    for c in pattern[pattern.index("(") + 1:]:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            break
        if c == "|" and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return out


def fast_rule(pattern: str) -> str:
    """The same hits, found faster: a word boundary in Unicode is costly, so the two letters that a hit may begin with
    are looked at first."""
    if not pattern.startswith(r"\b("):
        return pattern
    begins = _alternatives(pattern)
    return "(?=[{}][{}])".format(*("".join(sorted({b[i] for b in begins})) for i in (0, 1))) + pattern


# Literals without which a rule cannot match: all of one of its groups must occur. They are searched
# first, so that benign text rarely reaches the patterns.
_GUARDS: dict[str, list[tuple[str, ...]]] = {
    "urgent_action_required": [("urgent",), ("immediate", "action"), ("act", "now"), ("action", "required")],
    "verify_account": [("verify", "your"), ("confirm", "your")],
    "password_reset": [("password",)],
    "suspended_account": [("account", w) for w in ("suspended", "locked", "disabled", "compromised", "permanently")],
    "click_link": [("click",), ("follow", "link")],
    "fake_login_page": [(a, b) for a in ("log", "sign") for b in ("your", "page", "portal")],
    "financial_threat": [("bank", "account"), ("credit", "card"), ("payment",), ("unauthorized",), ("wire", "transfer")],
    "reward_lure": [("you", "have", "won"), ("congratulations",), ("claim", "your")],
    "personal_info_request": [("social", "security"), ("ssn",), ("birth",), ("maiden",), ("number",)],
    "attachment_lure": [("attach",), ("download",)],
    "time_pressure": [("within", "hour"), ("expire",), ("final", "warning")],
    "security_alert": [("security", "alert"), ("unusual", "login"), ("unrecognized",), ("unauthorized",), ("suspicious", "activity")],
    "credential_harvest": [("credential",), ("enter", "password")],
    "impersonation_authority": [
        ("federal", "reserve"), ("regulatory",), ("compliance", "update"), ("internal", "audit"), ("ceo",),
        ("finance", "officer"), ("swift", "transfer"),
    ],
    "compliance_pressure": [("mandatory",), ("must", "applied"), ("require", "update"), ("immediately",)],
    "ip_in_url_lure": [("://",)],
    "device_login_scare": [("login", "from"), ("secure", "account"), ("review", "logs")],
}

# Domain shapes that are suspicious by themselves, on the lower-cased domain.
SUSPICIOUS_DOMAINS: list[str] = [
    r"secure-.*login",
    r"(bank|paypal|chase|wells\s?fargo).*\.(xyz|top|tk|ml|ga|cf|pw)",
    r"\d{4,}.*\.(com|net|org)",
    r"[a-z]+-[a-z]+-[a-z]+\.(com|net)",
    r"(vault|portal|desk|reserve|swift).*bank",
    r"bank.*(vault|portal|desk|secure)",
    r"federal-reserve|reserve-notice",
    r"(it-desk|help-?desk).*\.(net|com)",
    r"(swift|ach|wire)-.*\.(com|net)",
]

# Imitated brands and the domains they really own; the first brand that fires wins.
BRANDS: list[tuple[str, list[str]]] = [
    ("paypal", ["paypal.com"]),
    ("chase", ["chase.com"]),
    ("wellsfargo", ["wellsfargo.com"]),
    ("citibank", ["citibank.com", "citi.com"]),
    ("microsoft", ["microsoft.com", "live.com", "outlook.com"]),
    ("apple", ["apple.com", "icloud.com"]),
    ("google", ["google.com", "gmail.com"]),
    ("amazon", ["amazon.com", "amazonaws.com"]),
    ("netflix", ["netflix.com"]),
    ("facebook", ["facebook.com", "fb.com"]),
]

TRUNCATED = "\n[... truncated ...]"


def parse_eml(raw: Column | str) -> Column:
    """struct(headers array<struct<name,value>>, body) of a raw message.

    Header lines without a name are dropped before folded lines are joined to the header above
    them, so a fold after a broken line still belongs to the last good header.
    """
    text = F.replace(F.coalesce(as_col(raw), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    parts = F.split(text, "\n\n", 2)
    return let(parts, lambda p: F.struct(
        _headers(F.get(p, 0)).alias("headers"),
        F.coalesce(F.get(p, 1), F.lit("")).alias("body"),
    ))


def _headers(block: Column) -> Column:
    usable = F.filter(F.split(block, "\n"), lambda l: F.rlike(l, F.lit(r"^(?:[ \t]|[^:]+:)")))
    # A new header starts at a line break that is not followed by blank or tab.
    groups = F.filter(
        F.split(F.array_join(usable, "\n"), r"\n(?![ \t])"),
        lambda g: (g != "") & ~F.rlike(g, F.lit(r"^[ \t]")),
    )
    return F.transform(groups, _header)


def _header(group: Column) -> Column:
    return let(F.split(group, "\n"), lambda lines: let(
        F.instr(F.get(lines, 0), ":"),
        lambda colon: F.struct(
            strip(F.substr(F.get(lines, 0), F.lit(1), colon - 1)).alias("name"),
            F.array_join(
                F.concat(
                    F.array(strip(F.substr(F.get(lines, 0), colon + 1))),
                    F.transform(F.slice(lines, F.lit(2), F.size(lines)), strip),
                ),
                " ",
            ).alias("value"),
        ),
    ))


def header_values(headers: Column | str, name: str) -> Column:
    """All values of a header, in order; names compare without case."""
    hits = F.filter(as_col(headers), lambda h: F.lower(h["name"]) == name.lower())
    return F.transform(hits, lambda h: h["value"])


def header(headers: Column | str, name: str) -> Column:
    """First value of a header, null when it is absent."""
    return first_or_null(header_values(headers, name))


def auth_result(auth_header: Column, protocol: str) -> Column:
    """Lower-cased first result of one protocol in an Authentication-Results value, else null."""
    found = F.regexp_extract(auth_header, rf"(?iU)\b{protocol}=(\w+)", 1)
    return F.lower(F.nullif(found, F.lit("")))


def auth_results(headers: Column | str) -> Column:
    value = header(headers, "Authentication-Results")
    return F.struct(*[auth_result(value, p).alias(p) for p in AUTH_PROTOCOLS])


def auth_checks(auth: Column) -> Column:
    """One check entry per protocol from ``auth_results``."""
    entries = []
    for p in AUTH_PROTOCOLS:
        value = auth[p]
        entries.append(check(
            F.lit(f"auth_{p}"),
            F.when(value.isNull(), "not_present").when(value.isin(*AUTH_FAILURES), "fail").otherwise("pass"),
            F.when(value.isNull(), "No Authentication-Results entry.").otherwise(F.concat(F.lit(f"{p}="), value)),
        ))
    return F.array(*entries)


def auth_rules(auth: Column) -> Column:
    return compact_names(*[F.when(auth[p].isin(*AUTH_FAILURES), F.lit(f"{p}_fail")) for p in AUTH_PROTOCOLS])


def check(name: Column, result: Column, detail: Column) -> Column:
    return F.struct(name.alias("name"), result.alias("result"), detail.alias("detail"))


def combined_text(subject: Column | str, body: Column | str) -> Column:
    return F.concat(F.coalesce(as_col(subject), F.lit("")), F.lit(" "), as_col(body))


def keyword_rules(text: Column | str) -> Column:
    """Names of the keyword rules that match, in rule order, ignoring case."""
    lowered = F.lower(as_col(text))

    def fire(name: str, pattern: str) -> Column:
        guard = reduce(or_, [
            reduce(and_, [F.contains(lowered, F.lit(word)) for word in group]) for group in _GUARDS[name]
        ])
        return F.when(guard & F.rlike(lowered, F.lit("(?dU)" + fast_rule(pattern))), F.lit(name))

    return compact_names(*[fire(n, p) for n, p in PHISHING_RULES])


def has_ip_url(text: Column | str) -> Column:
    col = as_col(text)
    return F.contains(col, F.lit("://")) & F.rlike(col, F.lit(network.IP_URL))


def sender_address(from_header: Column | str) -> Column:
    """First e-mail address in a From value, else null."""
    return F.nullif(F.regexp_extract(as_col(from_header), network.FAST_EMAIL, 2), F.lit(""))


def sender_domain(address: Column | str) -> Column:
    return F.lower(F.substring_index(as_col(address), "@", -1))


def header_ips(headers: Column | str) -> Column:
    """Distinct addresses of all Received values, then of X-Originating-IP."""
    values = F.concat(header_values(headers, "Received"), header_values(headers, "X-Originating-IP"))
    return F.array_distinct(F.flatten(F.transform(values, network.all_ips)))


def is_suspicious_domain(domain: Column) -> Column:
    return F.rlike(F.lower(domain), F.lit("(?dU)" + "|".join(f"(?:{p})" for p in SUSPICIOUS_DOMAINS)))


def suspicious_domain_rules(domains: Column | str, sender: Column | str) -> Column:
    """``suspicious_domain:<d>`` for body domains, then for the sender domain.

    The sender is not deduplicated against the body: a domain in both is reported, and scored, twice.
    """
    candidates = F.concat(as_col(domains), compact(as_col(sender)))
    return F.transform(
        F.filter(candidates, is_suspicious_domain),
        lambda d: F.concat(F.lit("suspicious_domain:"), d),
    )


def unleet(domain: Column) -> Column:
    """Undo common look-alike spelling: 0 1 3 5 7 @ $ and vv."""
    return F.replace(F.translate(F.lower(domain), "01357@$", "olestas"), F.lit("vv"), F.lit("w"))


def lookalike_brand(domain: Column | str) -> Column:
    """The brand a domain imitates without belonging to it, else null."""
    name = as_col(domain)
    plain, folded = F.lower(name), unleet(name)
    tests = []
    for brand, official in BRANDS:
        owned = plain.isin(*official)
        for o in official:
            owned = owned | F.endswith(plain, F.lit("." + o))
        tests.append(F.when(F.contains(folded, F.lit(brand)) & ~owned, F.lit(brand)))
    return F.coalesce(*tests)


def email_risk_score(
    n_rules: Column, n_urls: Column, n_ips: Column, n_header_ips: Column, ip_url: Column, bad_domain: Column
) -> Column:
    """Points per finding, each group capped, the total capped at 100."""
    return F.least(
        F.lit(100),
        F.least(n_rules * 8, F.lit(30))
        + F.least(n_urls * 3, F.lit(10))
        + F.least(n_ips * 3, F.lit(10))
        + F.least(n_header_ips * 3, F.lit(10))
        + F.when(ip_url, 15).otherwise(0)
        + F.when(bad_domain, 20).otherwise(0),
    )


def parsed_email(headers: Column | str, body: Column | str, body_limit: int | None = None) -> Column:
    """Compact view of a message for a prompt or for storage; the whole body unless the caller sets a limit."""
    return F.struct(
        header(headers, "From").alias("sender"),
        header(headers, "Subject").alias("subject"),
        truncate(body, body_limit, TRUNCATED).alias("bodyText"),
        header_values(headers, "Received").alias("receivedChain"),
        header_ips(headers).alias("headerIps"),
        F.struct(
            header(headers, "Message-ID").alias("messageId"),
            header(headers, "Date").alias("date"),
            header(headers, "Content-Type").alias("contentType"),
            header(headers, "Authentication-Results").alias("authenticationResults"),
        ).alias("metadata"),
    )


def tool_output_json(headers: Column | str, body: Column | str, payload: Column | str) -> Column:
    """Parsed message and network entities as one JSON text; absent values are written as null."""
    keep = {"ignoreNullFields": "false"}
    return F.to_json(
        F.struct(
            parsed_email(headers, body).alias("parse_eml"),
            network.network_entities(payload).alias("extract_network_entities"),
        ),
        keep,
    )
