"""The text functions for SQL users, as SQL functions: the optimizer sees through them like through any expression."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import network, pii
from .text import WHITESPACE


def _raw(text: str) -> str:
    """A raw SQL literal: no escapes are read inside it."""
    quote = '"' if '"' not in text else "'"
    if quote in text:  # both quotes occur: join pieces that hold one kind each
        parts = text.split("'")
        return "concat(" + ", \"'\", ".join(f"r'{p}'" for p in parts) + ")"
    return f"r{quote}{text}{quote}"


def _scrub_sql() -> str:
    out = "coalesce(text, '')"
    for _, pattern, replacement in pii.RULES:
        out = f"regexp_replace({out}, {_raw(pattern)}, {_raw(replacement)})"
    return out


def _strip(expression: str) -> str:
    """Without Unicode white space on both sides."""
    signs = "".join(f"\\u{ord(c):04x}" for c in WHITESPACE)
    return f"trim(BOTH '{signs}' FROM {expression})"


def _message_sql() -> str:
    """struct(headers, body) of a raw mail; broken header lines are dropped before folded ones are joined."""
    text = r"replace(coalesce(raw, ''), '\r\n', '\n')"
    usable = rf"filter(split(get(split({text}, '\n\n', 2), 0), '\n'), l -> l rlike r'^(?:[ \t]|[^:]+:)')"
    groups = rf"filter(split(array_join({usable}, '\n'), r'\n(?![ \t])'), g -> g <> '' AND NOT (g rlike r'^[ \t]'))"
    value = rf"array_join(transform(split(substr(g, instr(g, ':') + 1), '\n'), x -> {_strip('x')}), ' ')"
    headers = f"transform({groups}, g -> named_struct('name', {_strip("substring_index(g, ':', 1)")}, 'value', {value}))"
    return rf"named_struct('headers', {headers}, 'body', coalesce(get(split({text}, '\n\n', 2), 1), ''))"


def _parse_eml_sql() -> str:
    values = lambda name: f"transform(filter(m.headers, h -> lower(h.name) = '{name.lower()}'), h -> h.value)"
    first = lambda name: f"try_element_at({values(name)}, 1)"
    ips = (
        f"array_distinct(flatten(transform(concat({values('Received')}, {values('X-Originating-IP')}), "
        f"v -> regexp_extract_all(v, {_raw(network.IPV4)}, 0))))"
    )
    metadata = ", ".join(f"'{key}', {first(name)}" for key, name in (
        ("messageId", "Message-ID"), ("date", "Date"), ("contentType", "Content-Type"),
        ("authenticationResults", "Authentication-Results")))
    return (
        # The parsed message is bound once; a subquery here could not be planned beside a table.
        f"element_at(transform(array(eml_message(raw)), m -> named_struct('sender', {first('From')}, 'subject', {first('Subject')}, 'bodyText', m.body, "
        f"'receivedChain', {values('Received')}, 'headerIps', {ips}, 'metadata', named_struct({metadata}))), 1)"
    )


def _entities_sql() -> str:
    """Rows (kind, pos, value): URLs and domains distinct ignoring case, addresses distinct, as the analyst sees them."""
    heads = lambda tagged: f"filter({tagged}, (e, i) -> i = 0 OR get({tagged}, i - 1).k <> e.k)"
    host = f"lower(regexp_extract(u, {_raw(network.URL_HOST)}, 1))"
    return f"""
      SELECT e.kind, CAST(e.pos AS INT) AS pos, e.value FROM (
        SELECT explode(concat(
          transform(array_sort(transform({heads('url_tags')}, e -> named_struct('i', e.i, 'v', e.v))),
            (e, i) -> named_struct('kind', 'url', 'pos', i, 'value', e.v)),
          transform({heads('name_tags')}, (e, i) -> named_struct('kind', 'domain', 'pos', i, 'value', e.v)),
          transform(ips, (v, i) -> named_struct('kind', 'ip', 'pos', i, 'value', v)))) AS e
        FROM (
          SELECT ips, array_sort(transform(urls, (v, i) -> named_struct('k', lower(v), 'i', i, 'v', v))) AS url_tags,
            array_sort(transform(concat(filter(transform(urls, u -> {host}), h -> h <> ''), names),
              (v, i) -> named_struct('k', upper(v), 'i', i, 'v', v))) AS name_tags
          FROM (SELECT regexp_extract_all(text, {_raw(network.URL)}, 0) AS urls,
            regexp_extract_all(text, {_raw(network.FAST_DOMAIN)}, 0) AS names,
            array_distinct(regexp_extract_all(text, {_raw(network.IPV4)}, 0)) AS ips)))"""


def register(spark: SparkSession) -> list[str]:
    """Create the temporary functions of the session and return their names."""
    host = f"lower(regexp_extract(url, {_raw(network.URL_HOST)}, 1))"
    all_of = lambda pattern: f"array_distinct(regexp_extract_all(text, {_raw(pattern)}, 0))"
    bodies = {
        "scrub_pii(text STRING) RETURNS STRING": _scrub_sql(),
        "url_host(url STRING) RETURNS STRING": f"if({host} <> '', {host}, url)",
        "extract_urls(text STRING) RETURNS ARRAY<STRING>": all_of(network.URL),
        "extract_ips(text STRING) RETURNS ARRAY<STRING>": all_of(network.IPV4),
        "extract_domains(text STRING) RETURNS ARRAY<STRING>": all_of(network.FAST_DOMAIN),
        "severity_band(score DOUBLE) RETURNS STRING":
            "CASE WHEN score < 2.5 THEN 'Low' WHEN score < 5.0 THEN 'Medium' WHEN score < 7.5 THEN 'High' ELSE 'Critical' END",
    }
    message = "STRUCT<headers: ARRAY<STRUCT<name: STRING, value: STRING>>, body: STRING>"
    parsed = (
        "STRUCT<sender: STRING, subject: STRING, bodyText: STRING, receivedChain: ARRAY<STRING>, headerIps: ARRAY<STRING>, "
        "metadata: STRUCT<messageId: STRING, date: STRING, contentType: STRING, authenticationResults: STRING>>"
    )
    bodies |= {
        f"eml_message(raw STRING) RETURNS {message}": _message_sql(),
        f"parse_eml(raw STRING) RETURNS {parsed}": _parse_eml_sql(),
        "extract_network_entities(text STRING) RETURNS TABLE(kind STRING, pos INT, value STRING)": _entities_sql(),
    }
    for signature, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in bodies]
