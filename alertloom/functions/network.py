"""URLs, host names and addresses found in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col, distinct_ignore_case, let, sorted_set_ignore_case

# Patterns of the network entities.
URL = r"""(?iU)https?://[^\s"'<>\]\)]+"""
IPV4 = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"
DOMAIN = r"(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}"
EMAIL = r"(?U)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
# The same hits, found faster: a label of 63 characters at most must be followed by a dot and a letter or digit, which
# one look ahead decides without trying every shorter label; so the last word of a sentence is no candidate. A name has
# 127 labels at most; without that bound the matcher's stack grows with a hostile text.
FAST_DOMAIN = r"(?=[a-zA-Z0-9\-]{1,63}+\.[a-zA-Z0-9])" + DOMAIN.replace(r"\.)+", r"\.){1,127}")
# The same hits of EMAIL in linear time. All word boundaries of a run of name characters share the sign behind the run
# and what follows it, so only the first boundary of a run needs a try: at the beginning of the run or where the last
# hit ended. The sign is looked for before any boundary. Group 1 is what precedes the boundary, group 2 the address.
FAST_EMAIL = (
    r"(?U)(?:(?<![A-Za-z0-9._%+\-])|\G)(?=[A-Za-z0-9._%+\-]++@)((?:(?!\b)[A-Za-z0-9._%+\-])*+)"
    r"(\b[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b)"
)
IP_URL = r"(?iU)https?://\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
URL_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"


def _all(col: Column | str, pattern: str, must_contain: str) -> Column:
    """All matches; rows without the literal every match contains skip the pattern."""
    text = as_col(col)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.contains(text, F.lit(must_contain)), found).otherwise(
        F.array().cast("array<string>")
    )


def all_urls(col: Column | str) -> Column:
    return _all(col, URL, "://")


def all_ips(col: Column | str) -> Column:
    return _all(col, IPV4, ".")


def all_domains(col: Column | str) -> Column:
    return _all(col, FAST_DOMAIN, ".")


def urls(col: Column | str) -> Column:
    """Distinct URLs, case-sensitive, first occurrence order."""
    return F.array_distinct(all_urls(col))


def ips(col: Column | str) -> Column:
    """Distinct dotted quads; octets are not range-checked."""
    return F.array_distinct(all_ips(col))


def domains(col: Column | str) -> Column:
    """Distinct host-like names; file names such as ``index.html`` are hits too."""
    return F.array_distinct(all_domains(col))


def url_host(col: Column | str) -> Column:
    """Lower-cased host of an absolute URL, else the input itself."""
    url = as_col(col)
    host = F.lower(F.regexp_extract(url, URL_HOST, 1))
    return F.when(host != "", host).otherwise(url)


def network_entities(col: Column | str) -> Column:
    """struct(urls, domains, ips): the analyst's view, folding case."""
    text = as_col(col)

    def build(found: Column) -> Column:
        hosts = F.filter(
            F.transform(found["urls"], lambda u: F.lower(F.regexp_extract(u, URL_HOST, 1))),
            lambda h: h != "",
        )
        return F.struct(
            distinct_ignore_case(found["urls"]).alias("urls"),
            sorted_set_ignore_case(F.concat(hosts, found["names"])).alias("domains"),
            found["ips"].alias("ips"),
        )

    return let(
        F.struct(all_urls(text).alias("urls"), all_domains(text).alias("names"), ips(text).alias("ips")), build
    )


def base64url(col: Column | str) -> Column:
    """URL-safe base64 without padding; Spark's line breaks every 76 characters are removed."""
    encoded = F.translate(F.base64(F.encode(as_col(col), "UTF-8")), "\r\n", "")
    return F.translate(F.rtrim(encoded, F.lit("=")), "+/", "-_")


def vt_lookup_path(type_col: Column | str, value_col: Column | str) -> Column:
    """Lookup path of an indicator in the file-reputation feed; null when it has none."""
    kind, value = as_col(type_col), as_col(value_col)
    # url_encode writes a space as "+"; percent encoding is wanted here, "~" stays as it is.
    escaped = F.replace(F.replace(F.replace(
        F.url_encode(value), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")),
        F.lit("*"), F.lit("%2A"))
    return (
        F.when(kind == "Ip", F.concat(F.lit("ip_addresses/"), escaped))
        .when(kind == "Domain", F.concat(F.lit("domains/"), escaped))
        .when(kind == "Url", F.concat(F.lit("urls/"), base64url(value)))
        .when(kind == "Hash", F.concat(F.lit("files/"), escaped))
    )
