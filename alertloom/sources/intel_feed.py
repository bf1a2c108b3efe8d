"""Answers of the reputation services as a table, one row per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_col, clamp, let

VT, ABUSE = "VirusTotal", "AbuseIpDb"


def _outcome(success: Column, score: Column, raw: Column, reason: Column) -> Column:
    return F.struct(
        success.alias("success"), score.cast("double").alias("score"), raw.alias("raw"), reason.alias("reason")
    )


def _fail(reason: Column | str) -> Column:
    text = F.lit(reason) if isinstance(reason, str) else reason
    return _outcome(F.lit(False), F.lit(None), F.lit(None).cast("string"), text)


def _http_ok(status: Column) -> Column:
    return status.between(200, 299)


def vt_outcome(value: Column | str, status: Column | str, body: Column | str) -> Column:
    """struct(success, score, raw, reason) of one file-reputation answer.

    "Bad request" and "not found" are definite answers and score 0.
    """
    value, status, body = as_col(value), as_col(status), as_col(body)
    known = _outcome(
        F.lit(True), F.lit(0.0),
        F.to_json(F.struct(
            F.lit(VT).alias("source"), value.alias("ioc"),
            F.lit("not_found_in_virustotal").alias("note"), status.alias("http_status"),
        )),
        F.lit(None).cast("string"),
    )

    def parsed(v: Column) -> Column:
        stats = F.try_variant_get(v, "$.data.attributes.last_analysis_stats", "map<string,variant>")
        counts = F.transform_values(stats, lambda k, n: F.coalesce(
            F.when(F.schema_of_variant(n) == "BIGINT", F.try_variant_get(n, "$", "bigint")), F.lit(0).cast("bigint")
        ))
        return let(counts, lambda c: let(
            F.aggregate(F.map_values(c), F.lit(0).cast("bigint"), lambda a, n: a + n),
            lambda total: F.when(v.isNull(), _fail("malformed_response"))
            .when(c.isNull(), _fail("missing_last_analysis_stats"))
            .otherwise(_outcome(
                F.lit(True),
                F.when(total > 0, F.coalesce(F.try_element_at(c, F.lit("malicious")), F.lit(0)).cast("double") / total)
                .otherwise(0.0),
                body, F.lit(None).cast("string"),
            )),
        ))

    return (
        F.when(status.isNull(), _fail("timeout"))
        .when(status.isin(400, 404), known)
        .when(~_http_ok(status), _fail(F.concat(F.lit("http_"), status.cast("string"))))
        .otherwise(let(F.try_parse_json(body), parsed))
    )


def abuse_outcome(type_col: Column | str, status: Column | str, body: Column | str) -> Column:
    """struct(success, score, raw, reason) of one address-reputation answer."""
    kind, status, body = as_col(type_col), as_col(status), as_col(body)

    def parsed(v: Column) -> Column:
        confidence = F.try_variant_get(v, "$.data.abuseConfidenceScore", "variant")
        number = F.when(
            F.schema_of_variant(confidence) == "BIGINT", F.try_variant_get(confidence, "$", "int")
        )
        return (
            F.when(v.isNull(), _fail("malformed_response"))
            .when(number.isNull(), _fail("missing_abuse_confidence_score"))
            .otherwise(_outcome(
                F.lit(True), clamp(number / F.lit(100.0), 0.0, 1.0), body, F.lit(None).cast("string")
            ))
        )

    return (
        F.when(kind != "Ip", _fail(F.concat(F.lit("unsupported_ioc_type:"), kind)))
        .when(status.isNull(), _fail("timeout"))
        .when(~_http_ok(status), _fail(F.concat(F.lit("http_"), status.cast("string"))))
        .otherwise(let(F.try_parse_json(body), parsed))
    )


def feed_outcome() -> Column:
    """Outcome of a row of the feed table, by its ``source``."""
    return F.when(F.col("source") == VT, vt_outcome("value", "http_status", "body")).otherwise(
        abuse_outcome("type", "http_status", "body")
    )


def parse_feed(feed: DataFrame) -> DataFrame:
    """(source, type, value, http_status, body, fetched_at) plus success, score, raw, reason."""
    return feed.withColumn("outcome", feed_outcome()).select(
        "source", "type", "value", "fetched_at",
        "outcome.success", "outcome.score", "outcome.raw", "outcome.reason",
    )
