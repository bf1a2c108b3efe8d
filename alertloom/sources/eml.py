"""Mail messages as rows of headers and body."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.email import parse_eml


def parse_messages(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, raw, ...) to (artifact_id, headers, body, ...)."""
    return artifacts.withColumn("message", parse_eml("raw")).select(
        *[c for c in artifacts.columns if c != "raw"],
        F.col("message.headers").alias("headers"),
        F.col("message.body").alias("body"),
    )
