"""Artifact files: reading, intake checks, and the branch for types without checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.email import check
from ..functions.text import as_col

BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
MAX_BYTES = 10 * 1024 * 1024
SNIFF_BYTES = 4096

# Leading bytes, in hex, of executables, archives and PDF.
DANGEROUS_SIGNATURES = [
    "4D5A",      # Windows executable
    "7F454C46",  # ELF
    "504B0304",  # ZIP
    "FEEDFACE",  # Mach-O
    "FEEDFACF",
    "CEFAEDFE",
    "CFFAEDFE",
    "25504446",  # PDF
]


def file_extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(as_col(path), r"\.[^./\\]+$", 0))


def artifact_type(extension: Column) -> Column:
    return (
        F.when(extension == ".eml", "Eml").when(extension == ".csv", "Csv").when(extension == ".json", "Json")
    )


def describe(files: DataFrame) -> DataFrame:
    """Add id, file name and type to rows of a ``binaryFile`` source, batch or streaming."""
    extension = file_extension("path")
    return files.select(
        F.sha2(F.col("path"), 256).alias("artifact_id"),
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        extension.alias("extension"),
        artifact_type(extension).alias("file_type"),
        "path",
        F.col("modificationTime").alias("created_at"),
        "length",
        "content",
    )


def read_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """All artifact files below a folder. Files are read by executors, one row per file."""
    return describe(
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    )


def reject_reason(extension: Column, length: Column, content: Column) -> Column:
    """Why an artifact is refused, null when it is accepted. Looks at the first 4096 bytes only."""
    sample = F.substring(content, 1, SNIFF_BYTES)
    head = F.hex(F.substring(content, 1, 4))
    dangerous = F.lit(False)
    for signature in DANGEROUS_SIGNATURES:
        dangerous = dangerous | F.startswith(head, F.lit(signature))
    text = F.decode(sample, "ISO-8859-1")
    first_visible = F.substring(F.ltrim(text, F.lit(" \t\r\n")), 1, 1)
    first_line = F.regexp_extract(text, r"(?d)\A(.+)", 1)
    first_line = F.when(F.startswith(text, F.lit("\n")), text).otherwise(first_line)
    kind = artifact_type(extension)
    return (
        F.when(length == 0, "empty_file")
        .when(length > MAX_BYTES, "too_large")
        .when(kind.isNull(), "unsupported_type")
        .when(dangerous, "executable_or_archive")
        .when(F.instr(text, "\x00") > 0, "binary_data")
        .when((kind == "Json") & (first_visible == ""), "empty_file")
        .when((kind == "Json") & ~first_visible.isin("{", "["), "not_json")
        .when((kind == "Eml") & ~F.contains(first_line, F.lit(": ")), "no_email_headers")
    )


def with_reject_reason(artifacts: DataFrame) -> DataFrame:
    return artifacts.withColumn(
        "reject_reason", reject_reason(F.col("extension"), F.col("length"), F.col("content"))
    )


def split_intake(artifacts: DataFrame, keep_content: bool = True) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined). Quarantined rows keep their reason, and their content unless the caller drops it."""
    checked = with_reject_reason(artifacts)
    refused = checked.filter(F.col("reject_reason").isNotNull())
    return (
        checked.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        refused if keep_content else refused.drop("content"),
    )


def as_text(artifacts: DataFrame) -> DataFrame:
    """Decode the content as UTF-8 text into ``raw``; a byte-order mark is dropped.

    Bytes that are no UTF-8 become replacement characters, so one mail in another encoding stops nothing.
    """
    whole = F.make_valid_utf8(F.coalesce(F.col("content"), F.lit(b"")).cast("string"))
    raw = F.regexp_replace(whole, "\\A\ufeff", "")
    return artifacts.withColumn("raw", raw).drop("content")


def read_error(content: Column | str, length: Column | str) -> Column:
    """Why an accepted artifact cannot be worked on, null when it can: one bad file is one failed job, not a failed batch."""
    c, n = as_col(content), as_col(length)
    return (
        F.when(c.isNull(), "The content could not be read.")
        .when(F.octet_length(c) < n, F.format_string("The content broke off after %d of %d bytes.", F.octet_length(c), n))
        .when((n > 0) & ~F.rlike(F.make_valid_utf8(c.cast("string")), F.lit(r"[\p{L}\p{N}]")), "The content has no readable text.")
    )


def unsupported_reports(artifacts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rule reports of types without checks: escalated rather than dropped."""
    kind = F.col("file_type")
    return artifacts.select(
        "artifact_id", *(keep or []),
        F.array(F.lit("unsupported_artifact_escalated")).alias("matched_rules"),
        F.array(check(
            F.lit("artifact_type"), F.lit("info"),
            F.concat(F.lit("No Tier 1 rule checks for "), kind, F.lit(" artifacts; escalated by default.")),
        )).alias("checks"),
        F.lit(0).alias("risk_score"),
        F.lit("Suspicious").alias("verdict"),
    )
