"""Indicators of compromise: extraction, first-seen deduplication, idempotent seeding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact, is_blank, nonblank

_ITEM = "array<struct<type:string,value:string>>"


def _tagged(values: Column, kind: str) -> Column:
    return F.transform(
        nonblank(F.coalesce(values, F.array().cast("array<string>"))),
        lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")),
    )


def candidate_array(urls: Column, domains: Column, ips: Column, header_ips: Column,
                    unique_ips: Column, sender: Column) -> Column:
    """Candidates in a fixed order: URLs, domains, addresses of all three kinds, sender."""
    return F.concat(
        _tagged(urls, "Url"), _tagged(domains, "Domain"), _tagged(ips, "Ip"),
        _tagged(header_ips, "Ip"), _tagged(unique_ips, "Ip"),
        F.transform(
            compact(F.nullif(sender, F.lit(""))),
            lambda v: F.struct(F.lit("Email").alias("type"), v.alias("value")),
        ),
    )


def extracted_candidates(reports: DataFrame, job_id: str = "artifact_id") -> DataFrame:
    """(job_id, pos, type, value) from the ``extracted`` struct of rule reports."""
    have = set(reports.schema["extracted"].dataType.names)
    none = F.lit(None).cast("array<string>")
    pick = lambda name: F.col(f"extracted.{name}") if name in have else none
    items = candidate_array(
        pick("urls"), pick("domains"), pick("ips"), pick("header_ips"), pick("unique_ips"),
        F.col("extracted.sender") if "sender" in have else F.lit(None).cast("string"),
    )
    return reports.select(F.col(job_id).alias("job_id"), F.posexplode(items).alias("pos", "item")).select(
        "job_id", "pos", "item.type", "item.value"
    )


def candidates_from_json(reports: DataFrame, extracted_json: str, job_id: str = "job_id") -> DataFrame:
    """The same from the stored JSON text; values that are not text lists are ignored."""
    v = F.try_parse_json(F.col(extracted_json))

    def texts(name: str) -> Column:
        entries = F.try_variant_get(v, f"$.{name}", "array<variant>")
        return F.array_compact(F.transform(entries, lambda e: F.when(
            F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string"))))

    sender = F.when(
        F.schema_of_variant(F.try_variant_get(v, "$.sender", "variant")) == "STRING",
        F.try_variant_get(v, "$.sender", "string"),
    )
    items = candidate_array(
        texts("urls"), texts("domains"), texts("ips"), texts("headerIps"), texts("uniqueIps"), sender
    )
    return reports.select(F.col(job_id).alias("job_id"), F.posexplode(items).alias("pos", "item")).select(
        "job_id", "pos", "item.type", "item.value"
    )


def first_spelling(candidates: DataFrame) -> DataFrame:
    """One row per (job, type, value ignoring case): the spelling with the least ``pos``.

    ``min_by`` combines before the shuffle, so a value repeated many times costs one row per task.
    """
    return candidates.groupBy("job_id", "type", F.lower("value").alias("folded")).agg(
        F.min_by("value", "pos").alias("value"), F.min("pos").alias("pos")
    ).drop("folded")


def seed(candidates: DataFrame, existing: DataFrame, extracted_by: str = "Rule") -> DataFrame:
    """Indicators not known yet for their job; a second run adds nothing."""
    fresh = first_spelling(candidates).withColumn("folded", F.lower("value"))
    known = existing.select("job_id", "type", F.lower("value").alias("folded"))
    return fresh.join(known, ["job_id", "type", "folded"], "left_anti").select(
        "job_id", "type", "value", F.lit(extracted_by).alias("extracted_by"), "pos"
    )


def merge_model_iocs(rule_iocs: DataFrame, model_iocs: DataFrame) -> DataFrame:
    """Rule indicators plus those only the model reported; rules take precedence."""
    ranked = rule_iocs.select("job_id", "type", "value", F.lit(0).alias("prio"), "pos").unionByName(
        model_iocs.select("job_id", "type", "value", F.lit(1).alias("prio"), "pos")
    )
    # struct order is (priority, position): the least wins.
    return ranked.groupBy("job_id", "type", F.lower("value").alias("folded")).agg(
        F.min(F.struct("prio", "pos", "value")).alias("best")
    ).select(
        "job_id", "type", F.col("best.value").alias("value"),
        F.when(F.col("best.prio") == 0, "Rule").otherwise("Llm").alias("extracted_by"),
        F.col("best.pos").alias("pos"),
    )


def analysis_iocs(analyses: DataFrame) -> DataFrame:
    """(job_id, pos, type, value) from parsed e-mail analyses (job_id, analysis)."""
    return analyses.select(
        "job_id", F.posexplode(F.coalesce("analysis.iocs", F.array().cast(_ITEM))).alias("pos", "item")
    ).select("job_id", "pos", "item.type", "item.value").filter(~is_blank("value"))
