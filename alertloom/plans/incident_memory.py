"""What earlier incidents teach a new one: their texts are stored as vectors, and new jobs get the nearest ones.

The vectoriser is fitted on the index texts of the first batch that has reports and kept under its version; the index is
created with it. A batch that is replayed replaces its vectors, and a batch never finds its own. To fit anew, start a
further version: it has its own weights and its own index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incident_vectors, similarity
from ..operators.similar_index import CELLS, TOP_K, SimilarIndex
from ..schemas import REPORT
from ..session import materialize
from ..sources import sinks
from .triage import TIER1

SIMILAR = (
    "array<struct<report_id:string,risk_score:double,severity:string,matched_rules:array<string>,"
    "excerpt:string,similarity:double>>"
)
EMBEDDING = "job_id string, version string, embedding array<float>, created_at timestamp"


def index_texts(reports: DataFrame, iocs: DataFrame) -> DataFrame:
    """(job_id, text) that is stored for a report: its summary and the values of its indicators."""
    values = iocs.groupBy("job_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "type", "value"))), lambda i: i["value"]).alias("values"))
    empty = F.array().cast("array<string>")
    return reports.select("job_id", "summary").join(values, "job_id", "left").select(
        "job_id", similarity.index_text(F.col("summary"), F.coalesce("values", empty)).alias("text"))


def retrieval_texts(pending: DataFrame, iocs: DataFrame, analyses: DataFrame | None = None) -> DataFrame:
    """(job_id, text) that a suspicious job asks with: the summary of its mail, its rules and its indicators."""
    values = iocs.groupBy("job_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "type", "value"))), lambda i: i["value"]).alias("values"))
    out = pending.select("job_id", "matched_rules").join(values, "job_id", "left")
    summary = F.lit(" ")
    if analyses is not None:
        out = out.join(analyses.select("job_id", F.col("analysis.summary").alias("note")), "job_id", "left")
        summary = F.coalesce("note", F.lit(" "))
    empty = F.array().cast("array<string>")
    return out.select("job_id", similarity.retrieval_text(
        F.coalesce("matched_rules", empty), F.coalesce("values", empty), summary).alias("text"))


class IncidentMemory:
    def __init__(self, spark: SparkSession, root: str, version: str = "1", dims: int = incident_vectors.DIMS,
                 cells: int = CELLS, k: int = TOP_K, excerpt: int | None = None):
        self.spark, self.root, self.version = spark, root.rstrip("/"), version
        self.dims, self.cells, self.k, self.excerpt = dims, cells, k, excerpt
        self.models = f"{self.root}/vectoriser"
        self.index = SimilarIndex(spark, f"{self.root}/incident_index/version={version}")

    def similar(self, batch_id: int | str) -> Callable[..., DataFrame]:
        """A function (pending, iocs, analyses) -> (job_id, similar) over the incidents of other batches."""

        def find(pending: DataFrame, iocs: DataFrame, analyses: DataFrame | None) -> DataFrame:
            model = incident_vectors.load(self.spark, self.models, self.version)
            if model is None:
                return self.spark.createDataFrame([], f"job_id string, similar {SIMILAR}")
            texts = retrieval_texts(pending, iocs, analyses)
            asked = model.vectors(texts, "job_id").select(
                F.col("job_id").alias("query_id"), F.col("job_id").alias("owner"), "embedding")
            # k rows per job of the batch.
            found = materialize(self.index.search(asked, self.k, batch_id), "similar-found")
            reports = sinks.read_other_batches(self.spark, self.root, "reports", REPORT, batch_id)
            tier1 = sinks.read_other_batches(self.spark, self.root, "tier1_results", TIER1, batch_id)
            wanted = found.select(F.col("id").alias("job_id")).distinct()
            told = similarity.attach_reports(
                found, reports.join(wanted, "job_id", "left_semi").withColumn("report_id", F.col("job_id")),
                tier1.join(wanted, "job_id", "left_semi"), self.excerpt)
            fields = F.struct(F.col("id").alias("report_id"), "risk_score", "severity", "matched_rules", "excerpt", "similarity")
            return told.groupBy(F.col("query_id").alias("job_id")).agg(F.transform(
                F.array_sort(F.collect_list(F.struct("rn", fields.alias("s")))), lambda x: x["s"]).cast(SIMILAR).alias("similar"))

        return find

    def remember(self, reports: DataFrame, iocs: DataFrame, batch_id: int | str) -> None:
        """Store the reports of a batch as vectors, in the result table and in the index."""
        texts = materialize(index_texts(reports, iocs), "memory-texts")
        model = incident_vectors.load(self.spark, self.models, self.version)
        if model is None:
            if texts.isEmpty():
                return
            model = incident_vectors.fit(texts, dims=self.dims, version=self.version)
            model.save(self.spark, self.models)
        rows = model.vectors(texts, "job_id").join(reports.select("job_id", "created_at"), "job_id")
        sinks.write_batch(rows.select(
            "job_id", F.lit(self.version).alias("version"), F.col("embedding").cast("array<float>").alias("embedding"),
            "created_at"), self.root, "incident_embeddings", batch_id)
        stored = self.spark.read.schema(EMBEDDING).parquet(
            f"{sinks.table_path(self.root, 'incident_embeddings')}/batch_id={batch_id}"
        ).select(F.col("job_id").alias("id"), F.col("job_id").alias("owner"), "embedding")
        if self.index.centres() is None and not self.index.create(stored, self.cells):
            return
        self.index.append(stored, batch_id)
