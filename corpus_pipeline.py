"""Corpus preparation in five stages, each a Spark job over all documents that its predecessor kept.

language_id    drops texts in which no language is recognised: null, without a letter, or of very low confidence
near_dedup     keeps one document, the smallest doc_id, of each group of near-duplicates (five words, 0.8)
substring_dedup removes passages that occur earlier; documents of which nothing is left go
mixing         samples documents by raked weights of source, language and topic
bpe            appends token ids and the text decoded from them

Every function takes (spark, docs, sf_dir); all but the last return the columns of documents. Null doc_ids and repeated
rows are handled as the operators state it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm import bpe, langid, mixing, neardup, substrings
from alertloom.llm.common import lookup, small_batches, table
from alertloom.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Below this score no language is recognised; the shares of four languages are at least a quarter.
LEAST_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from two thirds of the documents; a missing language is set to the predicted one."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    out = langid.predict(docs, langid.fit(docs.where(~langid.held_out())), score_col="lang_score")
    return out.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE)).select(
        "doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows of the smallest doc_id of each group; only the ids that go are joined to the texts."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    gone = materialize(
        neardup.near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id").distinct(), "pipeline-gone")
    marked = lookup(docs, gone.withColumn("_gone", F.lit(True)), ["doc_id"], F.col("doc_id"))
    return marked.where(F.col("_gone").isNull()).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a repeated passage stay as they are; the others are their remaining words."""
    small_batches(spark)
    out = substrings.remove_repeats(docs.select(*COLUMNS), width=20)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.where("n_removed = 0 or n_removed < n_words").select(
        "doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs.select(*COLUMNS), budget=0.7, alpha=0.7).where("selected").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.encode(
        docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json"), ids_col="token_ids", decoded_col="decoded"
    ).withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mix),
    ("bpe", encode),
]
#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
