"""Phishing text classifier with Spark ML, and agreement with a baseline."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.email import check
from ..functions.scoring import ML_THRESHOLD
from ..functions.text import truncate


def classifier_text(subject: Column, body: Column, limit: int | None = None) -> Column:
    """Classifier input of a scrubbed message: its whole body, or as many characters as a caller's model reads."""
    return F.concat(F.coalesce(subject, F.lit("")), F.lit(" [SEP] "), truncate(body, limit))


def train(labelled: DataFrame, features: int = 1 << 14, iterations: int = 15) -> PipelineModel:
    """Fit on (text, label double)."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}]+", minTokenLength=2),
        HashingTF(inputCol="words", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="features", minDocFreq=1),
        LogisticRegression(maxIter=iterations, regParam=0.01, standardization=True),
    ]).fit(labelled)


def score(model: PipelineModel, texts: DataFrame) -> DataFrame:
    """Add ``ml_score``, the probability of the phishing class."""
    out = model.transform(texts).withColumn("ml_score", F.element_at(vector_to_array("probability"), 2))
    return out.select(*texts.columns, "ml_score")


def score_with(texts: DataFrame, predict: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Score with a caller's own model, in Arrow batches; ``predict`` maps texts to probabilities."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(ml_score=predict(pdf["text"]).astype("float64"))

    return texts.mapInPandas(run, fields + ", ml_score double")


def ml_check(ml_score: Column, threshold: float = ML_THRESHOLD) -> Column:
    """Check entry of a score; a null score means that scoring is off."""
    return F.when(ml_score.isNull(), check(
        F.lit("ml_phishing"), F.lit("skipped"), F.lit("ML scoring disabled.")
    )).otherwise(check(
        F.lit("ml_phishing"),
        F.when(ml_score >= threshold, "flag").otherwise("pass"),
        F.format_string(f"phishing probability %.3f (threshold {threshold:.2f}).", ml_score),
    ))


def agreement(scores: DataFrame, threshold: float = ML_THRESHOLD, tolerance: float = 0.01) -> DataFrame:
    """One row of agreement figures for (score, baseline)."""
    flag, base = F.col("score") >= threshold, F.col("baseline") >= threshold
    delta = F.abs(F.col("score") - F.col("baseline"))
    n = F.count("*")
    return scores.agg(
        n.alias("n"),
        F.count_if(flag == base).alias("same_verdict"),
        F.count_if(delta <= tolerance).alias("within_tolerance"),
        F.count_if(flag & base).alias("both_flagged"),
        F.count_if(flag & ~base).alias("only_score"),
        F.count_if(~flag & base).alias("only_baseline"),
        F.count_if(~flag & ~base).alias("neither"),
        F.max(delta).alias("max_delta"),
    )
