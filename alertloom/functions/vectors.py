"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col, let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(
        a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    ))


def cosine(a: Column | str, b: Column | str) -> Column:
    x, y = as_col(a), as_col(b)
    return dot(x, y) / (norm(x) * norm(y))


def normalize(a: Column | str) -> Column:
    """Unit-length vector; the zero vector stays as it is."""
    return let(
        F.struct(as_col(a).alias("v"), norm(as_col(a)).alias("n")),
        lambda s: F.transform(
            s["v"], lambda x: F.when(s["n"] > 0, x.cast("double") / s["n"]).otherwise(x.cast("double"))
        ),
    )


def softmax_probability(logits: Column | str, index: int = 1) -> Column:
    """Probability of one class, shifted by the maximum so that exp cannot overflow."""
    def body(s: Column) -> Column:
        total = F.aggregate(s["v"], F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - s["m"]))
        return F.exp(F.element_at(s["v"], index + 1).cast("double") - s["m"]) / total

    v = as_col(logits)
    return let(F.struct(v.alias("v"), F.array_max(v).cast("double").alias("m")), body)
