"""Mixing sources to target weights by iterative proportional fitting.

The tokens of all documents are summed per cell, that is per combination of source, language and topic. Raking
scales the cells' masses in turn so that the totals of each dimension meet their targets, until they stop moving. No
cell gets more mass than it has tokens, so what full cells cannot take is spread over all others. A document is then
kept with the probability mass / tokens of its cell, decided by a hash of the document, so the expected tokens of
every source, language and topic are the raked ones and a repeated run keeps the same documents.

Targets are shares per value of a dimension: given by the caller, or the natural shares raised to ``alpha`` < 1, which
lifts what is rare. Only the table of cells is iterated on, never the documents. It is put into as few partitions as
its counted rows need; the scaling steps are window sums, which shuffle only if there is more than one.

Defined cases: a null source, language or text is a value of its own (``(none)``; null texts have no tokens). A cell
without tokens keeps its documents with the probability of the whole budget. Values without a given target keep no
mass if their dimension has targets. Repeated rows share one decision. An empty table gives an empty result. Columns of
the result's names are replaced, all others kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .common import lookup

DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"
CELLS_PER_PARTITION = 500_000
#: Scaling rounds over all dimensions in one job, and the most such jobs.
ROUNDS, JOBS = 6, 8
CLOSE = 1e-4


def words(text: Column) -> Column:
    """Number of words of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long")


def topic_of(text: Column) -> Column:
    """A plain topic by what a text contains."""
    return (
        F.when(text.isNull(), NONE)
        .when(text.contains(" | "), "table")
        .when(F.lower(text).rlike("licen[cs]e|copyright"), "legal")
        .when(text.contains("@"), "contact")
        .when(text.rlike(r"[{};=<>]"), "code")
        .otherwise("prose")
    )


def described(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns that raking looks at: _source, _lang, _topic, _tokens."""
    return docs.select(
        "*", F.coalesce(F.col("source"), F.lit(NONE)).alias("_source"), F.coalesce(F.col("lang"), F.lit(NONE)).alias("_lang"),
        topic_of(F.col(text_col)).alias("_topic"), words(F.col(text_col)).alias("_tokens"))


def rake(cells: DataFrame, budget: float, alpha: float, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(_source, _lang, _topic, tokens, mass) from rows (_source, _lang, _topic, tokens)."""
    keys = [f"_{d}" for d in DIMENSIONS]
    n = cells.count()
    state = cells.coalesce(max(1, -(-n // CELLS_PER_PARTITION)))
    total = F.sum("tokens").over(Window.partitionBy())
    state = state.withColumn("goal", total * budget).withColumn("mass", F.col("tokens") * budget)
    for d, key in zip(DIMENSIONS, keys):
        here = F.sum("tokens").over(Window.partitionBy(key))
        given = (targets or {}).get(d)
        if given:
            pairs = [F.lit(x) for item in given.items() for x in (item[0], float(item[1]))]
            share = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(key)), F.lit(0.0)) / sum(given.values())
        else:
            # Each value once in the sum over values: its share of the value's rows.
            rows = F.count("*").over(Window.partitionBy(key))
            state = state.withColumn("_lift", F.pow(here.cast("double"), F.lit(alpha))).withColumn("_rows", rows)
            share = F.col("_lift") / F.sum(F.col("_lift") / F.col("_rows")).over(Window.partitionBy())
        state = state.withColumn(f"want{key}", share * F.col("goal")).drop("_lift", "_rows")
    state = materialize(state, "mixing-cells").coalesce(max(1, -(-n // CELLS_PER_PARTITION)))
    for _ in range(JOBS):
        state = state.withColumn("before", F.col("mass"))
        for _ in range(ROUNDS):
            for key in keys:
                have = F.sum("mass").over(Window.partitionBy(key))
                state = state.withColumn("mass", F.least(
                    F.col("tokens").cast("double"),
                    F.when(have > 0, F.col("mass") * F.col(f"want{key}") / have).otherwise(F.col("mass"))))
            # What full cells could not take is spread over all others.
            have = F.sum("mass").over(Window.partitionBy())
            state = state.withColumn("mass", F.least(
                F.col("tokens").cast("double"),
                F.when(have > 0, F.col("mass") * F.col("goal") / have).otherwise(F.col("mass"))))
        state = materialize(state, "mixing-raked").coalesce(max(1, -(-n // CELLS_PER_PARTITION)))
        moved = state.agg(F.max(F.abs(F.col("mass") - F.col("before")) / F.greatest("tokens", F.lit(1)))).first()[0]
        if moved is None or moved < CLOSE:
            break
    return state.select(*keys, "tokens", "mass")


def mix(
    docs: DataFrame, budget: float = 0.7, alpha: float = 0.7, targets: dict[str, dict[str, float]] | None = None,
    seed: int = 1, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``docs`` with topic, n_tokens, token_weight, probability and selected.

    ``budget`` is the share of all tokens to keep. token_weight is the weight of each token of the document relative to
    the mean, probability what it is kept with.
    """
    new = ("topic", "n_tokens", "token_weight", "probability", "selected")
    keys = [f"_{d}" for d in DIMENSIONS]
    full = described(docs.drop(*new), text_col)
    cells = materialize(full.groupBy(*keys).agg(F.sum("_tokens").alias("tokens")), "mixing-totals")
    raked = materialize(
        rake(cells, budget, alpha, targets)
        .select(*keys, F.when(F.col("tokens") > 0, F.col("mass") / F.col("tokens")).otherwise(budget).alias("probability")),
        "mixing-rates")
    out = lookup(full, raked, keys, F.col(id_col))
    draw = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)), 11) / F.lit(float(1 << 53))
    return out.select(
        *(F.col(f"`{c}`") for c in docs.columns if c not in new), F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"), (F.col("probability") / budget).alias("token_weight"), "probability",
        (draw < F.col("probability")).alias("selected"))


def fulfilment(mixed: DataFrame, budget: float = 0.7, alpha: float = 0.7,
               targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(dimension, value, tokens, wanted, reached): what each target asked for and what raking gave, from ``mix``'s rows.

    ``reached`` is below ``wanted`` where a value has too few tokens, above it where others could not take their share,
    and anywhere if targets contradict each other, so that scaling had not settled after its JOBS * ROUNDS rounds.
    """
    out = None
    for d in DIMENSIONS:
        values = mixed.groupBy(F.coalesce(F.col(d), F.lit(NONE)).alias("value")).agg(
            F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("probability")).alias("reached"))
        given = (targets or {}).get(d)
        if given:
            pairs = [F.lit(x) for item in given.items() for x in (item[0], float(item[1]) / sum(given.values()))]
            lift = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("value")), F.lit(0.0))
            whole = values.agg(F.sum("tokens").alias("all"), F.lit(1.0).alias("lifts"))
        else:
            lift = F.pow(F.col("tokens").cast("double"), F.lit(alpha))
            whole = values.agg(F.sum("tokens").alias("all"), F.sum(lift).alias("lifts"))
        # One row beside the values of a dimension.
        rows = values.join(F.broadcast(whole)).select(
            F.lit(d).alias("dimension"), "value", "tokens", (lift / F.col("lifts") * budget * F.col("all")).alias("wanted"), "reached")
        out = rows if out is None else out.unionByName(rows)
    return out
