"""Toxicity by two class-conditional Kneser-Ney models over the letters of words.

Each class has a model that spells words from left to right: the next byte given the whole beginning of the word,
with absolute discounting, counted once per document. What the discount frees goes to a lower order that both classes share: in how many of
the two classes a continuation occurs. Words of more than DEPTH bytes, as sentences of scripts without spaces, are read
to their end by a window of DEPTH bytes from each of their characters on; windows count as words from there, and those
that begin inside a word have counts of their own. A beginning that neither class has seen adds nothing, so rare and new words
are judged by the part of them that is known.

A document is compared by length-normalised log-likelihoods: the difference toxic minus ordinary per word, over
the whole document and over its best stretches of 1, 8 and 64 words, so that few words in a long text count. A
logistic function of these four figures, fitted on labelled documents that the counts do not include, is the score.

The models are fitted on a bounded sample of labelled rows: at most PER_CLASS documents of each label for the
counts and as many for the score. Scoring reads every whole text.

Defined cases: null and empty texts have no words and get the score of no evidence; without labelled rows of both
classes every score is 0. Words are runs of ASCII letters, digits and bytes beyond ASCII; A-Z count as a-z.
Repeated rows are scored alike; of several labels of a document each counts as a row. Other columns are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import materialize
from . import textscan

PER_CLASS = 3000
DEPTH = 14
STRETCHES = (1, 8, 64)
DISCOUNT = 0.75
_END = np.uint64(0x5851F42D4C957F2D)
_ROOT = np.uint64(0x14057B7EF767814F)
_INSIDE = np.uint64(0x2545F4914F6CDD1D)
_APART = np.ones(256, bool)
_APART[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1),
        *range(128, 256)]] = False


def _windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
    """(starts, ends, inside, closed, first) of words, longer ones as windows from each of their characters on.

    ``inside`` marks windows that begin inside a word, ``closed`` those that reach its end.
    """
    size = ends - starts
    long = np.flatnonzero(size > DEPTH)
    n = np.ones(len(starts), np.int64)
    n[long] = size[long]
    word = np.repeat(np.arange(len(starts)), n)
    at = starts[word] + np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    lead = (at == starts[word]) | (data[at] & 0xC0 != 0x80)  # not within a character
    word, at = word[lead], at[lead]
    to = np.minimum(ends[word], np.where(size[word] > DEPTH, at + DEPTH, ends[word]))
    return at, to, at != starts[word], to == ends[word], np.searchsorted(word, first)


def _paths(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray, closed: np.ndarray):
    """(depth, rows, node, parent) for every beginning of every window and for the ends of words."""
    size = ends - starts
    last = np.where(inside, _INSIDE, _ROOT)
    for d, rows, node in textscan.beginnings(data, starts, ends, DEPTH):
        node = np.where(inside[rows], textscan.mix(node ^ _INSIDE), node)
        yield d, rows, node, last[rows]
        last[rows] = node
        over = rows[(size[rows] == d) & closed[rows]]
        yield d + 1, over, textscan.mix(last[over] ^ _END), last[over]


def _counts(sample: DataFrame) -> DataFrame:
    """(node, parent, depth, c0, c1) over rows (text, toxic)."""

    def run(batches):
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = textscan.text_bytes(batch.column(0))
            for lo, hi in textscan.pieces(offsets):
                starts, ends, inside, closed, first = _windows(
                    data, *textscan.word_bounds(data, offsets[lo:hi + 1], _APART))
                toxic = np.repeat(label[lo:hi], np.diff(first))
                found = list(_paths(data, starts, ends, inside, closed))
                if not found:
                    continue
                node, parent = (np.concatenate([f[k] for f in found]) for k in (2, 3))
                depth = np.concatenate([np.full(len(f[1]), f[0]) for f in found])
                word = np.concatenate([f[1] for f in found])
                # A beginning counts once per document, so that one document's repetitions are no evidence.
                doc = np.searchsorted(first, word, "right").astype(np.uint64)
                once = np.unique(textscan.mix(node + doc * _ROOT), return_index=True)[1]
                node, parent, depth, one = node[once], parent[once], depth[once], toxic[word[once]]
                key, lead, back = np.unique(node, return_index=True, return_inverse=True)
                c1 = np.bincount(back, weights=one, minlength=len(key)).astype(np.int64)
                c = np.bincount(back, minlength=len(key))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(parent[lead].view(np.int64)),
                     pa.array(depth[lead].astype(np.int32)), pa.array(c - c1), pa.array(c1)],
                    names=["node", "parent", "depth", "c0", "c1"])

    return sample.mapInArrow(run, "node long, parent long, depth int, c0 long, c1 long").groupBy(
        "node", "parent", "depth").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


class Model:
    """Log-likelihood ratios of word beginnings, and the weights of the score."""

    def __init__(self, nodes: np.ndarray, ratios: np.ndarray):
        self.nodes, self.ratios = nodes, ratios
        self.weights = np.zeros(len(STRETCHES) + 2)

    @classmethod
    def of(cls, node, parent, depth, c0, c1, kinds0, kinds1, total0, total1) -> Model:
        """From the rows of beginnings; kinds and totals are of the row's parent."""
        both = np.maximum(kinds0 + kinds1, 1)
        shared = ((c0 > 0).astype(float) + (c1 > 0)) / both

        def chance(c, kinds, total):
            seen = (np.maximum(c - DISCOUNT, 0) + DISCOUNT * kinds * shared) / np.maximum(total, 1)
            return np.where(total > 0, seen, shared)

        step = np.log(chance(c1, kinds1, total1)) - np.log(chance(c0, kinds0, total0))
        order = np.argsort(node)
        node, parent, depth, step = node[order], parent[order], depth[order], step[order]
        whole = step.copy()
        for d in range(2, DEPTH + 2):
            rows = np.flatnonzero(depth == d)
            at = np.minimum(np.searchsorted(node, parent[rows]), len(node) - 1)
            known = node[at] == parent[rows]
            whole[rows] += np.where(known, whole[at], 0)
        return cls(node, whole.astype(np.float32))

    def words(
        self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray, closed: np.ndarray
    ) -> np.ndarray:
        """The ratio of each window: that of its longest known beginning."""
        if not len(starts) or not len(self.nodes):
            return np.zeros(len(starts))
        hashes = textscan.word_hashes(data, starts, ends, lower=True)
        hashes = textscan.mix(hashes ^ (inside + closed * np.uint64(2)))
        _, lead, back = np.unique(hashes, return_index=True, return_inverse=True)
        order = np.sort(lead)  # in order of place, as beginnings() reads on
        out = np.zeros(len(order), np.float32)
        live = np.ones(len(order), bool)
        for _, rows, node, _ in _paths(data, *(x[order] for x in (starts, ends, inside, closed))):
            pick = live[rows]
            rows, node = rows[pick], node[pick]
            at = np.minimum(np.searchsorted(self.nodes, node), len(self.nodes) - 1)
            known = self.nodes[at] == node
            out[rows[known]] = self.ratios[at[known]]
            live[rows[~known]] = False
        return out[np.searchsorted(order, lead)][back].astype(np.float64)

    def figures(self, texts: pa.Array) -> np.ndarray:
        """Per text the mean difference over the whole and over the best stretch of each length."""
        data, offsets = textscan.text_bytes(texts)
        out = np.zeros((len(texts), len(STRETCHES) + 1))
        for lo, hi in textscan.pieces(offsets):
            *windows, first = _windows(data, *textscan.word_bounds(data, offsets[lo:hi + 1], _APART))
            sums = np.concatenate([[0.0], np.cumsum(self.words(data, *windows))])
            for i, a, b in zip(range(lo, hi), first[:-1], first[1:]):
                if b > a:
                    out[i, 0] = (sums[b] - sums[a]) / (b - a)
                    for k, n in enumerate(STRETCHES):
                        n = min(n, b - a)
                        out[i, k + 1] = (sums[a + n:b + 1] - sums[a:b + 1 - n]).max() / n
        return out

    def score(self, figures: np.ndarray) -> np.ndarray:
        z = figures @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def calibrate(self, figures: np.ndarray, labels: np.ndarray) -> None:
        """Logistic regression with a small penalty, by Newton steps on standardised figures."""
        mean, scale = figures.mean(axis=0), figures.std(axis=0) + 1e-9
        x = np.column_stack([np.ones(len(figures)), (figures - mean) / scale])
        # Classes weigh the same; their shares in a sample say nothing about the documents to come.
        w = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
        beta = np.zeros(x.shape[1])
        penalty = np.full(x.shape[1], 1.0)
        penalty[0] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
            grad = x.T @ (w * (p - labels)) + penalty * beta
            beta -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty), grad)
        self.weights[1:] = beta[1:] / scale
        self.weights[0] = beta[0] - (self.weights[1:] * mean).sum()


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS
) -> Model | None:
    """A model from texts and the rows (id, toxic, part) of ``labels``.

    Documents whose part is true are counted, the others set the score. Of each label and part a bounded number is
    chosen by a hash of the id before any text is read; ids and other columns are not looked at afterwards.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("part").isNotNull() & F.col(id_col).isNotNull())
    nth = F.row_number().over(Window.partitionBy("toxic", "part").orderBy(F.xxhash64(id_col), id_col))
    chosen = usable.select(id_col, F.col("toxic").cast("int").alias("toxic"), F.col("part").alias("counted")).distinct()
    chosen = chosen.withColumnRenamed("counted", "part").withColumn("nth", nth).where(F.col("nth") <= per_class)
    # At most four times per_class rows.
    rows = docs.select(id_col, F.col(text_col).alias("text")).where("text is not null").join(
        F.broadcast(chosen.drop("nth")), id_col).select("text", "toxic", "part")
    rows = materialize(rows, "toxicity-sample")
    nodes = _counts(rows.where("part").select("text", "toxic"))
    # Seen once says nothing; what it adds to its parent's kinds is kept.
    kinds = nodes.groupBy(F.col("parent").alias("of")).agg(
        F.count_if(F.col("c0") > 0).alias("kinds0"), F.count_if(F.col("c1") > 0).alias("kinds1"),
        F.sum("c0").alias("total0"), F.sum("c1").alias("total1"))
    often = nodes.where("c0 + c1 > 1").join(kinds, F.col("parent") == F.col("of")).drop("of").toArrow()
    if not often.num_rows:
        return None
    col = lambda name: often.column(name).to_numpy()
    model = Model.of(
        col("node").view(np.uint64), col("parent").view(np.uint64), col("depth"),
        *(col(c).astype(float) for c in ("c0", "c1", "kinds0", "kinds1", "total0", "total1")))
    names = [f"f{k}" for k in range(len(STRETCHES) + 1)]

    def run(batches):
        for batch in batches:
            x = model.figures(batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), *(pa.array(x[:, k]) for k in range(x.shape[1]))], names=["toxic", *names])

    seen = rows.where("not part").select("text", "toxic").mapInArrow(
        run, "toxic int, " + ", ".join(f"{n} double" for n in names)).toArrow()
    labels = seen.column("toxic").to_numpy()
    if len(set(labels.tolist())) < 2:
        return None
    model.calibrate(np.column_stack([seen.column(n).to_numpy() for n in names]), labels)
    return model


def score(df: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Append the score of the text, from 0 to 1."""
    kept = [f for f in df.schema.fields if f.name != score_col]
    schema = T.StructType([*kept, T.StructField(score_col, T.DoubleType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            scores = np.zeros(len(texts)) if model is None else model.score(model.figures(texts))
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(scores)], names=schema.names)

    return df.mapInArrow(run, schema)
