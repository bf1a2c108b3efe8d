"""Language identification with a byte convolutional network trained in numpy.

Bytes are embedded, filters of several widths run over windows of fixed length, the maximum of each filter over
the window goes through a softmax layer. Training uses a bounded sample of labelled documents: at most
PER_LANGUAGE documents of each language, SPANS windows from places spread over each document. Prediction cuts
every whole text into windows and averages the log-probabilities of all of them, weighted by their letters.

Defined cases: null texts and texts without a letter are ``und`` with score 0. Without any labelled row, all
texts are ``und``. Rows with a null language are not learned from but predicted. Repeated rows are predicted
alike. Columns other than the named ones are kept as they are, or not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import textscan

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 14
EMBED = 8
PER_LANGUAGE = 300
SPANS = 3
EPOCHS = 14
UNKNOWN = "und"
#: Windows that go through the network at once.
CHUNK = 256


class ByteNet:
    """Filters of WIDTHS bytes over embedded bytes, max pooling, softmax."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        wide, n = max(WIDTHS), FILTERS * len(WIDTHS)
        self.embedding = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = rng.normal(0, 1 / np.sqrt(EMBED * 3), (wide * EMBED, n)).astype(np.float32)
        self.shape = np.ones_like(self.filters)  # narrower filters do not see the last bytes
        for k, width in enumerate(WIDTHS):
            self.shape[width * EMBED:, k * FILTERS:(k + 1) * FILTERS] = 0
        self.filters *= self.shape
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.out, self.out_bias]

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """(windows * positions, widest * EMBED): the embedded bytes each position's filters see."""
        wide = max(WIDTHS)
        e = self.embedding[windows]
        seen = np.lib.stride_tricks.sliding_window_view(e.reshape(len(e), -1), wide * EMBED, axis=1)[:, ::EMBED]
        return seen.reshape(-1, wide * EMBED)

    def pooled(self, windows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum of each filter over a window, and where; negative maxima count as 0."""
        act = (cols @ self.filters).reshape(len(windows), -1, self.filters.shape[1])
        top = act.max(axis=1) + self.bias
        return top, act

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(windows), CHUNK):
            part = windows[at:at + CHUNK]
            top, _ = self.pooled(part, self.columns(part))
            z = np.maximum(top, 0) @ self.out + self.out_bias
            z = z - z.max(axis=1, keepdims=True)
            parts.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        cols = self.columns(windows)
        top, act = self.pooled(windows, cols)
        where = act.argmax(axis=1)
        h = np.maximum(top, 0)
        z = h @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(labels)), labels] -= 1
        p /= len(labels)
        d_top = (p @ self.out.T) * (top > 0)
        positions = act.shape[1]
        seen = cols.reshape(len(windows), positions, -1)[np.arange(len(windows))[:, None], where]  # (w, filter, col)
        d_filters = np.einsum("wf,wfc->cf", d_top, seen, optimize=True) * self.shape
        d_seen = d_top[:, :, None] * self.filters.T[None]
        wide = max(WIDTHS)
        bytes_seen = windows[np.arange(len(windows))[:, None, None], where[:, :, None] + np.arange(wide)]
        d_embedding = np.zeros_like(self.embedding)
        np.add.at(d_embedding, bytes_seen.ravel(), d_seen.reshape(-1, EMBED))
        return [d_embedding, d_filters.astype(np.float32), d_top.sum(axis=0), h.T @ p, p.sum(axis=0)]

    def train(self, windows: np.ndarray, labels: np.ndarray, seed: int = 11) -> None:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(seed)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), 64):
                pick = order[at:at + 64]
                step += 1
                for p, g, (m, v) in zip(self.parameters(), self.gradients(windows[pick], labels[pick]), moments):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= 0.004 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def cut(data: np.ndarray) -> np.ndarray:
    """The bytes of one text as windows of WINDOW bytes; the last one is filled with blanks."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.full(n * WINDOW, 0x20, np.uint8)
    out[:len(data)] = data
    return out.reshape(n, WINDOW)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> ByteNet | None:
    """A network for the languages of the labelled rows, from a bounded sample that a text's hash chooses."""
    usable = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    key = F.xxhash64("text")
    chosen = (
        usable.select("lang", key.alias("key"), F.length("text").alias("n"), *(
            F.substring("text", 1 + F.floor(F.length("text") * (k / SPANS)).cast("int"), WINDOW).alias(f"s{k}")
            for k in range(SPANS)))
        .withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("key", "n")))
        .where(F.col("nth") <= PER_LANGUAGE).orderBy("lang", "nth").collect()
    )
    languages = sorted({r["lang"] for r in chosen})
    if not languages:
        return None
    windows, labels = [], []
    for r in chosen:
        for k in range(SPANS):
            raw = (r[f"s{k}"] or "").encode()[:WINDOW]
            if len(raw) > 8 or k == 0:
                windows.append(cut(np.frombuffer(raw, np.uint8))[0])
                labels.append(languages.index(r["lang"]))
    net = ByteNet(languages)
    net.train(np.array(windows), np.array(labels))
    return net


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which bytes can begin or continue a letter: ASCII letters and everything beyond ASCII."""
    table = np.zeros(256, bool)
    table[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
    return table


def predict(
    df: DataFrame, net: ByteNet | None, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score"
) -> DataFrame:
    """Append the predicted language and its score, the geometric mean of the windows' probabilities."""
    new = [T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())]
    kept = [f for f in df.schema.fields if f.name not in (lang_col, score_col)]
    schema = T.StructType([*kept, *new])
    known: Column = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))

    def run(batches):
        letters = _letters()
        for batch in batches:
            data, offsets = textscan.text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            lettered = batch.column(batch.schema.get_field_index("_known")).to_pylist()
            langs, scores = [], []
            for lo, hi in textscan.pieces(offsets):
                rows = [i for i in range(lo, hi) if lettered[i] and net is not None]
                sums = {}
                if rows:
                    cuts = [cut(data[offsets[i]:offsets[i + 1]]) for i in rows]
                    logs, weight = [], []
                    for part in _batches(cuts):
                        logs.append(net.log_probabilities(part))
                        weight.append(letters[part].sum(axis=1))
                    logs, weight = np.concatenate(logs), np.concatenate(weight).astype(np.float64) + 1e-3
                    lead = np.concatenate([[0], np.cumsum([len(c) for c in cuts])[:-1]])
                    mean = np.add.reduceat(logs * weight[:, None], lead, axis=0) / np.add.reduceat(weight, lead)[:, None]
                    sums = dict(zip(rows, mean))
                for i in range(lo, hi):
                    if i in sums:
                        p = np.exp(sums[i] - sums[i].max())
                        langs.append(net.languages[int(p.argmax())])
                        scores.append(float(1 / p.sum()))
                    else:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return df.select(*(F.col(f"`{f.name}`") for f in kept)).withColumn("_known", known).mapInArrow(run, schema)


def _batches(cuts: list[np.ndarray]):
    """The windows of several texts together, CHUNK or more at a time."""
    part, size = [], 0
    for c in cuts:
        part.append(c)
        size += len(c)
        if size >= CHUNK:
            yield np.concatenate(part)
            part, size = [], 0
    if part:
        yield np.concatenate(part)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document belongs to the third that nothing is learned from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))
