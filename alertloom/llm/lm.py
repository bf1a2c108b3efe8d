"""Language-model scores of texts: a network of causal self-attention over subword ids, beside plain word frequencies.

1. Every text is cut into words; distinct words are counted in the tasks and added up, in the training documents and in
   all. The HOT most frequent words go to the tasks as hashes with their counts and ids, a table of bounded size. The
   frequency score of a text is added up there, and what it has of other words is joined to the counts: no such word is
   frequent, so no key is.
2. Words become ids of a public tokenizer. The vocabulary of the network has the 256 bytes, the end of a text and the ids
   most frequent in the training documents, counted over all of them; other ids are spelt as their bytes. The ids of
   all texts are written once.
3. Classes, and the odds that the network starts from and adds to, come from the pairs of neighbouring ids in all
   training documents. The network starts from a fit of WARM windows. Then every round each task goes on from the shared
   weights over its part of the training windows, and the weights of all tasks are averaged. The rounds take disjoint
   parts of the training windows (ROUNDS), which together are all of them; a small corpus is gone through LEAST windows,
   or as a whole, every time.
4. Overlapping windows score each token of every text once (attention.py).

A-Z are lower-cased; words are runs ``[^\\x20\\x09-\\x0D]+``, white space only separates them; the end of a text is a
token of its own. Within a batch words are equal if their 64-bit hashes are.

Defined cases: null texts count as empty, which is the end alone. Rows whose ``train`` is null do not count as training
documents. Repeated rows count and are scored as often as they are there. Without training documents the network has
even odds at first and nothing to learn from, and frequencies are 0.5 / 0.5. No rows give no rows. Very long words are
turned into ids in pieces of PIECE characters. Columns other than id and text are not read.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import attention, textscan

#: Words that are looked up in the tasks instead of joined, and their longest ids.
HOT, HOT_IDS = 1 << 17, 16
#: Windows of the first fit.
WARM = 16_384
#: Where the part of each round over the corpus begins, of PARTS, and how many windows it takes at least. Weights are
#: averaged early while they still move far.
ROUNDS, LEAST = (0, 1 << 14, 1 << 16, 1 << 18), 1 << 17
#: Step of the first fit, and what it shrinks by every round.
RATE, SHRINK = 0.015, 0.7
#: Windows of a step over a part of the corpus: a step costs some milliseconds beside what its windows cost.
BATCH = 512
#: Parts that hashes tell apart.
PARTS = 1 << 20
#: Characters of a word that are turned into ids together.
PIECE = 1_024
#: Windows that are scored together, and numbers of the weights that are averaged in one row.
SLICE, PART = 16_384, 8_192
END = attention.SIZE - 1


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> tuple[tiktoken.Encoding, dict[bytes, int]]:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("lm", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def _ids(path: str, words: list[str]) -> list[list[int]]:
    """The tokenizer's ids of each word, with a blank before it."""
    encode = _tokenizer(path)[0].encode_ordinary
    out = [encode(" " + w[:PIECE]) for w in words]
    for i, w in enumerate(words):
        for at in range(PIECE, len(w), PIECE):
            out[i] += encode(w[at:at + PIECE])
    return out


class Spelling:
    """The network's ids of a tokenizer's ids: those kept have one of their own, others are spelt in bytes."""

    def __init__(self, path: str, counts: np.ndarray):
        ranks = _tokenizer(path)[1]
        single = [ranks[bytes([b])] for b in range(256)]
        often = np.argsort(-counts, kind="stable")
        often = often[~np.isin(often, single)][:END - 256].tolist()
        place = {k: i for i, k in enumerate([*single, *often])}
        spelt = [[place[k]] if k in place else [place[ranks[bytes([b])]] for b in token]
                 for token, k in sorted(ranks.items(), key=lambda x: x[1])]
        self.sizes = np.array([len(s) for s in spelt])
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.flat = np.array([k for s in spelt for k in s], np.int16)

    def __call__(self, words: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the network, how many each word has) for the tokenizer's ids of some words, none of them empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.fromiter(chain.from_iterable(words), np.int64, int(lengths.sum()))
        sizes = self.sizes[ids]
        per_word = np.add.reduceat(sizes, np.cumsum(lengths) - lengths) if len(words) else lengths
        return ragged(self.flat, self.begins[ids], sizes), per_word


def ragged(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of ``flat`` one after another."""
    lead = np.cumsum(sizes) - sizes
    return flat[np.repeat(begins - lead, sizes) + np.arange(int(sizes.sum()))]


def _words(texts: pa.Array):
    """(distinct words in lower case, number of each word of the texts, hash of each distinct word, first word of each
    text and the end)."""
    data, offsets = textscan.text_bytes(texts)
    starts, ends, first = textscan.word_bounds(data, offsets)
    hashes, at, nth = np.unique(
        textscan.word_hashes(data, starts, ends, lower=True), return_index=True, return_inverse=True)
    sizes = ends[at] - starts[at]
    low = textscan._LOWER[ragged(data, starts[at], sizes)]
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    words = pa.Array.from_buffers(
        pa.large_string(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(low)])
    return words, nth, hashes, first


def count_words(docs: DataFrame, train: Column, text_col: str = "text") -> DataFrame:
    """(word, c, total): how often a word occurs in the training documents and in all."""

    def count(batches):
        for batch in batches:
            words, nth, _, first = _words(batch.column("text"))
            learn = np.repeat(batch.column("train").to_numpy(zero_copy_only=False), np.diff(first))
            total = np.bincount(nth, minlength=len(words))
            c = np.bincount(nth, learn, len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [words.cast(pa.string()), pa.array(c), pa.array(total, pa.int64())], names=["word", "c", "total"])

    read = docs.select(F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    return read.mapInArrow(count, "word string, c long, total long").groupBy("word").agg(
        F.sum("c").alias("c"), F.sum("total").alias("total"))


def _subword_counts(counts: DataFrame, path: str) -> np.ndarray:
    """How often each id of the tokenizer occurs in the training documents: one row per id reaches the driver."""
    size = len(_tokenizer(path)[1])

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            ids = _ids(path, batch.column("word").to_pylist())
            c = np.repeat(batch.column("c").to_numpy(), np.fromiter(map(len, ids), np.int64, len(ids)))
            flat = np.fromiter(chain.from_iterable(ids), np.int64, len(c))
            np.add.at(total, flat, c)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    out = np.zeros(size, np.int64)
    for r in counts.where("c > 0").select("word", "c").mapInArrow(count, "id long, n long").groupBy("id").agg(
            F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def _frequent(counts: DataFrame) -> list:
    """At most HOT words (word, c), those above a bound on how often they occur; the bound comes from a histogram."""
    level = F.floor(F.log2("total") * 16)
    held = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)  # some hundred rows
    cut, n = None, 0
    for r in held:
        n += r["count"]
        if n > HOT:
            break
        cut = r["level"]
    return [] if cut is None else counts.where(level >= cut).select("word", "c").collect()


class Frequent:
    """The most frequent words: sorted hashes, counts and ids. Long ones have no ids here."""

    def __init__(self, rows: list, path: str, spelling: Spelling):
        words = pa.array([r["word"] for r in rows], pa.string())
        data, offsets = textscan.text_bytes(words)
        offsets = np.asarray(offsets)
        hashes = textscan.word_hashes(data, offsets[:-1], offsets[1:]) if len(rows) else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.counts = np.array([r["c"] for r in rows], np.float64)[order]
        flat, sizes = spelling(_ids(path, [rows[i]["word"] for i in order]))
        self.sizes = np.where(sizes <= HOT_IDS, sizes, 0)
        self.flat = flat[np.repeat(sizes <= HOT_IDS, sizes)]
        self.begins = np.cumsum(self.sizes) - self.sizes

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def _stream(words: pa.Array, where: np.ndarray, nth: np.ndarray, first: np.ndarray, hot: Frequent, path: str,
            spelling: Spelling) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes) of the texts, each with its end."""
    sizes = np.where(where >= 0, hot.sizes[where] if len(hot.sizes) else 0, 0)
    begins = np.where(where >= 0, hot.begins[where] if len(hot.sizes) else 0, 0)
    cold = np.flatnonzero(sizes == 0)
    fresh, sizes[cold] = spelling(_ids(path, words.take(pa.array(cold)).to_pylist()))
    begins[cold] = len(hot.flat) + np.cumsum(sizes[cold]) - sizes[cold]
    flat = np.concatenate([hot.flat, fresh, np.array([END], np.int16)])
    # The end is a further word behind those of each text.
    order = np.insert(nth, first[1:], len(sizes))
    sizes, begins = np.append(sizes, 1), np.append(begins, len(flat) - 1)
    stream = ragged(flat, begins[order], sizes[order])
    lead = np.concatenate([[0], np.cumsum(sizes[order])])
    bounds = lead[first + np.arange(len(first))]
    return stream, np.diff(bounds)


def _encode(docs: DataFrame, hot, path: str, spelling, ends: int) -> DataFrame:
    """One row per text: its words, what the frequent ones contribute, the others, and the ids of all."""

    def run(batches):
        for batch in batches:
            words, nth, hashes, first = _words(batch.column("text"))
            where = hot.value.find(hashes)
            c = np.where(where >= 0, hot.value.counts[where] if len(hot.value.counts) else 0, 0)
            known = where >= 0
            logs = np.where(known, np.log10(c + 0.5), 0.0)
            add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
            rare = np.flatnonzero(~known[nth])
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(rare, first), pa.int32()), words.take(pa.array(nth[rare])).cast(pa.string()))
            stream, sizes = _stream(words, where, nth, first, hot.value, path, spelling.value)
            bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64) * 2
            ids = pa.Array.from_buffers(
                pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(stream))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("train"), pa.array(np.diff(first) + 1, pa.int64()),
                 pa.array(add(((c > 0) & known)[nth].astype(np.int64)) + int(ends > 0), pa.int64()),
                 pa.array(add(logs[nth]) + np.log10(ends + 0.5), pa.float64()), lists, ids.cast(pa.binary())],
                names=["id", "train", "n_tokens", "n_known", "logs", "rare", "ids"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(
        run, f"id {kind}, train boolean, n_tokens long, n_known long, logs double, rare array<string>, ids binary"
    ).withColumn("row", F.monotonically_increasing_id())


def _streams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream, begins, sizes) of a column of ids."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    stream = np.frombuffer(column.buffers()[2] or b"", np.int16)
    return stream, bounds[:-1] // 2, np.diff(bounds) // 2


def _chosen(batch: pa.RecordBatch, low: int, count: int):
    """Slices (hash, window, weight) of the blocks whose hash falls into ``count`` of PARTS from ``low`` on."""
    stream, begins, sizes = _streams(batch.column("ids"))
    text, nth = attention.blocks(sizes)
    row = batch.column("row").to_numpy().astype(np.uint64)
    key = textscan.mix(textscan.mix(row[text]) + nth.astype(np.uint64))
    pick = np.flatnonzero((key - np.uint64(low)) % np.uint64(PARTS) < np.uint64(count))
    for at in range(0, len(pick), SLICE):
        mine = pick[at:at + SLICE]
        yield key[mine], *attention.cut(stream, begins, sizes, text[mine], nth[mine])


def _pairs(train: DataFrame) -> np.ndarray:
    """How often each id (column) follows another or the beginning (row), in all training documents."""
    size = attention.SIZE

    def count(batches):
        total = np.zeros((size + 1) * size, np.int64)
        for batch in batches:
            stream, begins, sizes = _streams(batch.column("ids"))
            for at in range(0, len(sizes), SLICE):
                lead, n = begins[at:at + SLICE], sizes[at:at + SLICE]
                ids = ragged(stream, lead, n).astype(np.int64)
                before = np.concatenate([[attention.BEGIN], ids[:-1]])
                before[(np.cumsum(n) - n)[n > 0]] = attention.BEGIN
                total += np.bincount(before * size + ids, minlength=len(total))
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(total[pair])], names=["pair", "n"])

    table = train.select("ids").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((size + 1) * size, np.float32)  # SIZE * SIZE numbers at most reach the driver
    out[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    return out.reshape(size + 1, size)


def _warm(train: DataFrame, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """At most WARM windows, chosen by hash from everywhere: where the fit starts."""
    count = max(1, PARTS * 2 * WARM // blocks) if blocks > 2 * WARM else PARTS

    def pick(batches):
        for batch in batches:
            for key, windows, weight in _chosen(batch, 0, count):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array([w.tobytes() for w in windows], pa.binary()),
                     pa.array([w.tobytes() for w in weight], pa.binary())], names=["key", "w", "k"])

    rows = train.mapInArrow(pick, "key long, w binary, k binary").orderBy("key", "w").limit(WARM).collect()
    join = lambda c, kind, wide: np.frombuffer(b"".join(bytes(r[c]) for r in rows), kind).reshape(-1, wide)
    return join("w", np.int16, attention.SPAN), join("k", np.bool_, attention.STEP)


def _round(train: DataFrame, net: attention.Network, places: np.ndarray, nth: int, blocks: int) -> list[np.ndarray]:
    """Weights after each task went on from ``net`` over its windows of the round, averaged by their number."""
    shared = train.sparkSession.sparkContext.broadcast((net, places))
    rate = RATE * SHRINK**nth
    low, end = (*ROUNDS, PARTS)[nth:nth + 2]
    count = min(PARTS, max(end - low, PARTS * LEAST // blocks))
    batch = BATCH if count < PARTS else 128  # a small corpus has few steps

    def learn(batches):
        net, places = shared.value
        net.set([p.copy() for p in net.parameters()])
        state, n, last = None, 0, 0
        for rows in batches:
            for _, windows, weight in _chosen(rows, low, count):
                state = net.train(places[windows], weight, rate, nth, batch, state)
                n, last = n + len(windows), int(windows[0, -1])
        if not n:
            return
        flat = np.concatenate([p.ravel() for p in net.parameters()]).astype(np.float64) * n
        parts = [flat[at:at + PART] for at in range(0, len(flat), PART)]
        salt = int(textscan.mix(np.array([n + last], np.uint64))[0] % np.uint64(64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(parts)), pa.int32()), pa.array([salt] * len(parts), pa.int32()),
             pa.array([n] * len(parts), pa.int64()), pa.array(parts, pa.list_(pa.float64()))],
            names=["part", "salt", "n", "v"])

    def add(table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(axis=0)
        n = sum(table.column("n").to_pylist())
        return pa.table({"part": table.column("part")[:1], "salt": table.column("salt")[:1], "n": pa.array([n]),
                         "v": pa.array([v], pa.list_(pa.float64()))})

    kind = "part int, salt int, n long, v array<double>"
    sums = train.mapInArrow(learn, kind).groupBy("part", "salt").applyInArrow(add, kind).groupBy("part").applyInArrow(add, kind)
    rows = sorted(sums.collect(), key=lambda r: r["part"])
    shared.destroy()
    if not rows:
        return net.parameters()
    flat = np.concatenate([np.array(r["v"]) / r["n"] for r in rows]).astype(np.float32)
    out, at = [], 0
    for p in net.parameters():
        out.append(flat[at:at + p.size].reshape(p.shape))
        at += p.size
    return out


def fit(encoded: DataFrame, counts: np.ndarray) -> tuple[attention.Network, np.ndarray]:
    """The network, and the place that each id has in its classes. ``counts`` are the ids' in the training documents."""
    train = encoded.where("train").select("row", "ids")
    blocks = train.agg(F.sum(F.ceil(F.octet_length("ids") / (2 * attention.STEP)))).first()[0] or 0
    windows, weight = _warm(train, blocks)
    pairs = _pairs(train)
    order = attention.classes(pairs, pairs.sum(axis=0))
    places = np.append(order, attention.BEGIN).astype(np.int16)
    inverse = np.argsort(places)
    placed = np.zeros(attention.SIZE)
    placed[order] = counts
    net = attention.Network(placed, pairs=pairs[inverse][:, inverse[:-1]])
    if len(windows):
        net.train(places[windows], weight, RATE, 0)
    for k in range(len(ROUNDS) if blocks else 0):
        net.set(_round(train, net, places, k, blocks))
    return net, places


def score(docs: DataFrame, train: Column, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every text; ``train`` marks what is learned from."""
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.coalesce(train, F.lit(False)).alias("train"))
    counts = materialize(count_words(read, F.col("train")), "lm-words")
    ends = read.where("train").count()
    sums = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)

    ids = _subword_counts(counts, tokenizer)
    spelling = Spelling(tokenizer, ids)
    hot = Frequent(_frequent(counts), tokenizer, spelling)
    frequent, spell = (spark.sparkContext.broadcast(x) for x in (hot, spelling))
    encoded = materialize(_encode(read, frequent, tokenizer, spell, ends), "lm-encoded")

    kept = np.zeros(attention.SIZE)
    np.add.at(kept, spelling.flat, np.repeat(ids, spelling.sizes))
    kept[END] = ends
    net, places = fit(encoded, kept)
    shared = spark.sparkContext.broadcast((net, places))

    def run(batches):
        net, places = shared.value
        for batch in batches:
            stream, begins, sizes = _streams(batch.column("ids"))
            stream = places[stream]
            text, nth = attention.blocks(sizes)
            total = np.zeros(len(sizes))
            for at in range(0, len(text), SLICE):
                mine = text[at:at + SLICE]
                windows, weight = attention.cut(stream, begins, sizes, mine, nth[at:at + SLICE])
                logs = (net.log10(windows) * weight).sum(axis=1, dtype=np.float64)
                total += np.bincount(mine, logs, len(sizes))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "id", "n_tokens", "n_known", "logs")), pa.array(total)],
                names=["row", "id", "n_tokens", "n_known", "logs", "score"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    scored = encoded.select("row", "id", "n_tokens", "n_known", "logs", "ids").mapInArrow(
        run, f"row long, id {kind}, n_tokens long, n_known long, logs double, score double")
    rare = encoded.select("row", F.explode("rare").alias("word")).join(counts.select("word", "c"), "word").groupBy("row").agg(
        F.sum(F.log10(F.col("c") + 0.5)).alias("more"), F.count_if(F.col("c") > 0).alias("too"))
    return scored.join(rare, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("too", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))
         ).alias("base_score"), "score")
