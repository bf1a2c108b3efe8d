"""Grouping of spelling variants: words at one inserted, deleted or replaced letter, found in bit-sliced indexes.

Index. Over the words of a block, every (position, letter) has a bitset of the words with that letter there. A query
word walks its letters once; three sets of words are carried along, a machine word for 64 of them at a time:

    zero     words that agree so far
    replaced words that differ in exactly one letter so far
    shifted  words that had one letter more, whose positions have been shifted by one since

Letter c at position i turns them into zero & B[i, c], (replaced & B[i, c]) | (zero & ~B[i, c]) and
(shifted | zero) & B[i + 1, c]. At the end ``replaced`` holds the near words of equal length and ``shifted | zero`` those
longer by a letter; that a shorter word is near is known from its own query. All queries of a block go together.

Blocks. A single error lies in one segment of a word, so two near words agree on everything outside it. Every word is
entered under its letters outside the first and outside the second half, once as the shorter and once as the longer
word of a pair; entries of equal key meet in one block, and the index of a block is exact whatever else lies in it. A
key with more than CROWD entries is cut into the halves of its segment, and so on down to single letters, where a key
can hold no more words than the alphabet has pairs of letters. So the work grows with the number of words, and no
family of words that share a beginning or an end is ever one task.

Words are counted before anything else, combined in the tasks that read the texts.

Defined cases: null and empty texts have no words. A null id counts as empty in the noise hash. Repeated rows count
again. Near words of equal count: the smaller in code-point order. Forms are followed to the last, which ends because
every step raises the count. No words give no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import lookup

#: Letters of a word after A-Z are lower-cased: fixed values of the contract.
RUN = "[a-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Entries of a block, on average, and of a key before it is cut finer.
BLOCK, CROWD = 16_384, 2_048
#: Cells (queries times 64-bit words) of a set that are handled together.
CELLS = 1 << 18


def count_words(docs: DataFrame, least_length: int = 6, least_count: int = 5, noise: int | None = 199,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n). With ``noise``, a run loses the letter at h % length where h, the crc32 of id and run, is divisible."""
    text = F.translate(F.col(text_col), UPPER, LOWER)
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text, F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))).alias("run"))
    word = F.col("run")
    if noise:
        h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % noise == 0, F.concat(
            F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(word)
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(
        F.count("*").alias("n")).where(F.col("n") >= least_count)


def _entry(s: Column, lo: Column, hi: Column) -> Column:
    """The entry of a word, as shorter (length s) or longer (s + 1) one of a pair, without the letters lo to hi."""
    word = F.col("word")
    longer = (F.length(word) - s).cast("int")
    rest = F.substring(word, hi + longer + 1, F.length(word))
    key = F.xxhash64(s, lo, hi, F.substring(word, F.lit(1), lo), rest)
    return F.struct(s.alias("s"), lo.alias("lo"), hi.alias("hi"), key.alias("key"))


def _entries(words: DataFrame) -> DataFrame:
    size = F.length("word")
    lengths = F.explode(F.when(size > 1, F.array(size, size - 1)).otherwise(F.array(size)))
    halves = words.select("word", "n", lengths.alias("s"))
    s, zero = F.col("s"), F.lit(0)
    middle = F.floor(s / 2).cast("int")
    first, second = _entry(s, zero, middle), _entry(s, middle, s)
    return halves.select("word", "n", F.explode(
        F.when(s > 1, F.array(first, second)).otherwise(F.array(second))).alias("e")).select("word", "n", "e.*")


def _finer(entries: DataFrame) -> DataFrame:
    s, lo, hi = (F.col(c) for c in ("s", "lo", "hi"))
    middle = F.floor((lo + hi) / 2).cast("int")
    return entries.select("word", "n", F.explode(F.array(_entry(s, lo, middle), _entry(s, middle, hi))).alias("e")).select(
        "word", "n", "e.*")


def near_in_block(codes: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a shorter word, row of a near word) in a matrix of code points whose rows have s or s + 1 letters."""
    n, s = len(codes), codes.shape[1] - 1
    queries = np.flatnonzero(~longer)
    wide = -(-n // 64)

    def bits(flags: np.ndarray) -> np.ndarray:
        packed = np.packbits(flags, axis=-1, bitorder="little")
        return np.pad(packed, [(0, 0)] * (flags.ndim - 1) + [(0, wide * 8 - packed.shape[-1])]).view(np.uint64)

    def index(position: int) -> tuple[np.ndarray, np.ndarray]:
        """The letters at a position, in order, and their bitsets; the last one is empty, for other letters."""
        letters = np.unique(codes[:, position])
        return letters, bits(np.concatenate([codes[:, position] == letters[:, None], np.zeros((1, n), bool)]))

    def rows(found: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> np.ndarray:
        letters, sets = found
        at = np.minimum(np.searchsorted(letters, wanted), len(letters) - 1)
        return sets[np.where(letters[at] == wanted, at, len(letters))]

    left, right = [], []
    is_longer = bits(longer)
    step = max(1, CELLS // wide)
    for start in range(0, len(queries), step):
        mine = queries[start:start + step]
        zero = np.full((len(mine), wide), ~np.uint64(0))
        replaced, shifted = np.zeros_like(zero), np.zeros_like(zero)
        here = index(0)
        for i in range(s):
            beyond = index(i + 1)
            same, ahead = rows(here, codes[mine, i]), rows(beyond, codes[mine, i])
            shifted = (shifted | zero) & ahead
            replaced = (replaced & same) | (zero & ~same)
            zero = zero & same
            here = beyond
        hits = (replaced & ~is_longer) | ((shifted | zero) & is_longer)
        q, w = np.nonzero(np.unpackbits(hits.view(np.uint8), axis=1, bitorder="little", count=n))
        left.append(mine[q])
        right.append(w)
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def _search(block: pa.Table) -> pa.Table:
    """Near words among the entries of a block, class by class of the shorter length, in both directions."""
    s, key = block.column("s").to_numpy(), block.column("key").to_numpy()
    words, counts = block.column("word").to_pylist(), block.column("n").to_numpy()
    _, nth, size = np.unique(key, return_inverse=True, return_counts=True)
    met = np.flatnonzero(size[nth] > 1)  # a key with a single entry proposes nothing
    out = {"word": [], "near": [], "near_n": []}
    for length in np.unique(s[met]).tolist():
        pick = {words[r]: int(counts[r]) for r in met[s[met] == length]}
        texts = list(pick)
        # One array of fixed width: the last column is 0 for the shorter words.
        codes = np.array(texts, dtype=f"U{length + 1}").view(np.uint32).reshape(len(texts), length + 1)
        longer = codes[:, -1] != 0
        for a, b in zip(*(x.tolist() for x in near_in_block(codes, longer))):
            one, other = texts[a], texts[b]
            out["word"].append(one)
            out["near"].append(other)
            out["near_n"].append(pick[other])
            if longer[b]:
                out["word"].append(other)
                out["near"].append(one)
                out["near_n"].append(pick[one])
    return pa.table({"word": pa.array(out["word"], pa.string()), "near": pa.array(out["near"], pa.string()),
                     "near_n": pa.array(out["near_n"], pa.int64())})


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for every ordered pair of different words one edit apart, from (word, n)."""
    level = materialize(_entries(words), "variants-entries")
    settled = []
    while True:
        crowded = materialize(
            level.where("hi - lo > 1").groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > CROWD)
            .select("key", F.lit(True).alias("crowded")), "variants-crowded")
        if crowded.isEmpty():
            settled.append(level)
            break
        marked = lookup(level, crowded, ["key"], F.col("word"))
        settled.append(marked.where("crowded is null").drop("crowded"))
        level = materialize(_finer(marked.where("crowded")), "variants-entries")
    entries = settled[0]
    for more in settled[1:]:
        entries = entries.unionByName(more)
    blocks = max(1, -(-entries.count() // BLOCK))
    found = entries.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).groupBy("block").applyInArrow(
        _search, "word string, near string, near_n long")
    # One shuffle by word serves the distinct pairs and what is computed per word.
    return found.repartition("word").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the rows (word, form): every round doubles the steps that are followed."""
    walked = materialize(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        ahead = walked.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialize(walked.join(ahead, "root", "left"), "variants-roots")
        if moved.where("further is not null").isEmpty():
            return walked
        walked = moved.select("word", F.coalesce("further", "root").alias("root"))


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the rows (word, n): distinct words and how often they occur."""
    words = materialize(words.select("word", "n"), "variants-words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    likes = -F.col("best.minus") >= ratio * F.col("n")
    out = materialize(words.join(near, "word", "left").select(
        "word", F.when(likes, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(likes, -F.col("best.minus")).alias("form_n")), "variants-forms")
    roots = _roots(out.where("form is not null"))
    return out.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
