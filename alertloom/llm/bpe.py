"""Byte-pair encoding with a given public vocabulary: speculate, verify, and merge exactly only where needed.

A word's tokens are proposed by greedy longest match. A proposal is the result of the merges exactly if every
adjacent pair of tokens is compatible, that is, if encoding the two tokens' letters gives these two tokens
again. All pairs of all new words of a batch are tested at once in numpy: the merges inside the left token's
right edge and the right token's left edge are undone from the latest to the earliest, and a pair is
incompatible if a merge across the border would have come before one of them. Only words with such a pair go
through the merges one by one, with a heap, in n log n steps.

The vocabulary is a tokenizer file of the "word ends" kind: NFC, white space folded, lower case, words split by
a fixed pattern, bytes as letters, ``</w>`` at word ends. It is read where the code runs: the path must exist on
every executor, as it does for an installed package.

Defined cases: null counts as empty and has no tokens and an empty decoded text. Special tokens' strings in the
text become these tokens. Lone or repeated rows need no care, a row depends on its text only. Memory per worker
is bounded by one Arrow batch and a memo of MEMO words.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MEMO = 400_000
#: Bytes of text whose new words are encoded together.
STEP = 1 << 22
END = "</w>"


def byte_letters() -> list[str]:
    """The letter for each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _class(test, top: int) -> str:
    """Body of a character class of all code points up to ``top`` that pass the test, as ranges."""
    out, start = [], None
    for c in range(top + 2):
        good = c <= top and test(chr(c))
        if good and start is None:
            start = c
        elif not good and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=1)
def patterns() -> tuple[re.Pattern, list[re.Pattern], re.Pattern]:
    """(white space, words, signs beyond the basic plane). Words: contractions, runs of letters, single digits,
    runs of other signs; for texts of ASCII only, of the basic plane, and of any signs."""
    space = "\\t-\\r \\x85" + _class(lambda c: unicodedata.category(c)[0] == "Z", sys.maxunicode)
    words = []
    for top in (0x7F, 0xFFFF, sys.maxunicode):
        letter, number = (_class(lambda c, k=k: unicodedata.category(c)[0] == k, top) for k in "LN")
        words.append(re.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+"))
    return re.compile(f"[{space}]+"), words, re.compile("[\U00010000-\U0010ffff]")


class Vocabulary:
    """Tokens, merge ranks and lookup tables of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.tokens = [""] * size
        for token, i in chain(self.ids.items(), self.special.items()):
            self.tokens[i] = token
        self.ranks = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank = np.full(size, -1)
        for (a, b), (rank, token) in self.ranks.items():
            if self.rank[token] < 0:
                self.left[token], self.right[token], self.rank[token] = a, b, rank
        keys = np.array([a * size + b for a, b in self.ranks], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.size = np.append(keys[order], np.iinfo(np.int64).max), size
        self.pair_ranks = np.append(np.arange(len(keys))[order], len(keys))
        self.letters = byte_letters()
        self.table = {b: c for b, c in enumerate(self.letters)}
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        unfit = self._unfit()
        fit = {t: i for t, i in self.ids.items() if i not in unfit}
        #: Tokens within and at the end of a word, and all beginnings of either.
        self.inner = {t: i for t, i in fit.items() if not t.endswith(END)}
        self.final = {t.removesuffix(END): i for t, i in fit.items() if t.endswith(END)}
        self.begins = {t[:k] for t in chain(self.inner, self.final) for k in range(1, len(t))}
        self.memo: dict[str, bytes] = {}

    def _unfit(self) -> set[int]:
        """Tokens that their own letters are not merged into; never proposed."""
        merged = np.flatnonzero(self.rank >= 0)
        bad = merged[~self.compatible(self.left[merged], self.right[merged], self.rank[merged])]
        return set(bad.tolist())

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge across the border of tokens a and b comes before the merges inside them.

        ``limit`` is the rank from which on merges across do not count.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(a), dtype=bool)
        bound = np.full(len(a), len(self.pair_ranks), dtype=np.int64) if limit is None else limit.astype(np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.size + y
            at = np.searchsorted(self.pair_keys, key)
            across = np.where(self.pair_keys[at] == key, self.pair_ranks[at], len(self.pair_ranks))
            fails = across < bound[live]
            good[live[fails]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_left = rx > ry  # with equal ranks the left merge came first, so the right one is undone first
            # A merge across must come before the left one, or not after the right one, to have prevented it.
            bound[live] = np.minimum(bound[live], np.where(undo_left, rx, ry + 1))
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            live = live[~fails & (np.maximum(rx, ry) >= 0)]
        return good

    def propose(self, word: str) -> list[int]:
        """Greedy longest match over the letters of a word; every letter is a token, so it always ends."""
        out, at, n = [], 0, len(word)
        inner, final, begins = self.inner, self.final, self.begins
        while at < n:
            token, to, end = -1, at, at + 1
            while True:
                part = word[at:end]
                if part in inner and end < n:
                    token, to = inner[part], end
                if end == n:
                    if part in final:
                        token, to = final[part], n
                    break
                if part not in begins:
                    break
                end += 1
            out.append(token)
            at = to
        return out

    def merge(self, word: str) -> list[int]:
        """The merges in order of rank, leftmost first."""
        parts = [self.ids[c] for c in word[:-1]] + [self.ids[word[-1] + END]]
        if len(parts) > 32:
            return self._merge_long(parts)
        ranks, none = self.ranks, (len(self.ranks), -1)
        found = [ranks.get(pair, none) for pair in zip(parts, parts[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            i = found.index(best)
            parts[i] = best[1]
            del parts[i + 1], found[i]
            if i:
                found[i - 1] = ranks.get((parts[i - 1], parts[i]), none)
            if i < len(found):
                found[i] = ranks.get((parts[i], parts[i + 1]), none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same in n log n steps: a heap of pairs over a linked list."""
        after = [*range(1, len(parts)), -1]
        before = list(range(-1, len(parts) - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (found := self.ranks.get((parts[i], parts[j]))):
                heapq.heappush(heap, (found[0], i, parts[i], parts[j], found[1]))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, x, y, token = heapq.heappop(heap)
            j = after[i] if parts[i] == x else -1
            if j < 0 or parts[j] != y:
                continue
            parts[i], parts[j] = token, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p >= 0]

    def learn(self, words: set[str]) -> None:
        """Encode new words into the memo."""
        fresh = list(words)
        lettered = [w.encode("utf-8", "replace").decode("latin-1").translate(self.table) for w in fresh]
        guesses = [self.propose(w) for w in lettered]
        sizes = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter(chain.from_iterable(guesses), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(guesses)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        keys, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        wrong = ~self.compatible(keys // self.size, keys % self.size)[back]
        for i in np.unique(owner[inner[wrong]]).tolist():
            guesses[i] = self.merge(lettered[i])
        self.memo.update((w, array("i", g).tobytes()) for w, g in zip(fresh, guesses))

    def words(self, text: str) -> list[str]:
        """Normalized words of a text; special tokens stay as they are."""
        if "<|" not in text or not self.split.search(text):
            return self._words(text)
        out, at = [], 0
        for found in self.split.finditer(text):
            out += self._words(text[at:found.start()])
            out.append(found[0])
            at = found.end()
        return out + self._words(text[at:])

    @staticmethod
    def _words(text: str) -> list[str]:
        space, words, beyond = patterns()
        if text.isascii():
            return words[0].findall(text.lower())
        text = space.sub(" ", unicodedata.normalize("NFC", text))
        text = text.replace("\u03a3", "\u03c3").lower()  # lower case letter by letter, without the final sigma
        return words[2 if beyond.search(text) else 1].findall(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as 32-bit integers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            size, parts = 0, []
            while at < len(texts) and (size < STEP or not parts):
                parts.append(self.words(texts[at] or ""))
                size += len(texts[at] or "")
                at += 1
            if len(self.memo) > MEMO or not self.memo:
                self.memo = {t: array("i", [i]).tobytes() for t, i in self.special.items()}
            fresh = set().union(*parts).difference(self.memo)
            if fresh:
                self.learn(fresh)
            out += [b"".join(map(self.memo.__getitem__, p)) for p in parts]
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by blanks, as a vocabulary without a decoder is decoded."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _with(df: DataFrame, new: list[T.StructField]) -> tuple[T.StructType, list[str]]:
    """Schema of ``df`` followed by new columns, which replace columns of the same name; names kept."""
    names = {f.name.lower() for f in new}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    return T.StructType([*kept, *new]), [f.name for f in kept]


def encode(
    df: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = None
) -> DataFrame:
    """Append the token ids of a text column, and the text decoded from them if ``decoded_col`` is given."""
    new = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))]
    if decoded_col:
        new.append(T.StructField(decoded_col, T.StringType()))
    schema, kept = _with(df, new)

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = vocab.encode(texts.slice(at, 1000).to_pylist())
                sizes = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])])
                flat = np.frombuffer(b"".join(found), np.int32)
                cols = [part.column(part.schema.get_field_index(k)) for k in kept]
                cols.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat)))
                if decoded_col:
                    cols.append(pa.array([vocab.decode(array("i", x)) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """Append the text of a column of token ids; null ids give null, ids outside the vocabulary are left out."""
    schema, kept = _with(df, [T.StructField(text_col, T.StringType())])

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            texts = [None if x is None else vocab.decode([i for i in x if i is not None and 0 <= i < vocab.size])
                     for x in lists]
            cols = [batch.column(batch.schema.get_field_index(k)) for k in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)
