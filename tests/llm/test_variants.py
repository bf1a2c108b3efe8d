"""Spelling variants against plain edit distances and a plain count."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from alertloom.llm import variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(counts, ratio=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def run(spark, counts, **args):
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    out = variants.group_variants(frame, **args)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(rng, n, alphabet, low, high):
    words = {"".join(rng.choices(alphabet, k=rng.randrange(low, high))) for _ in range(n)}
    return {w: rng.choice([1, 1, 2, 5, 6, 30, 150, 800]) for w in sorted(words)}


@pytest.mark.parametrize("crowd,block", [(2_048, 16_384), (4, 64)])
def test_groups_equal_plain_distances(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(variants, "CROWD", crowd)
    monkeypatch.setattr(variants, "BLOCK", block)
    rng = random.Random(crowd)
    counts = made(rng, 500, "abé", 1, 8) | made(rng, 100, "abÿ", 90, 92)
    long = "q" * 3000
    counts |= {long: 9, long + "r": 50, long[:-1] + "r": 400, "x": 3, "y": 15}
    assert run(spark, counts) == plain(counts)
    assert run(spark, counts, ratio=2) == plain(counts, 2)


def test_a_chain_of_forms_is_followed_to_its_end(spark):
    counts = {"a" * k: 5**k for k in range(1, 14)}
    assert {(w, r) for w, _, r, *_ in run(spark, counts)} == {(w, "a" * 13) for w in counts}


def test_no_task_holds_a_crowded_key(spark, monkeypatch):
    """A third of the words share their first half: cut finer, no block grows beyond a few crowds."""
    monkeypatch.setattr(variants, "CROWD", 64)
    monkeypatch.setattr(variants, "BLOCK", 256)
    rng = random.Random(4)
    words = {"commonbeginning" + "".join(rng.choices("abcdefgh", k=8)) for _ in range(1500)}
    words |= {"".join(rng.choices("abcdefgh", k=12)) for _ in range(3000)}
    sizes = []
    entries = spark.createDataFrame([(w, 1) for w in sorted(words)], "word string, n long")
    plain_search = variants._search

    def search(block):
        import pyarrow as pa
        keys = np.unique(block.column("key").to_numpy(), return_counts=True)[1]
        return pa.table({"word": [str(int(keys.max())), str(block.num_rows)], "near": ["key", "block"], "near_n": [1, 1]})

    monkeypatch.setattr(variants, "_search", search)
    for r in variants.near_words(entries).collect():
        sizes.append((r["near"], int(r["word"])))
    monkeypatch.setattr(variants, "_search", plain_search)
    assert max(n for kind, n in sizes if kind == "key") <= 64
    assert max(n for kind, n in sizes if kind == "block") <= 256 + 8 * 64


def test_counts_lose_letters_by_the_hash_of_id_and_run(spark):
    rng = random.Random(6)
    rows = [(i, "Wording ÀÉÎõüz, short words; wOrding_WORDING×÷ " * 30 + str(i)) for i in range(60)]
    rows += [(None, "wording " * 9), (7, None), (8, ""), (9, " \t\n")] + rows[:5]
    rows += [(100, "".join(rng.choices("abcdef ", k=20_000)))]
    frame = spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, text string, N int, word int")
    want = Counter()
    for i, text in rows:
        for run_ in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run_)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            want[w] += len(w) >= 6
    want = {w: n for w, n in want.items() if n >= 5}
    assert {r["word"]: r["n"] for r in variants.count_words(frame).collect()} == want
    got = {r["word"]: r["n"] for r in variants.count_words(frame, noise=None, least_count=1).collect()}
    assert got["wording"] == 65 * 30 * 2 + 9 and got["wording×÷"] == 65 * 30


def test_nothing_to_group(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group_variants(variants.count_words(frame)).count() == 0
