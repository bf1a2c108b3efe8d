"""Language-model scores: base score by a plain count, gradients by differences, every token scored once, odds of 1."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from alertloom.llm import attention, lm

VOCAB = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def net(seed=3):
    rng = np.random.default_rng(seed)
    n = attention.Network(rng.random(attention.SIZE) * 50)
    n.set([p + rng.normal(0, 0.1, p.shape).astype(np.float32) for p in n.parameters()])
    return n


def plain_log10(n, ids):
    """Token by token, with the context that the window of its block gives."""
    out = []
    for at, target in enumerate(ids):
        begin = at // attention.STEP * attention.STEP - (attention.KEYS - attention.STEP + 1)
        seen = [ids[i] if i >= 0 else attention.BEGIN for i in range(begin, at)]
        keys, now = seen[-attention.KEYS:], seen[-1]
        a = [float(n.query[now] @ n.key[k]) + float(n.distance[len(keys) - 1 - i]) for i, k in enumerate(keys)]
        a = np.exp(np.array(a) - max(a))
        value = (a / a.sum()) @ n.value[keys].astype(np.float64)
        h = np.maximum(value @ n.mix + n.now[now] + n.before[seen[-2]] + n.bias, 0)
        g = h @ n.group + n.group_bias
        c, m = divmod(target, attention.WIDTH)
        inner = np.maximum(h @ n.inner + n.inner_of[c], 0) @ n.member + n.member_bias[c]
        soft = lambda z: z - z.max() - math.log(np.exp(z - z.max()).sum())
        out.append((soft(g)[c] + soft(inner)[m]) / math.log(10))
    return out


def test_windows_score_every_token_once_as_a_plain_walk_does():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, attention.SIZE, k).astype(np.int16) for k in (1, 15, 16, 17, 70, 0, 33)]
    stream, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    text, nth = attention.blocks(sizes)
    windows, weight = attention.cut(stream, np.cumsum(sizes) - sizes, sizes, text, nth)
    assert weight.sum() == sizes.sum()
    n = net()
    logs = n.log10(windows)
    for i, ids in enumerate(texts):
        assert np.allclose(logs[text == i][weight[text == i]], plain_log10(n, ids.tolist()), atol=1e-4)


def test_probabilities_of_all_ids_add_up_to_one():
    n = net(4)
    windows = np.tile(np.arange(attention.SPAN, dtype=np.int16), (attention.SIZE, 1))
    windows[:, attention.KEYS] = np.arange(attention.SIZE)
    assert abs((10.0 ** n.log10(windows)[:, -1].astype(np.float64)).sum() - 1) < 1e-3


def test_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(2)
    windows = rng.integers(0, attention.SIZE, (5, attention.SPAN)).astype(np.int16)
    weight = rng.random((5, attention.STEP)) < 0.8
    n = net(5)
    n.set([p.astype(np.float64) for p in n.parameters()])
    loss = lambda: -(n.log10(windows).astype(np.float64) * weight).sum() / weight.sum() * math.log(10)
    for name, g in zip(n.NAMES, n.gradients(windows, weight)):
        p = getattr(n, name)
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept = p[at]
        p[at] = kept + 1e-2
        up = loss()
        p[at] = kept - 1e-2
        down = loss()
        p[at] = kept
        assert abs((up - down) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 2e-4, name


def test_classes_are_a_permutation():
    rng = np.random.default_rng(6)
    pairs = rng.poisson(0.1, (attention.SIZE + 1, attention.SIZE)).astype(np.float32)
    assert sorted(attention.classes(pairs, pairs.sum(axis=0))) == list(range(attention.SIZE))


def base(rows, held):
    words = [WORD.findall((t or "").translate(LOWER)) for _, t in rows]
    c = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    ends = held.count(False)
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    rate = lambda k: math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
    return n, [(len(ws) + 1, sum(c[w] > 0 for w in ws) + (ends > 0), sum(map(rate, (c[w] for w in ws))) + rate(ends))
               for ws in words]


@pytest.mark.parametrize("hot", [1 << 17, 3])
def test_frequencies_equal_a_plain_count(spark, monkeypatch, hot):
    """With three frequent words all the others go through the join."""
    monkeypatch.setattr(lm, "HOT", hot)
    rng = random.Random(hot)
    texts = [None, "", " \t", "One two", "one TWO three", "x" * 3000 + "é" * 3000, "日本語 ΣΑΣ ñandú"] + [
        " ".join(rng.choices(["the", "Of", "and", "ceux", "là", "w7", "£4"], k=rng.randrange(60))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(3, "One two"), (None, "lost words")]
    held = [i is None or zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    frame = spark.createDataFrame([(*r, h, 0, "") for r, h in zip(rows, held)],
                                  "doc_id long, text string, held boolean, Train int, _row string")
    out = lm.score(frame, ~F.col("held"), VOCAB).collect()
    n, want = base(rows, held)
    key = lambda r: (str(r[0]), r[1], round(r[3], 6))
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in out), key=key)
    want = sorted(((i, *w) for (i, _), w in zip(rows, want)), key=key)
    assert {r["train_tokens"] for r in out} == {n}
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-9 * max(1, abs(w[3]))
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)


def test_it_learns_order_that_frequencies_cannot_know(spark):
    rng = random.Random(8)
    cycle = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    def made():
        at = rng.randrange(6)
        return " ".join(cycle[(at + k) % 6] for k in range(rng.randrange(20, 60)))
    rows = [(i, made(), i % 5 == 0) for i in range(600)]
    out = lm.score(spark.createDataFrame(rows, "doc_id long, text string, held boolean"), ~F.col("held"), VOCAB).collect()
    held = [r for r in out if r["doc_id"] % 5 == 0]
    assert sum(r["score"] for r in held) > 0.35 * sum(r["base_score"] for r in held)


def test_nothing_to_learn_from_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in lm.score(frame, F.lit(None).cast("boolean"), VOCAB).collect()}
    assert out[1]["train_tokens"] == 0 and out[1]["n_known"] == 0 and out[1]["n_tokens"] == 3
    assert out[2]["n_tokens"] == 1 and out[2]["base_score"] == 0 and out[1]["score"] < out[2]["score"] < 0
    assert lm.score(frame.limit(0), F.lit(True), VOCAB).count() == 0


def test_rounds_take_every_training_window_and_pairs_are_counted_in_all():
    """Of a corpus too large to be gone through every time, each window is in exactly one round."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = [rng.integers(0, attention.SIZE, n).astype(np.int16) for n in [0, 1, 17, 40_000, 300_000]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts)), pa.int64()), pa.array([t.tobytes() for t in texts], pa.binary())], names=["row", "ids"])
    bounds = [*lm.ROUNDS, lm.PARTS]
    assert bounds[0] == 0 and bounds == sorted(bounds)
    keys = [k for a, b in zip(bounds, bounds[1:]) for key, _, _ in lm._chosen(batch, a, b - a) for k in key]
    assert sorted(keys) == sorted(k for key, _, _ in lm._chosen(batch, 0, lm.PARTS) for k in key)
    assert len(keys) == sum(-(-len(t) // attention.STEP) for t in texts)


def test_pairs_of_ids_are_those_of_all_training_documents(spark):
    texts = [[5, 5, 7], [], [7], [1, 2, 3, 4] * 30]
    rows = [(i, bytearray(np.array(t, np.int16).tobytes())) for i, t in enumerate(texts)]
    got = lm._pairs(spark.createDataFrame(rows, "row long, ids binary").repartition(3))
    want = np.zeros_like(got)
    for t in texts:
        for a, b in zip([attention.BEGIN, *t], t):
            want[a, b] += 1
    assert (got == want).all()


def test_a_fit_that_goes_on_equals_one_that_was_not_cut():
    rng = np.random.default_rng(4)
    windows = rng.integers(0, attention.SIZE, (512, attention.SPAN)).astype(np.int16)
    weight = np.ones((512, attention.STEP), bool)
    state, net = None, attention.Network(np.ones(attention.SIZE))
    for at in (0, 256):
        state = net.train(windows[at:at + 256], weight[at:at + 256], 0.01, 1, state=state)
    assert state[0] == 4 and any(m.any() for m, _ in state[1])


def test_pairs_are_the_odds_that_a_network_starts_from():
    """Without any fit, what follows an id is as likely as it was counted, whatever the classes are."""
    rng = np.random.default_rng(9)
    pairs = np.zeros((attention.SIZE + 1, attention.SIZE))
    pairs[3, [10, 900]] = 3000, 1000
    pairs[attention.BEGIN, 5] = 50
    n = attention.Network(np.ones(attention.SIZE), pairs=pairs)
    n.set([np.zeros_like(p) for p in n.parameters()])
    windows = rng.integers(0, attention.SIZE, (4, attention.SPAN)).astype(np.int16)
    windows[:, attention.KEYS - 1:] = [(3, 10), (3, 900), (3, 11), (attention.BEGIN, 5)]
    got = 10.0 ** n.log10(windows)[:, -1]
    want = [3000 / 4002, 1000 / 4002, 2 / 4002 / attention.SIZE, 50 / 51]
    assert np.allclose(got, want, rtol=2e-3, atol=1e-9)


def test_gradients_are_the_slopes_of_the_loss_with_pairs():
    rng = np.random.default_rng(10)
    windows = rng.integers(0, attention.SIZE, (5, attention.SPAN)).astype(np.int16)
    weight = rng.random((5, attention.STEP)) < 0.8
    pairs = rng.poisson(0.05, (attention.SIZE + 1, attention.SIZE))
    n = attention.Network(pairs.sum(axis=0), pairs=pairs)
    n.set([(p + rng.normal(0, 0.1, p.shape)).astype(np.float64) for p in n.parameters()])
    n.next_group, n.next_member = n.next_group.astype(np.float64), n.next_member.astype(np.float64)
    loss = lambda: -(n.log10(windows).astype(np.float64) * weight).sum() / weight.sum() * math.log(10)
    for name, g in zip(n.NAMES, n.gradients(windows, weight)):
        p = getattr(n, name)
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept = p[at]
        p[at] = kept + 1e-2
        up = loss()
        p[at] = kept - 1e-2
        down = loss()
        p[at] = kept
        assert abs((up - down) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 2e-4, name


def test_the_fit_places_pairs_as_it_places_ids(spark):
    """Ids that always follow each other are likely before anything is learned, in whatever places the classes put them."""
    rng = random.Random(11)
    cycle = rng.sample(range(attention.SIZE), 40)
    rows = [(i, bytearray(np.array([cycle[(i + k) % 40] for k in range(33)], np.int16).tobytes()), True) for i in range(40)]
    counts = np.bincount([k for _, b, _ in rows for k in np.frombuffer(b, np.int16)], minlength=attention.SIZE)
    net, places = lm.fit(spark.createDataFrame(rows, "row long, ids binary, train boolean"), counts)
    assert sorted(places) == list(range(attention.SIZE + 1))
    nexts = {cycle[i]: cycle[(i + 1) % 40] for i in range(40)}
    for now, after in nexts.items():
        at, group = places[now], places[after] // attention.WIDTH
        odds = net.next_group[at, group] + net.next_member[at * attention.WIDTH + group, places[after] % attention.WIDTH]
        assert odds > math.log(0.8)
