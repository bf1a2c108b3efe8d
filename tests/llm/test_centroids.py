"""Centroid clustering against plain rounds in Python."""

import hashlib
import math
import random

import numpy as np

from alertloom.llm import centroids


def plain(rows, k, rounds, scale, dims):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cents = [v for _, v in starts]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, members in groups.items():
            cents[n] = [sum(c) // len(members) for c in zip(*members)]
    found = [(i, *near(v)) for i, v in kept]
    within = {n: sum(d for _, d, m in found if m == n) for n in range(len(cents))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    top = (1 << 63) - 1
    return sorted(((i, n, min(d, top), min(within[n], top), min(sum(within.values()), top), digest[n])
                   for i, d, n in found), key=str)


def run(spark, rows, **args):
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cluster int")
    out = centroids.cluster(frame, **args)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_clusters_equal_plain_rounds_with_ties_repeats_and_bad_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(300)]  # many ties
    rows += rows[:20] + [(None, [0.1, 0.2, 0.3]), (900, None), (901, [1.0, 2.0]), (902, [1.0, None, 0.0]),
                         (903, [float("nan"), 0.0, 0.0]), (904, [0.0, float("inf"), 0.0]), (905, [])]
    for k, rounds in ((1, 2), (7, 4), (40, 3)):
        args = dict(k=k, rounds=rounds, scale=1024, dims=3)
        assert run(spark, rows, **args) == plain(rows, **args)


def test_components_far_beyond_32_bits(spark):
    rows = [(i, [x, -x, 1.0]) for i, x in enumerate([1e9, 1e9 + 1, -3e14, 2e15, 2e15 - 2, 0.0])]
    args = dict(k=3, rounds=5, scale=1024, dims=3)
    assert run(spark, rows, **args) == plain(rows, **args)


def test_few_or_no_vectors(spark):
    args = dict(k=8, rounds=2, scale=1024, dims=2)
    assert run(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])], **args) == plain([(1, [0.5, 0.5]), (2, [0.5, 0.5])], **args)
    assert run(spark, [(1, None)], **args) == []
    assert run(spark, [(None, [1.0, 1.0])], **args) == []


def test_the_tree_finds_the_nearest_and_skips_centroids():
    rng = np.random.default_rng(3)
    middles = rng.integers(-4000, 4000, (12, 6))
    cents = (middles[rng.integers(0, 12, 400)] + rng.integers(-40, 40, (400, 6))).astype(np.int64)
    cents[50] = cents[7]
    vectors = np.concatenate([cents + rng.integers(-9, 9, cents.shape), rng.integers(-5000, 5000, (100, 6))])
    number, best, seen = centroids.VantageTree(cents).nearest(vectors)
    far = ((vectors[:, None] - cents[None]) ** 2).sum(axis=2)
    assert (number == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()
    assert seen < 0.5 * far.size
