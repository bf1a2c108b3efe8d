"""Centroid clustering: Lloyd's rounds with exact integer distances and a vantage-point tree over the centroids.

Each round builds a tree over the current centroids on the driver and broadcasts it. Every vector searches it best
first: the open node with the smallest lower bound is taken next, its vantage centroid is compared exactly, its two
children get bounds from the triangle inequality, and a search ends when no open bound is within the best distance.
Pruning is inclusive: a bound that equals the best distance stays open, since it may hide a tie with a smaller number.
The searches of a batch advance together in numpy, one node per vector and step.

A task adds up the vectors of its partition per centroid; what is shuffled is one sum per task, centroid and component,
so a centroid that holds a third of all vectors is added up where they lie. Tree and sums are bounded by
``k * dims <= LIMIT`` numbers, which is checked. Every round reads the written vectors again, so a lost executor costs
the tasks it ran.

Components x become floor(scale * x), x as double. Centroids start as the k vectors with the smallest hexadecimal
SHA-256 of ``salt`` followed by the id; an empty centroid stays where it is; means are exact floors.

Defined cases: vectors that are null, have null or non-finite components or another number of components than ``dims``
take no part. A null id is clustered but is never a start. Repeated rows are vectors of their own, as starts too; of
equal hashes the smaller vector starts first. Fewer vectors than k give fewer centroids, none give no rows. Ties go to
the centroid with the smaller number. Components are limited to 62 bits; distances and sums are exact beyond 64 bits
inside and clipped to the range of a long in the result. Columns other than id and vector are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .topk import quantised

#: Numbers that the centroids may have together: 32 MB.
LIMIT = 1 << 22
#: Vectors that search the tree together.
CHUNK = 4_096
#: Relative slack of bounds in floating point, far above the error of two square roots.
SLACK = 1e-12
LONG = (1 << 63) - 1


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``a`` and ``b``: 64-bit if that holds them, Python integers otherwise."""
    high = max((abs(int(x.max())) + abs(int(x.min())) for x in (a, b) if x.size), default=0)
    kind = np.int64 if 4 * high * high * max(a.shape[-1], 1) < 1 << 62 else object
    step = a.astype(kind) - b.astype(kind)
    return (step * step).sum(axis=-1)


class VantageTree:
    """Nodes in arrays. A node has a vantage centroid and two children, each with its shell: the smallest and the
    largest distance of the child's centroids from the vantage centroid."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.vantage: list[int] = []
        self.child: list[list[int]] = []
        self.shell: list[list[tuple[float, float]]] = []
        waiting = [(np.arange(len(centroids)), None, 0)] if len(centroids) else []
        while waiting:
            members, parent, side = waiting.pop()
            node = len(self.vantage)
            if parent is not None:
                self.child[parent][side] = node
            first, rest = int(members[0]), members[1:]
            self.vantage.append(first)
            self.child.append([-1, -1])
            self.shell.append([(0.0, 0.0), (0.0, 0.0)])
            if not len(rest):
                continue
            far = squared(centroids[rest], centroids[first][None])
            order = np.argsort(far, kind="stable")
            for part, side in ((order[:(len(order) + 1) // 2], 0), (order[(len(order) + 1) // 2:], 1)):
                if len(part):
                    roots = np.sqrt(far[part].astype(np.float64))
                    self.shell[node][side] = (float(roots.min()), float(roots.max()))
                    waiting.append((np.sort(rest[part]), node, side))
        self.vantage_of = np.array(self.vantage, np.int64)
        self.child_of = np.array(self.child, np.int64).reshape(-1, 2)
        self.shell_of = np.array(self.shell, np.float64).reshape(-1, 2, 2)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of every vector's nearest centroid, and how many distances were computed."""
        parts = [self._search(vectors[at:at + CHUNK]) for at in range(0, len(vectors), CHUNK)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), sum(p[2] for p in parts)

    def _search(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        n = len(vectors)
        number, best = np.full(n, -1, np.int64), np.zeros(n, object)
        root = np.full(n, np.inf)
        # Open nodes of each vector: a popped node's slot goes to its first child, the second child gets a new one.
        bounds, nodes = np.zeros((n, 1)), np.zeros((n, 1), np.int64)
        live, seen = np.arange(n), 0
        while len(live):
            slot = bounds[live].argmin(axis=1)
            keep = bounds[live, slot] <= root[live]
            live, slot = live[keep], slot[keep]
            if not len(live):
                break
            node = nodes[live, slot]
            vantage = self.vantage_of[node]
            far = squared(vectors[live], self.centroids[vantage])
            seen += len(live)
            nearer = (number[live] < 0) | (far < best[live]) | ((far == best[live]) & (vantage < number[live]))
            nearer = nearer.astype(bool)
            number[live[nearer]], best[live[nearer]] = vantage[nearer], far[nearer]
            d = np.sqrt(far.astype(np.float64))
            root[live[nearer]] = d[nearer] * (1 + SLACK)
            low, high = self.shell_of[node, :, 0], self.shell_of[node, :, 1]
            apart = np.maximum(np.maximum(d[:, None] - high, low - d[:, None]), 0) - SLACK * (d[:, None] + high)
            apart[self.child_of[node] < 0] = np.inf
            bounds[live, slot], nodes[live, slot] = apart[:, 0], self.child_of[node, 0]
            if np.isfinite(apart[:, 1]).any():
                bounds = np.concatenate([bounds, np.full((n, 1), np.inf)], axis=1)
                nodes = np.concatenate([nodes, np.zeros((n, 1), np.int64)], axis=1)
                bounds[live, -1], nodes[live, -1] = apart[:, 1], self.child_of[node, 1]
        return number, best, seen


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _next(vectors: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """The floors of the means of what each centroid gets; one job, its result has k times dims rows at most."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(VantageTree(np.array(centroids, np.int64)))

    def add(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            v = _matrix(batch.column("v"), dims)
            number, _, _ = shared.value.nearest(v)
            wide = v.size and int(np.abs(v).max()) * len(v) >= 1 << 62
            for c in np.unique(number).tolist():
                mine = v[number == c]
                total = sums.setdefault(c, [0, [0] * dims])
                total[0] += len(mine)
                part = (mine.astype(object) if wide else mine).sum(axis=0).tolist()
                total[1] = [x + y for x, y in zip(total[1], part)]
        rows = [(c, d, n, str(x)) for c, (n, total) in sums.items() for d, x in enumerate(total)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.string()))],
            names=["cluster", "dim", "n", "total"])

    parts = vectors.select("v").mapInArrow(add, "cluster int, dim int, n long, total string")
    found = parts.groupBy("cluster", "dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    out = [list(c) for c in centroids]
    for r in found:
        out[r["cluster"]][r["dim"]] = int(r["total"]) // r["n"]
    shared.destroy()
    return out


def _starts(usable: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The vectors of the k smallest hashes. A bound on the first digits keeps what tasks send to about 4 k vectors."""
    hashed = usable.where("id is not null").withColumn("h", F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256))
    n = hashed.count()
    for bound in (f"{min((1 << 32) - 1, (4 * k + 64) * (1 << 32) // max(n, 1)):08x}", "g"):
        found = hashed.where(F.substring("h", 1, 8) <= bound).orderBy("h", "v").limit(k).select("v").collect()
        if len(found) == min(k, n):
            break
    return [list(r["v"]) for r in found]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, salt: str = "3:",
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    if k < 1 or rounds < 0 or k * dims > LIMIT:
        raise ValueError(f"k of at least 1, no negative rounds, k * dims of at most {LIMIT}")
    usable = materialize(
        vectors.select(F.col(id_col).alias("id"), quantised(F.col(vector_col), scale).alias("v"))
        .where(F.size("v") == dims), "centroids-vectors")
    centroids = _starts(usable, k, salt)
    for _ in range(rounds if centroids else 0):
        moved = _next(usable, centroids, dims)
        if moved == centroids:
            break  # every further round would give the same
        centroids = moved
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(VantageTree(np.array(centroids, np.int64).reshape(-1, dims)))

    def assign(batches):
        for batch in batches:
            number, far, _ = shared.value.nearest(_matrix(batch.column("v"), dims))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(number, pa.int32()), pa.array([str(x) for x in far], pa.string())],
                names=["id", "cluster", "far"])

    kind = usable.schema["id"].dataType.simpleString()
    placed = materialize(
        usable.where(F.lit(bool(centroids))).mapInArrow(assign, f"id {kind}, cluster int, far string")
        .select("id", "cluster", F.col("far").cast("decimal(38,0)").alias("far")), "centroids-placed")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    names = spark.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    clip = lambda c: F.least(c, F.lit(LONG).cast("decimal(38,0)")).cast("long")
    sums = placed.groupBy("cluster").agg(F.sum("far").alias("within"))
    whole = sums.agg(F.sum("within").alias("all"))
    # Both have k rows at most, and k is bounded.
    about = sums.join(F.broadcast(names), "cluster").join(F.broadcast(whole))
    return placed.join(F.broadcast(about), "cluster").select(
        F.col("id").alias(id_col), "cluster", clip(F.col("far")).alias("distance"),
        clip(F.col("within")).alias("cluster_inertia"), clip(F.col("all")).alias("inertia"), "centroid_sha256")
