"""Exact top-k by inner product with Fagin's threshold algorithm.

The corpus is cut into blocks. Within a block every dimension has a list of the vectors sorted by that component. A
query walks all lists at once, each from the end that its own component favours; every vector met is scored in full
(random access), and the walk stops as soon as the bound, the score of an imaginary vector made of the components the
lists have reached, is below the kth best score so far. The best of all blocks are merged per query.

Queries are grouped into tiles, and a tile meets every block by an equality join on the block number, so that
neither side is ever whole in one place: a task holds one block and one tile. Exact search without an index costs
queries times corpus at worst; what the bound saves depends on the data.

Components x are turned into floor(scale * x), x as double, and scores are exact integers.

Defined cases: vectors that are null or have null or non-finite components take no part, as queries or as candidates.
Missing components of a shorter vector count as 0. Ties go to the smaller id. A row never finds its own id; rows that
repeat an id and vector count once, rows of one id with different vectors are all searched and found. Null ids take
no part. Fewer candidates than k give fewer rows. Scores beyond the range of a long are clipped to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

#: Vectors of a block and queries of a tile, on average.
BLOCK, TILE = 16_384, 4_096
#: Positions of the lists that a walk reads at first; every round doubles them.
DEPTH = 128
#: Queries of a tile whose bounds are computed together.
CHUNK = 256


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of 64-bit integers, filled up with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims), np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def _exact(corpus: np.ndarray, queries: np.ndarray) -> np.dtype:
    """A type in which all inner products and their partial sums are exact."""
    high = [max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0 for m in (corpus, queries)]
    bound = high[0] * high[1] * max(corpus.shape[1], 1)
    return np.dtype(np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object)


class Block:
    """A block with its sorted lists. Rows are in order of id, so that the smaller index wins ties."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.vectors, self.lists, axis=0)

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int):
        """(query index, row index, score) of each query's k best."""
        n, dims = self.vectors.shape
        kind = _exact(self.vectors, queries)
        corpus, wanted, ranks = (m.astype(kind) for m in (self.vectors, queries, self.sorted))
        depths = [min(n, DEPTH)]
        while depths[-1] < n:
            depths.append(min(n, depths[-1] * 2))
        up = np.maximum(wanted, 0)
        down = wanted - up
        # Upper bound of what the lists hold beyond each depth; nothing is left beyond the last.
        beyond = np.array(depths[:-1], dtype=np.int64)
        bounds = up @ ranks[n - 1 - beyond].T + down @ ranks[beyond].T if len(beyond) else np.zeros((len(queries), 0))
        for q in range(len(queries)):
            favours = wanted[q] > 0
            live = np.flatnonzero(wanted[q] != 0)
            seen = np.zeros(n, bool)
            rows, scores = np.zeros(0, np.int64), np.zeros(0, kind)
            start = 0
            for r, depth in enumerate(depths):
                if depth == n or not len(live):
                    fresh = np.flatnonzero(~seen)
                else:
                    met = np.where(
                        favours[live], self.lists[n - depth:n - start][:, live], self.lists[start:depth][:, live])
                    mark = np.zeros(n, bool)
                    mark[met.ravel()] = True
                    fresh = np.flatnonzero(mark & ~seen)
                seen[fresh] = True
                start = depth
                mine = fresh[self.ids[fresh] != ids[q]]
                rows = np.concatenate([rows, mine])
                scores = np.concatenate([scores, corpus[mine] @ wanted[q]])
                if len(rows) > k:
                    kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                    pick = scores >= kth  # ties of the kth stay until the end
                    rows, scores = rows[pick], scores[pick]
                    # Nothing beyond can reach or tie the kth any more.
                    if r < bounds.shape[1] and bounds[q, r] < kth:
                        break
                if seen.all():
                    break
            best = np.lexsort((rows, -scores))[:k]
            for i in best:
                yield q, int(rows[i]), int(scores[i])


def quantised(vectors: Column, scale: int) -> Column:
    """floor(scale * x) of every component as long, or null if the vector takes no part."""
    doubles = vectors.cast("array<double>")
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    top = float(1 << 62)
    floor = F.transform(doubles, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(top)), F.lit(-top))))
    return F.when(vectors.isNotNull() & ~bad, floor)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that ``is_query`` marks, against all rows."""
    usable = materialize(
        vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"),
                       F.coalesce(is_query, F.lit(False)).alias("asks")).where("id is not null and v is not null"),
        "topk-vectors")
    size = usable.agg(F.count("*").alias("n"), F.count_if(F.col("asks")).alias("q"), F.max(F.size("v")).alias("dims")).first()
    blocks = max(1, -(-size["n"] // BLOCK))
    tiles = max(1, -(-size["q"] // TILE))
    dims = max(1, size["dims"] or 1)
    part = lambda n, *c: F.pmod(F.xxhash64("id", "v", *c), F.lit(n)).cast("int")
    corpus = usable.select("id", "v").distinct().select(
        part(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), "id", "v")
    asking = usable.where("asks").select("id", "v").distinct().select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), part(tiles, F.lit(1)).alias("tile"), "id", "v")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            block = Block(left.column("id").to_numpy(), _matrix(left.column("v"), dims))
            ids, queries = right.column("id").to_numpy(), _matrix(right.column("v"), dims)
            for at in range(0, len(ids), CHUNK):
                for q, row, score in block.search(ids[at:at + CHUNK], queries[at:at + CHUNK], k):
                    out[0].append(int(ids[at + q]))
                    out[1].append(int(block.ids[row]))
                    out[2].append(max(-(1 << 63), min((1 << 63) - 1, score)))
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    found = corpus.groupBy("block", "tile").cogroup(asking.groupBy("block", "tile")).applyInArrow(
        search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn(
        "rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
