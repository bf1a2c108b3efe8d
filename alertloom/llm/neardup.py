"""Near-duplicate documents by HyperMinHash.

Every document becomes the set of its distinct word shingles, hashed to 64 bits. A register per bucket keeps
the leading-zero count and ten mantissa bits of the smallest hash in it. Bands of registers propose pairs, the
register estimate of the Jaccard similarity, corrected for accidental collisions, discards hopeless ones, and
the full sets confirm the rest.

Equal sets are one class before anything is compared, so a group of copies costs one row per class. Within a
band key every class is proposed to the key's smallest one and to a neighbour that agrees in the next band as well;
keys differ from band to band, so linked classes meet in many of them. No key emits all its pairs, and none is capped:
large keys are cut into groups of bounded size for the neighbour step, while the smallest class stays common to all.
Then a class that came within NEAR percent of a component is compared with all classes of that component, in blocks,
until that finds no new link. These are cheap first steps. Last, every key whose classes are not all in one component
by then is opened: all its pairs from different components are compared in blocks, by estimate and then by full sets,
and a block gives only the links that join what it holds. So each pair that shares a band key is compared or already
connected.

Defined cases: null and empty texts and texts of separators have an empty set and stay alone. Fewer words than
the shingle width make one shingle of the whole sequence. Rows that repeat a doc_id are the same document: one
node in the graph, and each row is returned. A null doc_id is linked with nothing and always kept. Other columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from . import textscan
from .common import components, lookup, small_enough

BANDS, ROWS = 48, 6
BUCKETS = BANDS * ROWS
MANTISSA = 10
#: Standard deviations of the estimate that a pair may lie below the threshold and still be confirmed.
SLACK = 6.0
#: Rows of one band key that are ordered together in the neighbour step.
GROUP = 1000
#: Percent below the threshold within which a class is compared with all of the other one's component.
NEAR = 4
#: Classes of either side that are compared together in a block of a component.
BLOCK = 400


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = textscan.text_bytes(texts)
    for lo, hi in textscan.pieces(offsets):
        starts, ends, first = textscan.word_bounds(data, offsets[lo:hi + 1])
        words = textscan.word_hashes(data, starts, ends, lower=True)
        rolled = textscan.fold(words, width)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= width:
                yield np.unique(rolled[a:b - width + 1])
            elif b > a:
                yield textscan.mix(textscan.fold(words[a:b], int(b - a)) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def registers(hashes: np.ndarray) -> np.ndarray:
    """Per bucket 0 if empty, else (leading zeros + 1) and the mantissa of the smallest hash, from sorted hashes."""
    out = np.zeros(BUCKETS, dtype=np.uint16)
    if len(hashes):
        place = (hashes >> np.uint64(11)).astype(np.float64) * (BUCKETS / 2.0**53)
        bucket = place.astype(np.int64)
        lead = np.concatenate([[True], bucket[1:] != bucket[:-1]])
        part, exponent = np.frexp(place[lead] - bucket[lead])
        zeros = np.where(part == 0, 62, np.minimum(-exponent, 62))
        digits = np.where(part == 0, 0, (part * 2 - 1) * (1 << MANTISSA))
        out[bucket[lead]] = ((zeros + 1) << MANTISSA) | digits.astype(np.int64)
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimate, buckets used) for rows of registers, less the collisions expected of unrelated sets."""
    used = ((a != 0) | (b != 0)).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1) / np.maximum(used, 1)
    chance = 0.72 / (1 << MANTISSA) * n_a * n_b / np.maximum(n_a + n_b, 1.0) ** 2
    return (same - chance) / (1 - chance), used


def sketches(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, h1, h2, registers): size, a 128-bit hash of the whole set, and the sketch."""

    def run(batches):
        for batch in batches:
            rows = []
            for hashes in shingle_sets(batch.column(1), width):
                again = textscan.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                rows.append((len(hashes), hashes.sum(dtype=np.uint64).view(np.int64),
                             again.sum(dtype=np.uint64).view(np.int64), registers(hashes).tobytes()))
            n, h1, h2, regs = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                 pa.array(regs, pa.binary())], names=["doc_id", "n_shingles", "h1", "h2", "registers"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, h1 long, h2 long, registers binary")


def _probes() -> np.ndarray:
    """For each try and bucket, the bucket that an empty one borrows from; the last tries visit all in turn."""
    tries = np.arange(1, 49, dtype=np.uint64)[:, None] << np.uint64(32)
    random = (textscan.mix(tries + np.arange(BUCKETS, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
    turn = (np.arange(BUCKETS)[None, :] + np.arange(1, BUCKETS)[:, None]) % BUCKETS
    return np.concatenate([random, turn])


def filled_up(regs: np.ndarray) -> np.ndarray:
    """Registers with their bucket numbers, empty ones borrowed from other buckets of the same row.

    Which bucket lends depends on the borrower and on which buckets are filled, so equal sets borrow equally and
    similar sets do so with about the probability of their similarity.
    """
    own = np.where(regs != 0, regs.astype(np.uint64) + (np.arange(BUCKETS, dtype=np.uint64) << np.uint64(16)), 0)
    out = own.copy()
    row, col = np.nonzero(own == 0)
    for probe in _probes():
        if not len(row):
            break
        lent = own[row, probe[col]]
        out[row, col] = lent
        left = lent == 0
        row, col = row[left], col[left]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """The key of each band, for rows of registers."""
    weights = textscan.mix(np.arange(1, ROWS + 1, dtype=np.uint64))
    salt = textscan.mix(np.arange(101, 101 + BANDS, dtype=np.uint64))
    full = textscan.mix(filled_up(regs)).reshape(-1, BANDS, ROWS)
    return textscan.mix((full * weights).sum(axis=2, dtype=np.uint64) + salt)


def band_rows(classes: DataFrame) -> DataFrame:
    """(key, band, id, n, next): a key for every band of registers, and the key of the band after it."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                regs = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(-1, BUCKETS)
                keys = band_keys(regs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)),
                     pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keys))),
                     *(pa.array(np.repeat(part.column(c).to_numpy(), BANDS)) for c in (0, 1)),
                     pa.array(np.roll(keys, -1, axis=1).ravel().view(np.int64))],
                    names=["key", "band", "id", "n", "next"])

    return classes.select("id", "n_shingles", "registers").mapInArrow(
        run, "key long, band int, id long, n long, next long")


def _only(df: DataFrame, ids: DataFrame) -> DataFrame:
    ids = materialize(ids, "neardup-ids")
    return df.join(F.broadcast(ids) if small_enough(ids) else ids, "id", "left_semi")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, set): the packed shingle hashes of rows (id, text)."""

    def sets(batches):
        for batch in batches:
            found = [x.tobytes() for x in shingle_sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "set"])

    return docs.mapInArrow(sets, "id long, set binary")


def _missed_links(docs: DataFrame, tried: DataFrame, labels: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) between classes that came near a component without joining it and any class of that component.

    These classes are compared with the whole component, block by block: a task holds the sets of BLOCK classes of
    either side on average and gives one link per class at most.
    """
    side = {s: labels.select(F.col("node").alias(s), F.col("component").alias(f"top_{s}")) for s in "ab"}
    missed = lookup(lookup(tried.where("not linked"), side["a"], ["a"], F.col("b")), side["b"], ["b"], F.col("a"))
    missed = missed.withColumn("own_a", F.coalesce("top_a", "a")).withColumn("own_b", F.coalesce("top_b", "b"))
    # A component of one class has been compared already.
    near = materialize(missed.where("own_a <> own_b").select(F.explode(F.array(
        F.struct(F.col("a").alias("id"), F.col("top_b").alias("component")),
        F.struct(F.col("b").alias("id"), F.col("top_a").alias("component")))).alias("m")).select("m.*")
        .where("component is not null").distinct(), "neardup-near")
    sizes = materialize(near.groupBy("component").agg(F.count("*").alias("asks")).join(
        labels.groupBy("component").agg(F.count("*").alias("size")), "component").select(
        "component", F.ceil(F.col("asks") / BLOCK).cast("int").alias("rows"),
        F.ceil(F.col("size") / BLOCK).cast("int").alias("cols")), "neardup-blocks")
    members = materialize(
        lookup(labels, sizes, ["component"], F.col("node"), "inner").withColumnRenamed("node", "id"), "neardup-members")
    full = materialize(_sets(_only(docs, near.select("id").unionByName(members.select("id"))), width), "neardup-sets")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = lookup(near, sizes, ["component"], F.col("id"), "inner").join(full, "id").select(
        "component", part("rows").alias("row"), every("cols").alias("col"), "id", "set")
    right = members.join(full, "id").select(
        F.col("component").alias("component"), every("rows").alias("row"), part("cols").alias("col"),
        F.col("id").alias("id"), F.col("set").alias("set"))

    def compare(asking: pa.Table, there: pa.Table) -> pa.Table:
        out = []
        if there.num_rows:
            sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in there.column("set").combine_chunks()]
            n, ids = np.array([len(x) for x in sets]), there.column("id").to_numpy()
            owner = np.repeat(np.arange(len(sets)), n)
            flat = np.concatenate(sets)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for i, v in zip(asking.column("id").to_pylist(), asking.column("set").combine_chunks()):
                mine = np.frombuffer(v.as_buffer(), np.uint64)
                lo, hi = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
                hits = np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange(int((hi - lo).sum()))
                both = np.bincount(owner[hits], minlength=len(sets))
                good = np.flatnonzero((100 * both >= percent * (len(mine) + n - both)) & (ids != i))
                if len(good):
                    j = int(ids[good[0]])
                    out.append((min(i, j), max(i, j)))
        return pa.table([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    keys = ["component", "row", "col"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "a long, b long").distinct()


def _hopeful(guess: np.ndarray, used: np.ndarray, percent: int) -> np.ndarray:
    """Whether an estimate leaves the similarity possible."""
    least = percent / 100.0
    return guess >= least - SLACK * np.sqrt(least * (1 - least) / np.maximum(used, 1))


def _joining(ids, tops, sets, regs, keys, band: int, left: np.ndarray, right: np.ndarray, percent: int):
    """Links (a, b) that join all classes of ``left`` and ``right`` that links between the two connect.

    All of them agree in ``band``; a pair that agrees in an earlier one is compared there. If both are the same
    classes, each pair is looked at once.
    """
    same = left is right
    n = np.array([len(x) for x in sets])
    root = tops.copy()
    index = None
    for at, i in enumerate(left):
        there = right[at + 1:] if same else right
        there = there[root[there] != root[i]]
        there = there[~(keys[there, :band] == keys[i, :band]).any(axis=1)]
        if len(there):
            guess, used = estimate(regs[there], regs[i][None, :], n[there], n[i])
            there = there[_hopeful(guess, used, percent)]
        if not len(there):
            continue
        if len(there) < 8:
            both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in there])
        else:
            if index is None:
                flat = np.concatenate([sets[j] for j in right])
                order = np.argsort(flat, kind="stable")
                index = flat[order], np.repeat(right, n[right])[order]
            flat, owner = index
            lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            hits = np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange(int((hi - lo).sum()))
            both = np.bincount(owner[hits], minlength=len(sets))[there]
        for j in there[100 * both >= percent * (n[i] + n[there] - both)]:
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                yield min(ids[i], ids[j]), max(ids[i], ids[j])


def _key_links(
    docs: DataFrame, classes: DataFrame, shared: DataFrame, labels: DataFrame, width: int, percent: int
) -> DataFrame:
    """(a, b): links between the components that meet in a band key, enough to connect what all such links connect.

    The rows of a key are dealt to parts of about BLOCK classes, and every two parts meet in a task; small keys share
    one. Keys of two classes have been compared already, those within one component add nothing, and of keys with the
    same classes the first band's is opened.
    """
    named = labels.select(F.col("node").alias("id"), F.col("component").alias("top"))
    rows = lookup(shared.where("size > 2").select("key", "band", "id"), named, ["id"], F.col("key")).withColumn(
        "top", F.coalesce("top", "id"))
    rows = materialize(rows, "neardup-tops")
    several = rows.groupBy("key", "band").agg(
        F.count("*").alias("size"), F.min("top").alias("low"), F.max("top").alias("high"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who")).where("low <> high")
    first = several.groupBy("who", "size").agg(F.min(F.struct("band", "key")).alias("m")).select(
        "m.key", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"))
    opened = materialize(lookup(rows, materialize(first, "neardup-several"), ["key"], F.col("id"), "inner"), "neardup-open")
    full = _sets(_only(docs, opened.select("id").distinct()), width).join(
        _only(classes, opened.select("id").distinct()).select("id", "registers"), "id")
    full = materialize(full, "neardup-open-sets")
    few = max(1, opened.where("parts = 1").count() // BLOCK)
    part = F.pmod(F.xxhash64("id", "key"), F.col("parts")).cast("int")
    blocks = opened.withColumn("part", part).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "key", "band", "id", "top", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"),
        F.when(F.col("parts") == 1, F.pmod(F.xxhash64("key"), F.lit(few))).otherwise(
            F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))).alias("task"))

    def compare(table: pa.Table) -> pa.Table:
        col = lambda name: table.column(name).to_numpy()
        order = np.lexsort((col("id"), col("q"), col("p"), col("key")))
        table = table.take(pa.array(order))
        key, p, q, part = col("key"), col("p"), col("q"), col("part")
        sets = [np.frombuffer(v.as_py(), np.uint64) for v in table.column("set")]
        regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        keys, ids, tops, band = band_keys(regs), col("id"), col("top"), col("band")
        leads = np.flatnonzero(np.append(True, (np.diff(key) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)))
        out = []
        for a, b in zip(leads, np.append(leads[1:], len(key))):
            left = right = np.arange(a, b)
            if p[a] != q[a]:
                left, right = left[part[a:b] == p[a]], right[part[a:b] == q[a]]
            out += _joining(ids, tops, sets, regs, keys, int(band[a]), left, right, percent)
        return pa.table([pa.array([int(x[k]) for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return blocks.join(full, "id").groupBy("task").applyInArrow(compare, "a long, b long").distinct()


def _confirm(docs: DataFrame, sketched: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, linked) for the rows of ``pairs`` whose full sets reach the similarity, or miss it by at most NEAR."""

    def near(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS)
                    for c in ("ra", "rb"))
            guess, used = estimate(a, b, batch.column("na").to_numpy(), batch.column("nb").to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(_hopeful(guess, used, percent)))

    def exact(batches):
        for batch in batches:
            good, close = [], []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
                close.append(100 * both >= (percent - NEAR) * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], names=["a", "b", "linked"]
            ).filter(pa.array(close, pa.bool_()))

    def involved(p: DataFrame, df: DataFrame) -> DataFrame:
        return _only(df, p.select(F.explode(F.array("a", "b")).alias("id")))

    def beside(p: DataFrame, df: DataFrame, *cols: str) -> DataFrame:
        for side in "ab":
            p = p.join(df.select(F.col("id").alias(side), *(F.col(c).alias(f"{c[0]}{side}") for c in cols)), side)
        return p

    regs = involved(pairs, sketched.select("id", F.col("n_shingles").alias("n"), F.col("registers").alias("r")))
    pairs = materialize(beside(pairs, regs, "n", "r").mapInArrow(near, "a long, b long").distinct(), "neardup-near")
    full = _sets(involved(pairs, docs), width)
    return beside(pairs, full, "set").mapInArrow(exact, "a long, b long, linked boolean").distinct()


def _proposed(rows: DataFrame) -> DataFrame:
    """(a, b, bands), a < b: each class with its key's leading class and with its neighbour in the key."""
    # Neighbours agree in the next band too, wherever a class does, and then are of similar size.
    part = F.pmod(F.xxhash64("next"), F.ceil(F.col("size") / GROUP))
    order = Window.partitionBy("key", part).orderBy("next", "n", "id")
    return (
        rows.select("id", F.array("lead", F.lag("id").over(order)).alias("others"))
        .select("id", F.explode("others").alias("other")).where("id <> other")
        .groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
        .agg(F.count("*").alias("bands"))
    )


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of ``docs``.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the
    smallest doc_id reachable over links, kept marks that document.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = materialize(sketches(texts, width, "id"), "neardup-sketch")
    content = ["n_shingles", "h1", "h2"]
    filled = sketched.where("n_shingles > 0 and doc_id is not null")
    copies = materialize(
        filled.groupBy(*content).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
        .where("copies > 1").drop("copies"), "neardup-copies")
    member = materialize(
        lookup(filled.drop("registers"), copies, content, F.col("doc_id"))
        .select("doc_id", F.coalesce("first", "doc_id").alias("class")), "neardup-classes")
    classes = lookup(filled, copies, content, F.col("doc_id")).where("first is null or first = doc_id").select(
        F.col("doc_id").alias("id"), "n_shingles", "registers")

    bands = band_rows(classes)
    keys = bands.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("size")).where("size > 1")
    shared = materialize(bands.join(keys, "key"), "neardup-shared")

    pairs = materialize(_proposed(shared), "neardup-pairs")
    # The best partner of each class first: what it links needs no further comparison.
    best = pairs.groupBy("b").agg(F.max(F.struct("bands", F.negative("a").alias("a"))).alias("m")).select(
        F.negative("m.a").alias("a"), "b")
    confirm = lambda p: materialize(_confirm(texts, classes, p, width, percent), "neardup-links")
    tried = confirm(materialize(best, "neardup-best"))
    links = tried.where("linked").drop("linked")
    jump = links.select(F.col("b").alias("a"), F.col("a").alias("over"))
    top = materialize(
        lookup(links, jump, ["a"], F.col("b")).select(F.col("b").alias("node"), F.coalesce("over", "a").alias("top")),
        "neardup-tops")
    side = {s: top.select(F.col("node").alias(s), F.col("top").alias(f"top_{s}")) for s in "ab"}
    rest = lookup(lookup(pairs, side["a"], ["a"], F.col("b")), side["b"], ["b"], F.col("a")).where(
        "coalesce(top_a, a) <> coalesce(top_b, b)").select("a", "b")
    tried = tried.unionByName(confirm(materialize(rest, "neardup-rest")))
    links = tried.where("linked").drop("linked")
    labels = materialize(components(links, "neardup-edges"), "neardup-labels")
    while True:
        found = materialize(_missed_links(texts, tried, labels, width, percent), "neardup-found")
        if found.isEmpty():
            break
        links = links.unionByName(found)
        labels = materialize(components(links, "neardup-edges"), "neardup-labels")
    found = materialize(_key_links(texts, classes, shared, labels, width, percent), "neardup-found")
    if not found.isEmpty():
        labels = materialize(components(links.unionByName(found), "neardup-edges"), "neardup-labels")
    named = labels.select(F.col("node").alias("class"), F.col("component").alias("top"))
    tops = lookup(member, named, ["class"], F.col("doc_id")).groupBy("doc_id").agg(
        F.min(F.coalesce("top", "class")).alias("component_id"))
    out = sketched.select("doc_id", "n_shingles").join(tops, "doc_id", "left").withColumn(
        "component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
