"""Removal of repeated word passages by Rabin-Karp hashes of every window of a fixed number of words.

A window whose words occur in an earlier window (smaller doc_id, or the same document and an earlier start) is
repeated, and all its words go. Window hashes are rolled over prefix sums for the whole text. So that not each
of them is shuffled as a row, the windows of a document are cut into runs that share an anchor: the smallest
hash among the short runs of words inside the window. Equal windows have equal anchors, so rows of one anchor,
with the packed hashes of its windows, meet in one partition, and windows are compared there.

Before the shuffle each batch compares its own windows: of windows that are equal within the batch only the
earliest goes on, the others are known to be repeated. A passage that a third of all documents contain thus
sends one row per batch, not one per document. After it, rows of one anchor are split further by their windows.

Defined cases: null, empty and short texts have no windows and lose nothing. A null doc_id counts as smaller
than any other. Rows that repeat a doc_id with another text are documents of their own, told apart by a 64-bit hash
of the text; rows equal in doc_id and text are one document, and each is returned with the same result. Other columns are kept as they are.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import textscan

#: Words of the short runs from which anchors are taken.
GRAM = 8
#: Bytes of a window hash kept beside the 64-bit anchor, which is a hash of GRAM of the window's words, and the
#: anchor's place in the window, which takes the bits of ``gone`` from PLACE_BIT on.
PACK = 5
PLACE_BIT = 56
_NULL_ID = -(1 << 63)
#: Bytes of text whose windows are compared before the shuffle.
STEP = 2 << 20


def _anchors(grams: np.ndarray, per: int) -> np.ndarray:
    """Index of the smallest (leftmost) of each ``per`` consecutive values, by doubling."""
    best = np.arange(len(grams))
    width = 1
    while width < per:
        step = min(width, per - width)
        a, b = best[:-step], best[step:]
        best = np.where(grams[b] < grams[a], b, a)
        width += step
    return best


def _scan(ids: pa.Array, tags: pa.Array, texts: pa.Array, width: int):
    """Rows (anchor, doc, tag, at, mask, gone, packed) for the windows of some texts.

    ``tag`` is the text's hash, ``at`` the first window's start, ``mask`` has a bit for each window whose hash is packed, ``gone``
    one for each that repeats an earlier window of these texts, and above them the anchor's place in the first window.
    """
    keys, tags = ids.to_numpy(), tags.to_numpy()
    if (np.diff(keys) < 0).any():
        order = np.argsort(keys, kind="stable")
        keys, tags, texts = keys[order], tags[order], texts.take(pa.array(order))
    data, offsets = textscan.text_bytes(texts)
    starts, ends, first = textscan.word_bounds(data, offsets)
    words = textscan.word_hashes(data, starts, ends)
    if len(words) < width:
        return None
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    whole = np.flatnonzero(row[width - 1:] == row[:len(row) - width + 1])
    if not len(whole):
        return None
    grams = textscan.fold(words, GRAM)
    pick = _anchors(grams, width - GRAM + 1)[whole]
    hashes = textscan.fold(words, width)[whole]
    doc = keys[row[whole]]
    tag = tags[row[whole]]
    at = whole - first[row[whole]]
    # Repeats within these texts: all but the earliest of equal windows.
    again = (np.diff(keys) == 0).any()  # else the windows are in order of doc and start already
    order = np.lexsort((at, tag, doc, hashes)) if again else np.argsort(hashes, kind="stable")
    leads = np.flatnonzero(np.append(True, hashes[order[1:]] != hashes[order[:-1]]))
    earliest = np.repeat(order[leads], np.diff(np.append(leads, len(order))))
    gone = np.zeros(len(whole), bool)
    # Equal rows are one document.
    gone[order] = (doc[order] != doc[earliest]) | (tag[order] != tag[earliest]) | (at[order] != at[earliest])
    begins = np.ones(len(whole), bool)
    begins[1:] = (pick[1:] != pick[:-1]) | (np.diff(whole) != 1)
    lead = np.flatnonzero(begins)
    place = np.arange(len(whole)) - np.repeat(lead, np.diff(np.append(lead, len(whole))))
    bit = np.left_shift(1, place).astype(np.int64)
    mask = np.add.reduceat(np.where(gone, 0, bit), lead)
    lost = np.add.reduceat(np.where(gone, bit, 0), lead) + ((pick - whole)[lead] << PLACE_BIT)
    packed = np.ascontiguousarray(hashes[~gone]).view(np.uint8).reshape(-1, 8)[:, :PACK].tobytes()
    sizes = np.concatenate([[0], np.cumsum(np.add.reduceat(~gone, lead, dtype=np.int64) * PACK)])
    return [
        pa.array(grams[pick[lead]].view(np.int64)), pa.array(doc[lead]), pa.array(tag[lead]), pa.array(at[lead]),
        pa.array(mask), pa.array(lost), pa.Array.from_buffers(
            pa.binary(), len(lead), [None, pa.py_buffer(sizes.astype(np.int32)), pa.py_buffer(packed)])]


def repeated_windows(docs: DataFrame, width: int) -> DataFrame:
    """(doc, tag, start, mask): bits of the repeated windows from ``start`` on, for rows (doc, tag, text)."""
    if not GRAM <= width <= 60:
        raise ValueError(f"windows of {GRAM} to 60 words")
    names = ["anchor", "doc", "tag", "at", "mask", "gone", "packed"]

    def scan(batches):
        for batch in batches:
            rows = max(1, int(batch.num_rows * STEP / max(batch.column(2).nbytes, 1)))
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                if (cols := _scan(part.column(0), part.column(1), part.column(2), width)) is not None:
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.mapInArrow(scan, "anchor long, doc long, tag long, at long, mask long, gone long, packed binary")
    # A row whose windows are all known to be repeated needs no partner; it is dealt out by its own place.
    rows = rows.withColumn("anchor", F.when(F.col("mask") == 0, F.xxhash64("doc", "tag", "at")).otherwise(F.col("anchor")))
    by_anchor = Window.partitionBy("anchor")
    rows = rows.withColumn("met", F.when(F.col("mask") != 0, F.count("*").over(by_anchor) > 1).otherwise(False))
    # Split only here, so that the place is not shuffled as a column of its own.
    rows = rows.withColumn("place", F.expr(f"shiftright(gone, {PLACE_BIT})")).withColumn(
        "gone", F.col("gone").bitwiseAND(F.lit((1 << PLACE_BIT) - 1)))
    # Rows of an anchor that occurs once pass with the windows already known; the others open their windows.
    opened = rows.select(
        "anchor", "doc", "tag", "at", "gone", "place",
        F.explode(F.when(F.col("met"), F.expr(
            f"filter(transform(sequence(0, {width - GRAM}), i -> named_struct('bit', i, 'hash', "
            f"CASE WHEN (shiftright(mask, i) & 1) = 1 THEN substring(packed, "
            f"{PACK} * cast(bit_count(mask & (shiftleft(1L, i) - 1L)) as int) + 1, {PACK}) END)), "
            "w -> w.hash is not null)"))
            .when(F.col("gone") != 0, F.expr("array(named_struct('bit', -1, 'hash', cast(null as binary)))"))
        ).alias("w"),
    )
    earliest = Window.partitionBy("anchor", "w.hash", F.col("place") - F.col("w.bit")).orderBy("doc", "tag", "at", "w.bit")
    nth = F.when(F.col("w.hash").isNotNull(), F.rank().over(earliest)).otherwise(F.lit(1))
    bits = F.when(nth > 1, F.expr("shiftleft(1L, w.bit)")).otherwise(F.lit(0).cast("long"))
    found = opened.withColumn("bits", bits).groupBy("anchor", "doc", "tag", "at").agg(
        F.bit_or(F.col("bits").bitwiseOR(F.col("gone"))).alias("mask"))
    return found.where("mask != 0").select("doc", "tag", F.col("at").alias("start"), "mask")


def remove_repeats(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_removed, spans (start, end in words, maximal, apart) and kept_text.

    kept_text are the words left over, joined by one space. Columns of these names are replaced.
    """
    new = [
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("kept_text", T.StringType()),
    ]
    own = {f.name for f in new} | {"_doc", "_tag", "_runs"}
    kept = [f for f in docs.schema.fields if f.name not in own]
    base = docs.select(*(F.col(f"`{f.name}`") for f in kept))
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID))
    tag = F.xxhash64(F.col(text_col))
    runs = repeated_windows(base.select(doc.alias("doc"), tag.alias("tag"), F.col(text_col).alias("text")), width)
    # The runs of one text are bounded by its own length, however many texts share its id.
    runs = runs.groupBy(F.col("doc").alias("_doc"), F.col("tag").alias("_tag")).agg(
        F.collect_list(F.struct("start", "mask")).alias("_runs"))
    joined = base.withColumn("_doc", doc).withColumn("_tag", tag).join(
        runs.hint("shuffle_hash"), ["_doc", "_tag"], "left").drop("_doc", "_tag")
    schema = T.StructType([*kept, *new])

    def cut(batches):
        arrow_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            texts = batch.column(batch.schema.get_field_index(text_col))
            data, offsets = textscan.text_bytes(texts)
            found = batch.column(batch.schema.get_field_index("_runs"))
            n_words, n_removed, spans, left = [], [], [], []
            for i in range(batch.num_rows):
                begins, _, _ = textscan.word_bounds(data, offsets[i:i + 2])
                gone = np.zeros(len(begins), bool)
                if found[i].is_valid:
                    flat = found[i].values
                    start, mask = (flat.field(k).to_numpy() for k in range(2))
                    gone = _covered(start, mask, len(begins), width)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                words = data[offsets[i]:offsets[i + 1]].tobytes().split()
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
                left.append(b" ".join(compress(words, (~gone).tolist())).decode())
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(spans, arrow_kind), pa.array(left, pa.string())], names=schema.names)

    return joined.mapInArrow(cut, schema)


def _covered(start: np.ndarray, mask: np.ndarray, n: int, width: int) -> np.ndarray:
    """Words that some repeated window covers."""
    edge = np.zeros(n + 1, np.int64)
    for bit in range(width - GRAM + 1):
        at = start[(mask >> bit) & 1 == 1] + bit
        np.add.at(edge, at, 1)
        np.add.at(edge, at + width, -1)
    return np.cumsum(edge)[:n] > 0
