"""Order-independent document fingerprints: a homomorphic multiset hash.

A text is the multiset of its pieces: paragraphs, long ones divided at the ends of sentences. Every piece is hashed
to a wide vector of small numbers, and a document's fingerprint is the sum of its pieces' vectors modulo powers of
two. So the order of pieces does not matter, and the fingerprint of an edited document follows from the old one by
adding the vectors of inserted pieces and subtracting those of deleted ones (``combine``).

The vector has four wide lanes, for equality, and 128 narrow ones of random signs, whose normalised inner product
estimates the share of pieces that two documents have in common (``likeness``). Narrow lanes travel two in a long:
each counts the pieces that have a bit set, and the number of pieces turns counts into sums of signs.

Only DataFrame functions are used. Defined cases: null counts as empty; an empty text has no pieces, all lanes 0,
likeness 1 to an equal fingerprint and 0 to others. Rows that repeat a doc_id and text count as one in the order of
documents, rows of one doc_id with different texts are ordered by a hash of the text; a null doc_id comes last. The
only document is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

#: Where pieces end: at line ends, and at blanks after the end of a sentence.
PIECES = r"\n+|(?<=[.!?]) +"
WIDE = 4
#: Longs of two narrow lanes each.
PAIRS = 64
_LOW31 = (1 << 31) - 1
#: Sums stay below these powers of two: 2**31 pieces is more than an array can hold.
WIDE_BITS, NARROW_BITS = 62, 31
_MASK = (1 << 32) | 1
_NULL_ID = -(1 << 63)


def with_lanes(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """Append the fingerprint of a text: number of pieces, wide lanes, pairs of narrow lanes."""
    pieces = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), PIECES), lambda p: p != "")
    # Columns of their own, so that pieces are cut and hashed once for all lanes.
    hashed = df.withColumn("_pieces", pieces).withColumn(
        "_one", F.transform("_pieces", lambda p: F.xxhash64(p))).withColumn(
        "_two", F.transform("_pieces", lambda p: F.xxhash64(p, F.lit("second"))))

    def total(hashes: str, part) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + part(h))

    wide = [total(h, part) for h in ("_one", "_two")
            for part in (lambda h: F.shiftrightunsigned(h, 33), lambda h: h.bitwiseAND(F.lit(_LOW31)))]
    narrow = [total(h, lambda h, k=k: F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_MASK)))
              for h in ("_one", "_two") for k in range(PAIRS // 2)]
    return hashed.withColumn(out_col, F.array(F.size("_one").cast("long"), *wide, *narrow)).drop(
        "_pieces", "_one", "_two")


def combine(a: Column, b: Column, subtract: bool = False) -> Column:
    """The fingerprint of the pieces of both, or of ``a`` without those of ``b``."""
    return F.zip_with(a, b, (lambda x, y: x - y) if subtract else (lambda x, y: x + y))


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of the two multisets of pieces, 0 to 1; 1 for equal fingerprints."""

    def signs(lane: Column, n: Column) -> list[Column]:
        return [lane.bitwiseAND(F.lit(_LOW31)) * 2 - n, F.shiftrightunsigned(lane, 32) * 2 - n]

    n, m = F.get(a, F.lit(0)), F.get(b, F.lit(0))
    terms = F.zip_with(F.slice(a, WIDE + 2, PAIRS), F.slice(b, WIDE + 2, PAIRS), lambda x, y: F.array(*(
        f.cast("double") for p, q in zip(signs(x, n), signs(y, m)) for f in (p * q, p * p, q * q))))
    zero = F.lit(0.0)
    sums = F.aggregate(terms, F.array(zero, zero, zero), lambda acc, t: F.array(*(
        F.get(acc, F.lit(i)) + F.get(t, F.lit(i)) + F.get(t, F.lit(i + 3)) for i in range(3))))
    cosine = F.transform(F.array(sums), lambda s: F.get(s, F.lit(0)) / F.sqrt(F.greatest(
        F.get(s, F.lit(1)) * F.get(s, F.lit(2)), F.lit(1.0))))
    return F.when(a == b, F.lit(1.0)).otherwise(
        F.least(F.greatest(F.get(cosine, F.lit(0)), F.lit(0.0)), F.lit(1.0)))


def as_string(lane: Column) -> Column:
    """Hexadecimal lanes, divided by dots."""
    return F.lower(F.array_join(F.transform(lane, lambda x: F.hex(x)), "."))


def followers(docs: DataFrame) -> DataFrame:
    """(id, tag, n, next_id, next_tag) over distinct rows (id, tag, n): the next one in descending order, cyclic.

    The rows are small and put in order by range partitions; only the first row of each partition meets the others.
    """
    order = [F.col("id").desc(), F.col("tag").desc()]
    ranged = materialize(
        docs.distinct().repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "followers")
    # One row per range partition.
    after = Window.orderBy("part")
    heads = ranged.groupBy("part").agg(F.max(F.struct("id", "tag")).alias("head")).select(
        "part", F.coalesce(F.lead("head").over(after), F.first("head").over(
            after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    follows = F.lead(F.struct("id", "tag")).over(Window.partitionBy("part").orderBy(*order))
    return ranged.withColumn("follows", follows).join(F.broadcast(heads), "part").withColumn(
        "follows", F.coalesce("follows", "head")).select(
        "id", "tag", "n", F.col("follows.id").alias("next_id"), F.col("follows.tag").alias("next_tag"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, lanes, edited_text, edited_lanes, next_lanes), a row per document.

    The edited text has its last third, rounded down, replaced by the first as many code points of the next document.
    Texts are shuffled once, beginnings of texts once more.
    """
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    plan = followers(base.select("id", "tag", F.length("text").alias("n")))
    # A document hands its beginning and its fingerprint to the one before it.
    takes = plan.select(
        F.col("next_id").alias("id"), F.col("next_tag").alias("tag"), F.col("id").alias("to_id"),
        F.col("tag").alias("to_tag"), F.floor(F.col("n") / 3).cast("int").alias("take"))
    own = base.join(materialize(takes, "followers-takes"), ["id", "tag"])
    given = with_lanes(own, "text", "next_lanes").select(
        F.col("to_id").alias("id"), F.col("to_tag").alias("tag"), F.expr("substring(text, 1, take)").alias("given"),
        "next_lanes").groupBy("id", "tag").agg(F.first("given").alias("given"), F.first("next_lanes").alias("next_lanes"))
    cut = F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))")
    out = own.join(given, ["id", "tag"]).withColumn("edited_text", F.concat(cut, "given"))
    out = with_lanes(with_lanes(out, "text", "lanes"), "edited_text", "edited_lanes")
    return out.select(
        F.when(F.col("id") != _NULL_ID, F.col("id")).alias("doc_id"), F.length("text").cast("long").alias("n_chars"),
        "lanes", "edited_text", "edited_lanes", "next_lanes")
