"""Registered queries of the operators, each over its whole table, and their oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, fingerprints, langid, lm, mixing, neardup, shards, substrings, topk, toxicity, variants, warc
from .common import small_batches, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"'[^\x20\x09-\x0D]+'"


def query(name: str, sql: str | None = None):
    def add(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            small_batches(spark)
            return build(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


@query(
    "op4_minhash_neardup",
    f"""
    WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORD}) AS w FROM documents),
    sets AS (
      SELECT doc_id, CASE WHEN len(w) >= 4
        THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
    shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
    links AS (
      SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    reach AS (
      SELECT doc_id, doc_id AS other FROM documents
      UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other),
    tops AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM sets JOIN tops USING (doc_id)
    """,
)
def op4_minhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), width=4, percent=80)


@query("op1_bpe_round_trip")
def op1_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    ids = bpe.encode(
        table(spark, folder, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"),
        ids_col="token_ids", decoded_col="decoded")
    return ids.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(
    "op2_shard_by_bytes",
    """
    WITH bits AS (
      SELECT list_transform(range(256), lambda n: list_reduce(
        list_prepend(CAST(n AS BIGINT), range(8)),
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    docs AS (
      SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) + 8 AS size
      FROM documents),
    sums AS (
      SELECT doc_id, size, xor(4294967295, list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(size - 8),
          lambda i: CAST(instr('0123456789ABCDEF', h[2 * i + 1]) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 17
            AS BIGINT))),
        lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS text_crc32
      FROM docs, bits),
    placed AS (
      SELECT *, row_number() OVER o - 1 AS n,
        least(23, (sum(size) OVER (o ROWS UNBOUNDED PRECEDING) - size + size // 2) * 24 // sum(size) OVER ()) AS s
      FROM sums WINDOW o AS (ORDER BY doc_id, text_crc32, size))
    SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, CAST(s AS INTEGER) AS shard,
      n - min(n) OVER (PARTITION BY s) AS slot, CAST(NULL AS INTEGER) AS grown_shard
    FROM placed
    """,
)
def op2_shard_by_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return shards.shard_by_bytes(table(spark, folder, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query(
    "op5_substring_dedup",
    f"""
    WITH words AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
    windows AS (
      SELECT doc_id, unnest(range(len(w) - 19)) AS pos,
        unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS g
      FROM words WHERE len(w) >= 20),
    repeated AS (
      SELECT doc_id, pos FROM windows
      QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS i FROM repeated),
    lost AS (SELECT doc_id, list(i) AS l FROM gone GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(l), 0) AS BIGINT) AS n_removed,
      sha256(coalesce(array_to_string(CASE WHEN l IS NULL THEN w ELSE list_filter(w,
        lambda x, i: NOT list_contains(l, i - 1)) END, ' '), '')) AS kept_sha256
    FROM words LEFT JOIN lost USING (doc_id)
    """,
)
def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, width=20).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op10_language_id")
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    net = langid.fit(docs.where(~langid.held_out()))
    out = langid.predict(docs.select("doc_id", "text"), net)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    labels = table(spark, folder, "labels").where(~langid.held_out()).select(
        "doc_id", "toxic", (fold == 0).alias("part"))
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model)
    return out.select(
        "doc_id", langid.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op9_multiset_fingerprint")
def op9_multiset_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    out = fingerprints.edited(table(spark, folder, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        fingerprints.as_string(F.col("lanes")).alias("fingerprint"),
        fingerprints.as_string(F.col("edited_lanes")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        fingerprints.likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"))


@query(
    "op7_warc",
    """
    WITH p AS (
      SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
    f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
      CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN first <> page_id THEN first END AS refers_to
    FROM f
    """,
)
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_and_read(table(spark, folder, "pages"))


@query(
    "op6_exact_top_k",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scores AS (
      SELECT q.vec_id AS query_id, c.vec_id,
        CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
      vec_id, score
    FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
    """,
)
def op6_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op3_mix_to_targets")
def op3_mix_to_targets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs, budget=0.7, alpha=0.7).drop("text")


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


def _rounds(n: int) -> str:
    """CTEs p0, c1, p1, ... pn: assignments to and means of the centroids, round by round."""
    far = "list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i])))"
    steps = []
    for r in range(n + 1):
        steps.append(f"""
    d{r} AS MATERIALIZED (
      SELECT v.vec_id, v.row, v.v, c.cluster, {far} AS far FROM v CROSS JOIN c{r} c),
    p{r} AS MATERIALIZED (
      SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY row ORDER BY far, cluster) = 1)""")
        if r < n:
            steps.append(f"""
    s{r} AS (
      SELECT cluster, i, count(*) AS n, sum(CAST(v[i] AS HUGEINT)) AS total
      FROM p{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY cluster, i),
    m{r} AS (
      SELECT cluster, list((total - ((total % n) + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY cluster),
    c{r + 1} AS MATERIALIZED (
      SELECT c.cluster, CAST(coalesce(m.v, c.v) AS BIGINT[]) AS v FROM c{r} c LEFT JOIN m{r} m USING (cluster))""")
    return ",".join(steps)


@query(
    "op13_centroid_clustering",
    f"""
    WITH v AS MATERIALIZED (
      SELECT vec_id, row_number() OVER () AS row,
        list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS cluster, v
      FROM v WHERE vec_id IS NOT NULL ORDER BY 1 LIMIT 8),
    {_rounds(10)}
    SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(far AS BIGINT) AS distance,
      CAST(sum(far) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
      CAST(sum(far) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM p10 JOIN c10 c USING (cluster)
    """,
)
def op13_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(table(spark, folder, "embeddings"), k=8, rounds=10)


@query(
    "op11_spelling_variants",
    f"""
    WITH RECURSIVE bits AS (
      SELECT list_transform(range(256), lambda n: list_reduce(
        list_prepend(CAST(n AS BIGINT), range(8)),
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    runs AS (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[a-zÀ-ÿ]+')) AS run FROM documents),
    tallies AS (
      SELECT run, count(*) AS k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x
      FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
    hashed AS (
      SELECT run, k, xor(4294967295, list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(x) // 2),
          lambda i: CAST(instr('0123456789ABCDEF', x[2 * i + 1]) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 17
            AS BIGINT))),
        lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS h
      FROM tallies, bits),
    spelt AS (
      SELECT k, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
        ELSE run END AS word
      FROM hashed),
    v AS MATERIALIZED (
      SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
    parts AS (
      SELECT word, n, unnest(list_distinct(list_append(list_transform(range(1, length(word) + 1),
        lambda i: substr(word, 1, i - 1) || substr(word, i + 1)), word))) AS g
      FROM v),
    pairs AS (
      SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n
      FROM parts a JOIN parts b ON a.g = b.g AND a.word <> b.word
      WHERE CASE length(a.word) - length(b.word) WHEN 1 THEN a.g = b.word WHEN -1 THEN a.g = a.word
        WHEN 0 THEN list_sum(list_transform(range(1, length(a.word) + 1),
          lambda i: CAST(substr(a.word, i, 1) <> substr(b.word, i, 1) AS INTEGER))) = 1 ELSE false END),
    best AS (
      SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n
      FROM pairs GROUP BY word),
    forms AS MATERIALIZED (
      SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
        CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n
      FROM v LEFT JOIN best USING (word)),
    walk AS (
      SELECT word, word AS here FROM forms
      UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.here WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, w.here AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
    FROM forms f JOIN walk w ON w.word = f.word JOIN forms l ON l.word = w.here AND l.form IS NULL
    """,
)
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.group_variants(variants.count_words(table(spark, folder, "documents")))


@query("op12_lm_scores")
def op12_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(True))
    out = lm.score(table(spark, folder, "documents"), ~held_out, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
