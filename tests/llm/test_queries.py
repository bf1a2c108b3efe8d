"""Registered queries against their oracle SQL, and the pipeline against its operators, at the smallest scale."""

import os
import sys
import zlib

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import corpus_pipeline  # noqa: E402
from alertloom.llm import catalog  # noqa: E402
from check_oracle import TABLES, canonical  # noqa: E402


@pytest.fixture(scope="module")
def duck(data_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n.startswith("op")])
def test_query(spark, duck, data_dir, name):
    got = catalog.QUERIES[name](spark, data_dir).toArrow()
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name]).to_arrow_table()
        assert sorted(got.column_names) == sorted(want.column_names)
        assert canonical(got) == canonical(want)
    else:
        assert got.num_rows == duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]


def test_fourteen_queries():
    assert len(catalog.QUERIES) == 14 and set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert {n.split("_")[0] for n in catalog.QUERIES} == {"pipeline", *(f"op{k}" for k in range(1, 14))}


def test_stages_decide_and_hand_on(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    names = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = corpus_pipeline.materialize(stage(spark, docs, data_dir), f"test-{name}")
        names.append(name)
        assert docs.count() <= before
        assert set(corpus_pipeline.COLUMNS) <= set(docs.columns)
    assert names == ["language_id", "near_dedup", "substring_dedup", "mixing", "bpe"]
    assert docs.count() > 0 and docs.where("n_tokens <> size(token_ids)").isEmpty()
    assert catalog.QUERIES["pipeline"](spark, data_dir).count() == docs.count()


def test_stages_on_null_rows_and_no_rows(spark, data_dir):
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", None, 0), (2, "some words here", None, None, None),
         (2, "some words here", None, None, None)],
        "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, data_dir).count() >= 0
        assert stage(spark, odd.limit(0), data_dir).count() == 0


def test_toxicity_and_language_on_the_held_out_third(spark, data_dir):
    folder = data_dir.replace("sf0.001", "sf0.1")
    if not os.path.isdir(folder):
        pytest.skip("no larger data")
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = [r for r in catalog.QUERIES["op10_language_id"](spark, folder).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in out)
    assert sum(lang[r["doc_id"]] == r["lang_pred"] for r in out) / len(out) > 0.98
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [(r["score"], toxic[r["doc_id"]]) for r in catalog.QUERIES["op8_toxicity"](spark, folder).collect()
            if r["held_out"] and r["doc_id"] in toxic]
    good, bad = ([s for s, t in rows if t == k] for k in (0, 1))
    assert sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good)) > 0.9
