"""The corpus pipeline, stage by stage."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

import corpus_pipeline
from driftline.llm import store
from driftline.llm.minhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, store.written(stage(spark, docs, sf_dir), name)
        seen[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS and dict(docs.dtypes) == dict(before.dtypes)
            assert docs.where("n_chars != length(text)").count() == 0
    before, after = seen["quality"]
    assert 0 < after.count() < before.count()
    before, after = seen["near_dedup"]
    kept = {r["doc_id"] for r in near_duplicates(before).collect() if r["kept"]}
    assert {r["doc_id"] for r in after.collect()} == kept
    before, after = seen["secrets"]
    assert after.count() == before.count()
    assert not any(re.search(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", r["text"]) for r in after.collect())
    before, after = seen["mixing"]
    sizes = {r["doc_id"]: len(r["text"].split()) for r in before.collect()}
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) <= sizes[r["doc_id"]] for r in after.collect())
    before, after = seen["encoding"]
    assert after.count() == before.count() and after.where("n_tokens < 1").count() == 0


def test_pipeline_on_no_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = store.written(stage(spark, docs, sf_dir), name)
    assert docs.count() == 0


def test_pipeline_on_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, and clashing columns."""
    good = lambda k: " ".join(f"g{k}q{i}" for i in range(80))
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, long, None, "a", None), (4, good(1), "en", "b", 1), (4, good(1), "en", "b", 1), (5, good(1), "en", "b", 1), (None, good(2), None, None, None), (8, good(4) + " password = abcdefgh12345", None, "z", 3)]
    clash = {c: F.lit(1) for c in ("row", "key", "size", "epochs", "words", "doc", "h", "host", "lines", "node", "spans", "ids", "text_crc32")}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(clash)
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = store.written(stage(spark, docs, ""), name)
        counts.append(docs.count())
        if name == "secrets":
            assert {r["doc_id"] for r in docs.collect()} == {3, 4, 8, None}
            assert docs.where("doc_id = 8").first()["text"].endswith("q79 [SECRET]")
    assert counts[:3] == [6, 4, 4] and counts[3] == counts[4] >= 3


def test_rows_that_share_an_id_go_each_by_its_own_text(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rows = [(3, a), (5, a), (5, b), (9, b), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert {(r["doc_id"], r["text"]) for r in left} == {(3, a), (5, b), (7, None), (7, "")} and len(left) == 4


def test_of_rows_that_repeat_an_id_and_a_text_one_stays(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rows = [(3, a), (3, a), (5, a), (5, a), (6, b), (None, b), (None, b), (7, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("kept", "rows", "key_a", "row")})
    left = corpus_pipeline.near_dedup(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([(3, a), (6, b), (None, b), (None, b), (7, None)], key=repr)


def test_every_stage_on_two_texts_of_one_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    docs = spark.createDataFrame([(5, a, "en", "s", 1), (5, b, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = store.written(stage(spark, docs, ""), name)
        assert sorted(r["text"] for r in docs.collect()) == [a, b]
    taken = store.written(corpus_pipeline.mixing(spark, docs, ""), "mixing")
    assert 0 < taken.count() <= 6 and taken.where("doc_id != 5").count() == 0
    assert corpus_pipeline.encoding(spark, taken, "").count() == taken.count()
