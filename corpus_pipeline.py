"""The corpus pipeline: STAGES applied to ``documents`` one after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import byte_bpe, store
from driftline.llm.line_frequency import line_quality
from driftline.llm.minhash import near_duplicates
from driftline.llm.mixing import MixRules, mix
from driftline.llm.secrets import scan
from driftline.llm.text import SPACE, text_key

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their boilerplate lines.

    Null and empty texts have no words and are rejected; texts are judged
    whole, however long. Rows that repeat id and text stay or go together.
    Null ids and sources are kept; columns of any name come back unchanged. An
    empty table stays empty."""
    return _with_text(line_quality(docs, keep=_others(docs)).where("kept"), F.col("clean_text"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id.

    Documents without words, and those without an id, are groups of their own.
    Rows that share an id with other texts stay or go each by its own text; of
    rows that repeat an id and a text one stays. Whole texts count. Columns of
    any name come back unchanged. An empty table stays empty."""
    judged = store.written(near_duplicates(docs, keyed=True).where("doc_id IS NOT NULL"), "judged")
    pairs = judged.groupBy("doc_id", "key_a", "key_b").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("rows"))
    dropped, repeated = pairs.where("NOT kept"), pairs.where("kept AND rows > 1")
    key = text_key(docs["text"])

    def among(found: DataFrame) -> Column:
        return (docs["doc_id"] == found["doc_id"]) & (key["a"] == found["key_a"]) & (key["b"] == found["key_b"])

    if repeated.isEmpty():
        return docs.join(dropped, among(dropped), "left_anti")
    others = pairs.where("NOT kept OR rows > 1")
    once = docs.join(repeated, among(repeated), "left_semi").groupBy(docs["doc_id"], key["a"], key["b"]).agg(F.any_value(F.struct(*docs.columns)).alias("row"))
    return docs.join(others, among(others), "left_anti").unionByName(once.select("row.*"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of each secret.

    Null texts become empty ones. Very long texts take time in proportion to
    their length. Null ids, repeated rows and columns of any name come back as
    they are. An empty table stays empty."""
    return _with_text(scan(docs, keep=_others(docs)), F.col("redacted"), docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes: a row for each epoch in which it takes
    words of one, with the text up to the last word that it takes.

    Null and empty texts are never taken. Rows that repeat one another are
    documents of their own; null ids and sources take part. Columns of any name
    come back unchanged. An empty table stays empty."""
    taken = mix(docs, MixRules(), keep=docs.columns).documents.where("taken > 0")
    by_epoch = taken.select("row", "size", F.explode("epochs").alias("words")).where("words > 0")
    # a block that ends inside a document cuts it: one document a source and epoch
    cut = F.when(F.col("words") == F.col("size"), F.col("row.text")).otherwise(F.array_join(F.slice(F.filter(F.split("row.text", SPACE + "+"), lambda w: w != ""), 1, F.col("words").cast("int")), " "))
    return _with_text(by_epoch, cut, docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document's text, their digest, and that of the bytes
    that they decode to.

    A row per input row: null and empty texts have no ids, very long ones are
    encoded in chunks, null ids and repeated rows stay, other columns are
    ignored. An empty table gives an empty result."""
    return byte_bpe.digests(docs, byte_bpe.public_tokenizer(), with_ids=True)


def _others(docs: DataFrame) -> list[str]:
    """Columns that a stage doesn't change, so that a text moves once."""
    return [c for c in docs.columns if c not in ("text", "n_chars")]


def _with_text(rows: DataFrame, text: Column, columns: list[str]) -> DataFrame:
    """The fields of ``row``, with a new text and its length."""
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in columns])


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("encoding", encoding)]

#: Signatures, Markov scores and byte merges are not for SQL; tests hold the
#: stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), name)
        if before is not None:
            store.drop(before)  # the stage that read it is written
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
