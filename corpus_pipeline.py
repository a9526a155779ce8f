"""Corpus pipeline: quality, exact copies, near copies, source mixing, token ids. Each stage reads what the one before it wrote."""
from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from obsloom.llm import byte_bpe, extendible, mixing, near_copies, neighbour_vote
from obsloom.llm.layout import batch_bytes, small_side
from obsloom.runtime import fresh_path, stage

BATCH_BYTES = 1 << 20  # of rows that Python gets at a time


def _bounded(work):
    """``work``, whose jobs hand about BATCH_BYTES at a time to Python; what it returns must need no Python any more."""
    @functools.wraps(work)
    def run(spark, docs, sf_dir):
        with batch_bytes(spark, BATCH_BYTES):
            return work(spark, docs, sf_dir)

    return run


def _free(docs: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it no column of ``docs``."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = "_" + name
    return name


def _kept(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id (a key of documents) is in ``decided``."""
    own = _free(docs, "_kept_id")
    ids = small_side(stage(decided.select(F.col("doc_id").alias(own)).distinct()))
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")


@_bounded
def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour vote accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _kept(docs, neighbour_vote.score(docs, labels).where("predicted = 1"))


@_bounded
def exact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the largest doc_id of each set of equal texts; one row of those that share that doc_id and text."""
    kept = stage(extendible.dedup(docs).where("kept").groupBy("doc_id").agg(F.count("*").alias("n")))
    same = _free(docs, "_text")
    again = _kept(docs, kept.where("n > 1")).withColumn(same, F.coalesce("text", F.lit(""))).dropDuplicates(["doc_id", same]).drop(same)
    return _kept(docs, kept.where("n = 1")).unionByName(again)


@_bounded
def near(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each set of near copies: shingles of five words, Jaccard 0.8 or more."""
    return _kept(docs, near_copies.near_groups(docs, words=5, least=0.8).where("doc_id <=> component_id"))


@_bounded
def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled with raked probabilities, nine tenths of the tokens."""
    return mixing.sample(docs, share=0.9)


@_bounded
def encoded(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every remaining text and the digests of the round trip."""
    return stage(byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=False))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing sources to target weights", mixed),
          ("byte-level BPE encoding and decoding", encoded)]

#: Fitted vectors, Hamming distances and merges are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = fresh_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
