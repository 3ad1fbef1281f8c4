"""A corpus in five stages: quality, exact copies, near copies, benchmark leaks, encoding.

Each stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents`` and works on all rows it is given. All but
the last return the same columns. Decisions are made row by row, by id and text: rows that share an id and differ in text
are documents of their own. A null id is one more id, the last that a group of equal or like texts keeps. Columns besides
``doc_id`` and ``text`` are passed on untouched. A null text counts as empty; an empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import bpe_codec, decontaminate, exact_dedup, jaccard_join, quality_cnn
from siltstone.llm.common import table, written
from siltstone.llm.token_counts import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the byte-level network, fitted to labelled documents, predicts to be good."""
    return quality_cnn.keep_good(docs, quality_cnn.fit(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the row with the largest ``doc_id``, and of rows that repeat both id and text one."""
    return exact_dedup.keep_last(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near-duplicates the document with the smallest ``doc_id``; texts without words aren't compared."""
    return jaccard_join.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left: tokens, and digests of the ids and of the text that they decode to."""
    return bpe_codec.encode(docs, tokenizer_file("word_bpe_49k.json"), digest=True)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("benchmark decontamination", leaks), ("BPE encoding and decoding", encoded)]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
