"""From documents to packed sequences: quality, exact and near copies, benchmark passages, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from depscope.llm.decontam import drop_contaminated
from depscope.llm.exact import exact_dedup
from depscope.llm.near import near_dedup
from depscope.llm.packing import pack_documents
from depscope.llm.quality import select_good
from depscope.llm.queries import table, tokenizer_file
from depscope.llm.store import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is at least a half; fitted on docs that have labels. Null text: no feature, the thresholds decide."""
    return select_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the smallest id; null text is empty, of repeated rows one stays."""
    return exact_dedup(docs, keep="min")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the smallest id; texts without words are one class."""
    return near_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window; null text has no word and stays."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece: its document, tokens and place in a sequence of 2,048; null text is one piece of the end id."""
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("pack", pack)]

#: A trained classifier and sketches are beyond SQL; tests/llm/test_pipeline.py compares each stage with plain computations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written to the shared folder and read again. An empty table gives none."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
