"""The corpus pipeline: bad and toxic documents go, one of each group of near copies stays, the rest is packed.

Each stage takes ``(spark, docs, sf_dir)`` and works on every document that its predecessor kept. What a stage needs of
a text it reads from ``docs``; all stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgspark.llm import ngram_join, packing, quality, toxicity
from kgspark.llm.queries import CATEGORIES, TOKENIZER, rated_categories
from kgspark.llm.support import scratch_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, model).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier chain does not reject."""
    chain = toxicity.fit(docs, rated_categories(table(spark, sf_dir, "labels")), CATEGORIES)
    return toxicity.keep(docs, chain).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group that five-word shingles connect; see ``ngram_join.one_of_each``."""
    return ngram_join.one_of_each(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality_classifier", drop_poor),
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None  # fitted models, MinHash and a tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
