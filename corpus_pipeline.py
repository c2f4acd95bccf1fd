"""A corpus from raw documents to token ids, in stages that are written and read again.

Each stage is `(spark, docs, sf_dir) -> DataFrame`, works on all that the stage before it kept, and all but the
last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from macropanel.llm.bpe import encode, public_vocabulary
from macropanel.llm.common import land, table
from macropanel.llm.exact_dedup import drop_exact_duplicates
from macropanel.llm.mixing import mixed_documents
from macropanel.llm.ngram_join import drop_similar
from macropanel.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the model, fitted on the labels outside the held-out fold, scores at 0.3 or more."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of texts that are equal up to white space."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group linked by a Jaccard of 0.8 or more on five words."""
    return drop_similar(docs, width=5, num=4, den=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's budget says: not at all, or up to three times."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of the documents with their token ids."""
    return encode(docs, *public_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: A trained model, links of similar texts and a knapsack are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written in the shared folder and read again; the last one is returned lazily."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = land(docs)
    return docs
