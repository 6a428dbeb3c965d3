"""A cleaning pipeline over documents; each stage works on what the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm.bpe import bpe_tokens
from tillcast.llm.common import table
from tillcast.llm.decontaminate import without_benchmark
from tillcast.llm.jaccard import one_of_each
from tillcast.llm.secret_scan import mask_secrets
from tillcast.llm.toxicity import train_toxicity, without_toxic
from tillcast.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score as toxic, by a model of the labelled ones among them.

    Null and empty texts get the score of no words, which is below the threshold unless nearly all labelled
    texts are toxic; rows without an id are scored like others; repeated rows go or stay together. An empty
    table stays empty. Other columns are kept as they are.
    """
    return without_toxic(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the smallest id, of each group of near copies.

    Null, empty and wordless texts link with nothing and stay. Rows that repeat an id are one document, of
    which one row stays; rows without an id stay. An empty table stays empty. Other columns are kept.
    """
    return one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a window of the benchmark occurs.

    Null and empty texts hold none and stay. Every row is judged by its own text, with or without an id,
    repeated or not. Empty tables, of documents or of the benchmark, drop nothing. Other columns are kept.
    """
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts; all documents stay, and ``n_chars`` follows the text.

    Null texts stay null and empty ones empty; every row is masked by itself, with or without an id,
    repeated or not. Other columns are kept.
    """
    masked = mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, digests and the token ids of every text.

    Null and empty texts have no tokens; a null id stays null; repeated rows each give a row, no rows none.
    What workers remember is bounded lower than elsewhere: the stages before have needs of their own.
    """
    return bpe_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True, half_kept=100_000)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", hide_secrets),
    ("BPE encoding", encode),
]

# The first stage is a trained model: no SQL gives its rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the output of every stage is stored and read back."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
