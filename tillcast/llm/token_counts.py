"""Token counts of documents through a store of counts by content digest."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, new_path
from .common import attach_by_key, lean, query, ship_package, table

LIMIT = 4096
BATCH_BYTES = 4_000_000  # of text given to the tokenizer at once

_CACHE = T.StructType([
    T.StructField("digest", T.BinaryType()), T.StructField("version", T.StringType()), T.StructField("n_tokens", T.LongType()),
])
_CACHE_ARROW = pa.schema([("digest", pa.binary()), ("version", pa.string()), ("n_tokens", pa.int64())])

_models: dict[str, object] = {}


def _model(path: str):
    """The tokenizer in ``path``, loaded once per Python worker."""
    if path not in _models:
        if path.endswith(".model"):
            import sentencepiece
            loaded = sentencepiece.SentencePieceProcessor(model_file=path)
            _models[path] = lambda texts: loaded.encode(texts, num_threads=1)
        else:
            import os
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            loaded = Tokenizer.from_file(path)
            loaded.no_truncation()
            loaded.no_padding()
            _models[path] = lambda texts: loaded.encode_batch_fast(texts, add_special_tokens=False)
    return _models[path]


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file: counts of another file are never taken for its counts."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _encode(path: str, version: str):
    def run(batches):
        encode = _model(path)
        for batch in batches:
            texts = batch.column(1)
            sizes = np.cumsum([0] + [len(t) for t in texts.to_pylist()])
            low, counts = 0, []
            while low < len(texts):
                high = max(low + 1, int(np.searchsorted(sizes, sizes[low] + BATCH_BYTES, side="right")) - 1)
                counts += [len(tokens) for tokens in encode(texts.slice(low, high - low).to_pylist())]
                low = high
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.binary()), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())],
                schema=_CACHE_ARROW)
    return run


def count_tokens(docs: DataFrame, model_path: str, cache_path: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for each row of ``docs (doc_id, text)``; new counts go into the cache.

    The cache is a Parquet table of content digest, tokenizer version and count. Content is normalised
    before the digest as far as no count can change: a null is the empty text. Digests without a stored
    count for this version are encoded once each, whatever the number of copies, and appended; then all
    rows take their counts from the cache. Copies meet before the shuffle, so a text that fills a third
    of the table sends one row per task, and its rows take their count from a broadcast of the few such texts. A cache that does not exist is made. A task that is run again
    writes the same rows; if two jobs append one digest, both rows agree and one is used.

    Null and empty texts have 0 bytes and the count of the empty text; a null ``doc_id`` stays null;
    repeated rows each give a row; no row gives none. Other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    version = tokenizer_version(model_path)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    spark.createDataFrame([], _CACHE).write.mode("append").parquet(cache_path)
    known = _stored(spark, cache_path, version)
    misses = (docs.select(digest, text.alias("text")).dropDuplicates(["digest"])
              .join(known.select("digest"), "digest", "left_anti").select("digest", "text"))
    misses.mapInArrow(lean(_encode(model_path, version)), _CACHE).write.mode("append").parquet(cache_path)
    rows = materialize(docs.select("doc_id", digest, F.octet_length(text).cast("long").alias("n_bytes")))
    counts = materialize(_stored(spark, cache_path, version))
    return attach_by_key(rows, counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def _stored(spark, cache_path: str, version: str) -> DataFrame:
    stored = spark.read.schema(_CACHE).parquet(cache_path).where(F.col("version") == version)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


@query("op5_token_counts")
def op5_token_counts(spark, sf_dir):
    """Every run starts from an empty cache, so that all distinct texts are encoded."""
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"),
                           new_path(spark, "token-counts"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
