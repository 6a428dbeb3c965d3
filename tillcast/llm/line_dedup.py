"""Lines that several documents share are dropped from all of them but one.

Lines are exploded to hashes of their normalised form, documents are counted per
hash, lines above the threshold are marked, and texts are put together again from
the other lines in their order. Only hashes and ids are shuffled to be counted; the
texts meet their marks once, at the end.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import query, ship_package, table

LEAST_DOCS = 3  # documents that hold a line from which it is dropped
LEAST_CHARS = 20  # code points of a normalised line that is compared at all
HOT_KEYS = 10_000  # lines found in more than this part of all places are joined by broadcast: there are fewer of them
ROWS_AT_ONCE = 50_000

_KEYS = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("doc_id", T.LongType())])
_KEYS_ARROW = pa.schema([("key", pa.binary()), ("doc_id", pa.int64())])
_KEPT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                      T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
_KEPT_ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])


def line_key(line: bytes, least_chars: int) -> bytes | None:
    """128-bit hash of a line without white space at its ends and with A-Z lower-cased; None if it is too short."""
    line = line.strip().lower()  # of bytes: ASCII white space and letters only
    if len(line) < least_chars or not line.isascii() and len(line.decode("utf-8", "replace")) < least_chars:
        return None
    return hashlib.blake2b(line, digest_size=16).digest()


def _explode(least_chars: int):
    """The distinct line keys of each text, with the document's id."""
    def run(batches):
        for batch in batches:
            keys, ids = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = {line_key(line, least_chars) for line in (text.as_py() or "").encode().split(b"\n")}
                found.discard(None)
                keys.extend(found)
                ids.extend([doc_id] * len(found))
                if len(keys) >= ROWS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], schema=_KEYS_ARROW)
                    keys, ids = [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], schema=_KEYS_ARROW)
    return run


def _reassemble(least_chars: int):
    """Each text from those of its lines whose keys are not dropped, in their order."""
    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for doc_id, text, dropped in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text, dropped = text.as_py() or "", dropped.as_py()
                n_lines = text.count("\n") + 1
                kept = text
                gone = 0
                if dropped:
                    dropped = set(dropped)
                    lines = text.encode().split(b"\n")
                    stay = [line for line in lines if line_key(line, least_chars) not in dropped]
                    kept, gone = b"\n".join(stay).decode(), n_lines - len(stay)
                rows.append((doc_id, kept, n_lines, gone))
                size += len(kept)
                if size > 8_000_000:
                    yield _kept_batch(rows)
                    rows, size = [], 0
            yield _kept_batch(rows)
    return run


def _kept_batch(rows):
    columns = list(zip(*rows)) if rows else [[]] * len(_KEPT_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KEPT_ARROW.types)], schema=_KEPT_ARROW)


def line_keys(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``(key, doc_id)`` for the distinct keys of the lines of each row of ``docs`` that has an id."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    return rows.mapInArrow(_explode(least_chars), _KEYS)


def shared_lines(places: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``(key, n_docs, last)`` for the keys that at least ``least_docs`` different documents hold.

    Rows that repeat a document are taken together first; per key only a count and the largest id are
    combined before the shuffle, so a line that a third of all documents hold is one row per task.
    """
    counted = places.distinct().groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last"))
    return counted.where(F.col("n_docs") >= least_docs)


def dropped_lines(places: DataFrame, shared: DataFrame) -> DataFrame:
    """``(doc_id, keys)``: the shared keys that each document loses. Both arguments are stored tables.

    A key with more than one place in ``HOT_KEYS`` goes to where its rows are: fewer than that many keys
    can have as many places, so this side has a proven bound. The rows of the others are shuffled by key,
    and no key among them has more than that part of the rows.
    """
    places_in_all = places.count()
    hot = F.col("n_docs") * HOT_KEYS > places_in_all
    often = F.broadcast(shared.where(hot).select("key", "last"))
    seldom = shared.where(~hot).select("key", "last")
    met = places.join(often, "key").unionByName(places.join(often.select("key"), "key", "left_anti").join(seldom, "key"))
    return met.where("doc_id <> last").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def dedup_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` for each row of ``docs (doc_id, text)``, without the lines others share.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Keys of at least
    ``least_chars`` code points that at least ``least_docs`` documents hold lose all their lines, except those
    in the largest ``doc_id`` that holds the key. The other lines stay as they are, joined by line feeds.
    Keys are compared by 128-bit hashes.

    Null and empty texts are one empty line. Rows that repeat a ``doc_id`` are one document: they count once,
    and all keep or all lose a line. A row without an id is no document: it counts nowhere and stays whole.
    No rows give none. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    places = materialize(line_keys(docs, least_chars))
    shared = materialize(shared_lines(places, least_docs))
    dropped = materialize(dropped_lines(places, shared).select(F.col("doc_id").alias("_of"), "keys"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = rows.join(dropped, F.col("doc_id") == F.col("_of"), "left").select("doc_id", "text", "keys")
    return marked.mapInArrow(_reassemble(least_chars), _KEPT)


@query("op13_line_dedup")
def op13_line_dedup(spark, sf_dir):
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
