"""Benchmark passages in documents by a prefix-filtered join of word shingles.

A window is a set of consecutive shingles that a document must contain whole. For
whole containment the necessary prefix is one shingle, so each window is looked
for under its rarest shingle alone. Documents send only shingles that may be such
a one (a bit table of fixed size tells), with the hashes of the words around it;
the join, the bounds on position and length, and the comparison of all the
window's words follow in Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import lean, query, ship_package, table, without
from .textnum import ALPHANUMERIC, U, combine, slices, text_bytes, words

WINDOW = 10  # words
SHINGLE = 5  # words, or all of a shorter window
TABLE_BITS = 26  # of the bit table: 8 MB, whatever the size of the benchmark

_WINDOWS = T.StructType([
    T.StructField("item_id", T.StringType()), T.StructField("window", T.BinaryType()),
    T.StructField("shingles", T.ArrayType(T.LongType())),
])
_WINDOWS_ARROW = pa.schema([("item_id", pa.string()), ("window", pa.binary()), ("shingles", pa.list_(pa.int64()))])
_HITS = T.StructType([
    T.StructField("row", T.BinaryType()), T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("shingle", T.LongType()), T.StructField("at", T.LongType()),
    T.StructField("since", T.LongType()), T.StructField("around", T.BinaryType()),
])
_HITS_ARROW = pa.schema([("row", pa.binary()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("shingle", pa.int64()),
                         ("at", pa.int64()), ("since", pa.int64()), ("around", pa.binary())])


def _windows(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        found = words(data, offsets, ALPHANUMERIC, lower=True)
        rows = []
        for i, item_id in enumerate(batch.column(0).to_pylist()):
            own = found.hashes[found.first[i]:found.first[i + 1]]
            for at in range(max(len(own) - WINDOW, 0) + 1 if len(own) else 0):
                window = own[at:at + WINDOW]
                size = min(SHINGLE, len(window))
                shingles = np.array([combine(window[j:j + size])[0] for j in range(len(window) - size + 1)], np.uint64)
                rows.append((item_id, window.tobytes(), shingles.view(np.int64)))
        columns = list(zip(*rows)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _WINDOWS_ARROW.types)], schema=_WINDOWS_ARROW)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """``item_id, window, size, shingle, place``: the windows of each item, with the rarest shingle and where it stands.

    Rarity is counted over the distinct windows; ties go to the smaller hash.
    """
    ship_package(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    found = materialize(items.mapInArrow(lean(_windows), _WINDOWS).distinct())
    spots = found.select("window", "shingles").distinct().select("window", F.posexplode("shingles").alias("place", "shingle"))
    counts = spots.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    rarest = (spots.join(counts, "shingle").groupBy("window")
              .agg(F.min(F.struct("n", "shingle", "place")).alias("least")).select("window", "least.shingle", "least.place"))
    return materialize(found.select("item_id", "window").join(rarest, "window")
                       .withColumn("size", F.expr("cast(octet_length(window) / 8 as long)")))


def _bit_table(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Bits of all shingles that windows are looked for under, and the lengths of these shingles in words.

    The bits come as 64-bit words of the table, at most 2**TABLE_BITS / 64 rows.
    """
    cells = (windows.select(F.shiftrightunsigned("shingle", 64 - TABLE_BITS).alias("bit"))
             .groupBy(F.shiftright("bit", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")))
    filled = cells.toPandas()
    table_ = np.zeros(2**TABLE_BITS // 64, np.int64)
    table_[filled["cell"].to_numpy()] = filled["bits"].to_numpy()
    sizes = windows.select(F.least("size", F.lit(SHINGLE)).cast("int").alias("size")).distinct()
    return table_, sorted(r["size"] for r in sizes.collect())  # at most SHINGLE values


def _candidates(bits, sizes):
    def run(batches):
        marks = bits.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for low, high in slices(offsets):
                part = words(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], ALPHANUMERIC, lower=True)
                counts = part.count()
                text_of = np.repeat(np.arange(high - low), counts)
                keys = batch.column(0).slice(low, high - low)
                ids = batch.column(1).slice(low, high - low)
                yield _hits(keys, ids, counts, [None] * len(keys), [None] * len(keys), [None] * len(keys), [None] * len(keys))
                for size in sizes:
                    shingles, inside = part.shingles(size)
                    bit = (shingles >> U(64 - TABLE_BITS)).astype(np.int64)
                    at = np.flatnonzero(inside & (marks[bit >> 6] >> (bit & 63) & 1).astype(bool))
                    if not len(at):
                        continue
                    text = text_of[at]
                    first, last = part.first[text], part.first[text + 1]
                    start = np.maximum(at - (WINDOW - size), first)
                    end = np.minimum(at + WINDOW, last)
                    around = [part.hashes[a:b].tobytes() for a, b in zip(start, end)]
                    take = pa.array(text)
                    yield _hits(keys.take(take), ids.take(take), counts[text], shingles[at].view(np.int64),
                                at - first, start - first, around)
    return run


def _hits(*columns):
    return pa.RecordBatch.from_arrays(
        [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _HITS_ARROW.types)], schema=_HITS_ARROW)


def row_key():
    """Digest of ``doc_id`` and text; rows that share it are equal to the join."""
    return F.unhex(F.md5(F.concat_ws("\u0000", F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                                     F.coalesce(F.col("text").cast("string"), F.lit("")))))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: ``row`` (its key), ``doc_id``, ``n_words``, ``n_hit``, ``items``.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A window is 10 consecutive
    words of an item of ``benchmark (item_id, text)``, or a whole shorter item; a document word in any
    occurrence of a window is hit, and ``items`` is the sorted array of the ids, as strings, of items with
    occurring windows. Null or wordless texts have no words and no hits, null or wordless items no windows,
    items without an id are looked for but not listed in ``items``, and an id given to several items counts once. Repeated rows
    each give a row. Words are compared by 64-bit hashes, a window by those of all its words.
    """
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark)
    bits, sizes = _bit_table(windows)
    shared = spark.sparkContext.broadcast(bits)
    sent = docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    seen = materialize(sent.mapInArrow(lean(_candidates(shared, sizes)), _HITS))
    rows = seen.where("shingle is null").select("row", "doc_id", "n_words")
    met = (seen.where("shingle is not null").drop("doc_id").join(windows, "shingle")
           .withColumn("start", F.col("at") - F.col("place"))
           .where("start >= since and start + size <= n_words")
           .where("substring(around, cast((start - since) * 8 + 1 as int), cast(size * 8 as int)) = window"))
    per_row = met.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("spans"),
        F.array_sort(F.collect_set("item_id")).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["upto"]), F.lit(0))).alias("n"),
                                F.greatest(s["end"], acc["upto"]).alias("upto")),
        lambda acc: acc["n"])
    per_row = per_row.select(F.col("row").alias("_row"), covered.alias("n_hit"), "items")
    return rows.join(per_row, F.col("row") == F.col("_row"), "left").select(
        "row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs."""
    found = materialize(benchmark_hits(docs, benchmark).where("n_hit > 0").select("row").distinct())
    return without(docs, row_key(), found)


@query("op6_decontaminate")
def op6_decontaminate(spark, sf_dir):
    found = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
