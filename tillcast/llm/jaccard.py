"""Similarity join of documents on word n-grams by a blocked sparse product.

Documents are the rows and distinct n-grams the columns of an incidence matrix A;
the entries of A A' are overlaps, and two documents link when their overlap
reaches the bound that their sizes set. The product is never formed whole:

1. Columns with one entry are dropped. Batches of documents send their n-grams to
   column blocks; these count each n-gram over all documents and return those that
   occur twice or more. A document that keeps less than three quarters of its
   n-grams reaches no bound and leaves.
2. Documents with equal sets become one row.
3. Rows meet when they share one of their rarest n-grams: of n, the first
   n - ceil(3n/4) + 1 in order of rarity must hold one that a partner has too.
   All rows under such an n-gram join the block of its smallest row, the pivot.
4. The pivot's row is multiplied with its block, in chunks. Rows that reach the
   bound form classes, so a large group of copies costs one product each.
5. What is left are pairs of one block in different classes. Only these are
   multiplied, tile by tile; tiles inside one class are skipped.

All links between different sets are either found or connect one class, so the
components are exact. Tasks hold a bounded number of entries, whatever the size
of a group; nothing but counts reaches the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import attach_by_key, buckets, lean, query, ship_package, table, without
from .components import components
from .textnum import SPACED, U, combine, slices, text_bytes, words

WORDS = 5
TILE = 1_000_000  # entries of the incidence matrix in a tile

_LOW = U(2**48 - 1)
_MANY = 65535

_PARTS = T.StructType([
    T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.StringType()),
    T.StructField("grams", T.BinaryType()), T.StructField("rows", T.BinaryType()),
    T.StructField("counts", T.BinaryType()), T.StructField("docs", T.BinaryType()),
    T.StructField("known", T.BinaryType()), T.StructField("sizes", T.BinaryType()),
    T.StructField("digests", T.BinaryType()),
])
_PARTS_ARROW = pa.schema([("bucket", pa.int32()), ("batch", pa.string())] + [
    (name, pa.binary()) for name in ("grams", "rows", "counts", "docs", "known", "sizes", "digests")])
_SETS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()),
    T.StructField("grams", T.ArrayType(T.LongType())), T.StructField("prefix", T.IntegerType()),
])
_SETS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()),
                         ("grams", pa.list_(pa.int64())), ("prefix", pa.int32())])
_EDGES = "a long, b long"
_EDGES_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _needed(n):
    """Least overlap that two sets of ``n`` n-grams altogether link with (Jaccard at 0.75)."""
    return (3 * n + 6) // 7


def _sets(batch: pa.RecordBatch):
    """Distinct n-grams of each text, a slice of the batch at a time."""
    data, offsets = text_bytes(batch.column(1))
    for low, high in slices(offsets):
        part = words(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], SPACED, lower=True)
        grams, _ = part.shingles(WORDS)
        out = []
        for i, n in enumerate(part.count()):
            at = int(part.first[i])
            if n >= WORDS:
                out.append(np.unique(grams[at:at + n - WORDS + 1]))
            elif n:  # the whole sequence of a short text is its one n-gram
                out.append(combine(part.hashes[at:at + n]))
            else:
                out.append(np.empty(0, np.uint64))
        yield batch.column(0).slice(low, high - low), out


def _send(blocks: int):
    """Deal the n-grams of each slice out to column blocks, each once with its count in the slice.

    Which rows hold an n-gram travels along if it is one row; otherwise with the
    slice's own record, so that a frequent n-gram adds one entry per slice to its
    block and no more.
    """
    def run(batches):
        for batch in batches:
            for ids, sets in _sets(batch):
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
                order = np.argsort(every, kind="stable")
                every = every[order]
                rows = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)[order]
                heads = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, np.int64)
                counts = np.diff(np.append(heads, len(every)))
                distinct, single = every[heads], counts == 1
                owner = np.where(single, rows[heads], np.uint16(_MANY)).astype(np.uint16)
                block = (((distinct >> U(32)) * U(blocks)) >> U(32)).astype(np.int64)
                digests = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
                name = hashlib.blake2b(digests + repr(ids.to_pylist()).encode(), digest_size=16).hexdigest()
                edges = np.searchsorted(block, np.arange(blocks + 1))
                packed = (distinct & _LOW).view(np.uint8).reshape(-1, 8)[:, :6]
                out = []
                for b in np.flatnonzero(np.diff(edges)):
                    low, high = edges[b], edges[b + 1]
                    many = counts[low:high][~single[low:high]].astype(np.uint32)
                    out.append((int(b), name, packed[low:high].tobytes(), owner[low:high].tobytes(), many.tobytes(),
                                None, None, None, None))
                shared = ~single[np.repeat(np.arange(len(heads)), counts)]
                known = np.array([i is not None for i in ids.to_pylist()], bool)
                out.append((-1 - int(name[:6], 16) % blocks, name, _names(every[shared], blocks).tobytes(),
                            rows[shared].tobytes(), None, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
                            known.tobytes(), sizes.tobytes(), digests))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), _PARTS_ARROW.types)], schema=_PARTS_ARROW)
    return run


def _names(grams: np.ndarray, blocks: int) -> np.ndarray:
    """What an n-gram is called after its block is known: 48 bits of it and 16 of the block."""
    block = ((grams >> U(32)) * U(blocks)) >> U(32)
    return (grams & _LOW) | (block << U(48))


def _count(key, part):
    """One column block: keep n-grams that occur twice or more, with their counts."""
    if key[0].as_py() < 0:
        return part
    own = U(key[0].as_py() % 65536)
    grams = []
    for value in part.column("grams"):
        short = np.frombuffer(value.as_py(), np.uint8).reshape(-1, 6)
        wide = np.zeros((len(short), 8), np.uint8)
        wide[:, :6] = short
        grams.append(wide.view(np.uint64).ravel())
    rows = [np.frombuffer(v.as_py(), np.uint16) for v in part.column("rows")]
    every, owner = np.concatenate(grams), np.concatenate(rows)
    weight = np.ones(len(every), np.int64)
    weight[owner == _MANY] = np.concatenate([np.frombuffer(v.as_py(), np.uint32) for v in part.column("counts")])
    _, place = np.unique(every, return_inverse=True)
    total = np.bincount(place, weights=weight).astype(np.int64)[place]
    ends = np.cumsum([len(g) for g in grams])
    out = []
    for name, low, high in zip(part.column("batch").to_pylist(), ends - [len(g) for g in grams], ends):
        keep = np.flatnonzero(total[low:high] > 1) + low
        if len(keep):
            out.append((key[0].as_py(), name, (every[keep] | (own << U(48))).tobytes(), owner[keep].tobytes(),
                        np.minimum(total[keep], 2**32 - 1).astype(np.uint32).tobytes(), None, None, None, None))
    columns = zip(*out) if out else [[]] * len(_PARTS_ARROW)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _PARTS_ARROW.types)], schema=_PARTS_ARROW)


def _gather(key, part):
    """One slice of documents again, with the counts that came back."""
    part = part.to_pylist()
    records = [row for row in part if row["docs"] is not None]
    record = records[0]  # slices that are equal in every row share a name; what was found for one holds for all
    found = list({row["bucket"]: row for row in part if row["docs"] is None}.values())
    join = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in found] or [np.empty(0, kind)])
    grams, rows, df = join("grams", np.uint64), join("rows", np.uint16), join("counts", np.uint32)
    many = rows == _MANY
    order = np.argsort(grams[many])
    seen, seen_df = grams[many][order], df[many][order]
    own, own_rows = np.frombuffer(record["grams"], np.uint64), np.frombuffer(record["rows"], np.uint16)
    grams = np.concatenate([grams[~many], own])
    df = np.concatenate([df[~many], seen_df[np.searchsorted(seen, own)] if len(own) else np.empty(0, np.uint32)])
    rows = np.concatenate([rows[~many], own_rows])
    order = np.lexsort((grams, df, rows))
    grams, rows = grams[order].view(np.int64), rows[order]
    docs, known = np.frombuffer(record["docs"], np.int64), np.frombuffer(record["known"], bool)
    sizes = np.frombuffer(record["sizes"], np.int64)
    ends = np.searchsorted(rows, np.arange(len(docs) + 1))
    out = []
    for i, n in enumerate(sizes.tolist()):
        kept = grams[ends[i]:ends[i + 1]]
        alive = n > 0 and 4 * len(kept) >= 3 * n
        prefix = n - (3 * n + 3) // 4 + 1 - (n - len(kept))
        out.append((int(docs[i]) if known[i] else None, n, record["digests"][16 * i:16 * i + 16] if n else None,
                    kept if alive else None, prefix if alive else None))
    columns = list(zip(*out)) if out else [[]] * len(_SETS_ARROW)
    columns = [list(c) * len(records) for c in columns]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _SETS_ARROW.types)], schema=_SETS_ARROW)


def _flat(part: pa.Table):
    """Row ids, set sizes, entries end to end, and where each row's entries start."""
    part = part.combine_chunks()
    lists = part.column("grams")
    lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return (part.column("id").to_numpy(), part.column("n").to_numpy(), lists.flatten().to_numpy(zero_copy_only=False), first)


def _edges(pairs) -> pa.Table:
    a, b = zip(*pairs) if pairs else ([], [])
    return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGES_ARROW)


def _pivot_product(key, part):
    """Overlaps of a chunk of a block with the block's pivot."""
    ids, sizes, entries, first = _flat(part)
    pivot = key[0].as_py()
    hit = np.zeros(len(ids), bool)
    for at in np.flatnonzero(ids == pivot):  # more than one only where an id has several texts
        row = np.sort(entries[first[at]:first[at + 1]])
        place = np.minimum(np.searchsorted(row, entries), len(row) - 1)
        total = np.concatenate([[0], np.cumsum(row[place] == entries)])
        hit |= total[first[1:]] - total[first[:-1]] >= _needed(sizes + sizes[at])
    return _edges([(pivot, int(i)) for i in ids[hit & (ids != pivot)]])


def _tile_product(key, part):
    """Overlaps of rows of two tiles, or of one with itself, that are in different classes.

    A link merges the two classes, so that the rest of their pairs is skipped.
    """
    ids, sizes, entries, first = _flat(part)
    _, classes = np.unique(part.column("class").to_numpy(), return_inverse=True)
    side = part.column("side").to_numpy()
    same = key[1].as_py() == key[2].as_py()
    # pairs inside the largest class are settled, and its pairs with others come up from the other row
    rows = np.flatnonzero(classes != np.bincount(classes).argmax() if same else side == 0)
    targets = np.ones(len(ids), bool) if same else side == 1
    column = np.argsort(entries, kind="stable")
    sorted_entries = entries[column]
    holder = np.repeat(np.arange(len(ids)), np.diff(first))[column]
    pairs = []
    for i in rows:
        mine = entries[first[i]:first[i + 1]]
        low = np.searchsorted(sorted_entries, mine)
        count = np.searchsorted(sorted_entries, mine, side="right") - low
        spots = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        overlap = np.bincount(holder[spots], minlength=len(ids))
        for j in np.flatnonzero((overlap >= _needed(sizes + sizes[i])) & targets):
            if classes[j] != classes[i]:
                pairs.append((int(ids[i]), int(ids[j])))
                classes[classes == classes[j]] = classes[i]
    return _edges(pairs)


def ngram_sets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: ``doc_id``, set size ``n``, ``digest`` of the set, and for rows
    that may have a partner the n-grams shared with other documents, rarest first (``grams``), and how many
    of them a partner must be looked for under (``prefix``). Without words, or a null text: n is 0."""
    ship_package(docs.sparkSession)
    blocks = buckets(docs.sparkSession, 2)
    sent = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(_send(blocks)), _PARTS)
    counted = sent.groupBy("bucket").applyInArrow(_count, _PARTS)
    return counted.groupBy("batch").applyInArrow(_gather, _SETS)


def jaccard_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(sets, labels)``: one row per document with its set, and ``(id, label)`` for linked representatives."""
    sets = materialize(ngram_sets(docs))
    live = sets.where("grams is not null and doc_id is not null")
    first = live.groupBy("digest").agg(F.min("doc_id").alias("id"))
    rows = materialize(
        live.join(first.select(F.col("digest").alias("_digest"), "id"),
                  (F.col("doc_id") == F.col("id")) & (F.col("digest") == F.col("_digest")))
        .select("id", "digest", "n", "grams", "prefix", F.size("grams").alias("m")).dropDuplicates(["id", "digest"]))

    under = rows.select("id", F.explode(F.expr("slice(grams, 1, greatest(prefix, 0))")).alias("gram"))
    lists = under.groupBy("gram").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot <> last")
    members = materialize(under.join(lists, "gram").select("pivot", "id").distinct())

    # the pivot's row against its block
    narrow = rows.select("id", "n", "m")
    sized = (members.where("pivot <> id").join(narrow, "id")
             .join(narrow.select(F.col("id").alias("pivot"), F.col("n").alias("pivot_n")), "pivot")
             .where("4 * least(n, pivot_n) >= 3 * greatest(n, pivot_n)"))
    chunks = sized.groupBy("pivot").agg(F.ceil(F.sum("m") / F.lit(TILE)).cast("int").alias("chunks"))
    body = rows.select("id", "n", "grams")
    placed = (sized.join(chunks, "pivot").selectExpr("pivot", "pmod(hash(id), chunks) as chunk", "id")
              .unionByName(chunks.selectExpr("pivot", "explode(sequence(0, chunks - 1)) as chunk", "pivot as id")))
    star = materialize(placed.join(body, "id").groupBy("pivot", "chunk").applyInArrow(_pivot_product, _EDGES))
    labels = components(star)

    # pairs of a block that are still in different classes
    others = (members.where("pivot <> id").join(labels, "id", "left")
              .select("pivot", "id", F.coalesce("label", "id").alias("class")))
    mixed = others.groupBy("pivot").agg(F.min("class").alias("_low"), F.max("class").alias("_high")).where("_low <> _high")
    others = materialize(others.join(mixed.select("pivot"), "pivot").join(narrow.select("id", "m"), "id"))
    weights = others.groupBy("pivot", "class").agg(F.sum("m").alias("w"))
    small = weights.where(F.col("w") < TILE).groupBy("pivot").agg(F.sum("w").alias("small"))
    tiled = (others.join(weights, ["pivot", "class"]).join(small, "pivot", "left").selectExpr(
        "pivot", "id", "class",
        f"case when w < {TILE} then concat('s', pmod(hash(class), cast(ceil(small / {TILE}) as int))) "
        f"else concat('c', class, ':', pmod(hash(id), cast(ceil(w / {TILE}) as int))) end as tile",
        f"if(w < {TILE}, null, class) as whole"))
    tiles = tiled.select("pivot", "tile", "whole").distinct()
    right = tiles.select("pivot", F.col("tile").alias("tile_b"), F.col("whole").alias("whole_b"))
    pairs = (tiles.join(right, "pivot").where("tile <= tile_b and not coalesce(whole = whole_b, false)")
             .select("pivot", F.col("tile").alias("tile_a"), "tile_b"))
    shipped = (pairs.selectExpr("pivot", "tile_a", "tile_b", "tile_a as tile", "0 as side")
               .unionByName(pairs.where("tile_a <> tile_b").selectExpr("pivot", "tile_a", "tile_b", "tile_b as tile", "1 as side"))
               .join(tiled.drop("whole"), ["pivot", "tile"]).drop("tile").join(body, "id"))
    cross = shipped.groupBy("pivot", "tile_a", "tile_b").applyInArrow(_tile_product, _EDGES)
    chain = labels.select(F.col("id").alias("a"), F.col("label").alias("b"))
    # an id with several texts joins what these are copies of
    several = live.groupBy("doc_id").agg(F.min("digest").alias("_low"), F.max("digest").alias("_high")).where("_low <> _high")
    texts = live.join(several, "doc_id", "left_semi").join(first, "digest").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    return sets, components(chain.unionByName(cross).unionByName(texts))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Near-duplicate classes of ``docs``: ``doc_id, n_shingles, component_id``, a row per row of ``docs``.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; a set holds the distinct
    5-word shingles, or the whole sequence of a shorter text. Two documents link when their Jaccard
    similarity is at least 0.75; ``component_id`` is the smallest ``doc_id`` that links reach. Null or
    wordless texts have 0 shingles and link with nothing. Rows that repeat a ``doc_id`` are one
    document to the links. A row with a null ``doc_id`` links with nothing and its component is null.
    Other columns of ``docs`` are not read.
    """
    sets, labels = jaccard_links(docs)
    first = sets.where("grams is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"))
    # copies hang on their first; a document whose id has several texts hangs on each of them
    named = materialize(first.join(labels.withColumnRenamed("id", "_at"), F.col("id") == F.col("_at"), "left")
                        .select("digest", F.coalesce("label", "id").alias("label")))
    found = attach_by_key(sets.select("doc_id", F.col("n").alias("n_shingles"), "digest"), named, "digest")
    return found.select("doc_id", "n_shingles",
                        F.when(F.col("doc_id").isNotNull(), F.least(F.coalesce("label", "doc_id"), "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component.

    Rows that repeat a ``doc_id`` are one document: one of them stays. Rows with a null ``doc_id`` stay.
    """
    found = materialize(jaccard_components(docs))
    gone = found.where("doc_id <> component_id").select("doc_id")
    repeated = materialize(found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    once = without(docs, F.col("doc_id"), materialize(gone.union(repeated).distinct()))
    if repeated.isEmpty():
        return once
    again = docs.join(repeated.join(gone, "doc_id", "left_anti"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(again.select(docs.columns))


@query("op2_jaccard")
def op2_jaccard(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))
