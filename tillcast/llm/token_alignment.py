"""Alignment of two tokenizations of the same bytes, and how often token pairs are linked in the corpus.

Both tokenizations of a text are arrays of byte offsets at which tokens end. Where
both have an end, a group closes. Along stretches where tokens correspond one to one
the arrays are equal at a constant shift of their indices: exponential probing
compares ever longer pieces of them and jumps the whole stretch. Where they differ,
the irregular group is walked token by token, and the shift it leaves is the next one.

The last tokens of a group are linked. The bytes of one are then the end of the
other's, so the vocabularies bound the number of different links: the table of
their counts has at most that many rows, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .bpe import byte_characters
from .common import query, ship_package, table

BATCH_CHARS = 500_000  # of texts encoded together; a longer text stands alone
_SHIFT = 32  # a pair of ids is one number: the first id above this bit, the second below

_ALIGNED = T.StructType([
    *(T.StructField(n, T.LongType()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), T.StructField("groups_sha256", T.StringType()),
    T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType())),
])
_ALIGNED_ARROW = pa.schema([*((n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()),
                            ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])
_RATED = T.StructType([
    *(T.StructField(n, T.LongType()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")),
    T.StructField("groups_sha256", T.StringType()),
])
_RATED_ARROW = pa.schema([*((n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")),
                          ("groups_sha256", pa.string())])


def groups(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tokens of either side up to the end of each group; both arrays rise to the same last offset."""
    stretches: list[tuple[int, int, int]] = []  # the group that closes first on either side, and how many more are one to one
    ends_a, ends_b, n = [*ends_a, -1], [*ends_b, -2], len(ends_a)  # no stretch goes on over the marks at the ends
    i = j = 0
    while i < n:
        x, y = ends_a[i], ends_b[j]
        if x == y:
            # the stretch of equal ends on this diagonal: steps double while they agree and halve after that
            p, q, step = i + 1, j + 1, 1
            while ends_a[p:p + step] == ends_b[q:q + step]:
                p += step
                q += step
                step *= 2
            while step > 1:
                step //= 2
                if ends_a[p:p + step] == ends_b[q:q + step]:
                    p += step
                    q += step
            stretches.append((i + 1, j + 1, p - i))
            i, j = p, q
            if i == n:
                break
            x, y = ends_a[i], ends_b[j]
        # an irregular group: the side that is behind takes its next token until both end together
        while x != y:
            if x < y:
                i += 1
                x = ends_a[i]
            else:
                j += 1
                y = ends_b[j]
        i += 1
        j += 1
        stretches.append((i, j, 1))
    first_a, first_b, runs = np.array(stretches, np.int64).reshape(-1, 3).T
    along = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    return np.repeat(first_a, runs) + along, np.repeat(first_b, runs) + along


class Side:
    """One tokenizer: ids of texts, with the bytes and the written form of each token."""

    def __init__(self, encode, strings: dict[int, bytes]):
        if not all(strings.values()):
            raise ValueError("a token without bytes")
        self.encode = encode
        self.strings = [strings.get(i, b"") for i in range(max(strings) + 1)]
        self.lengths = np.array([len(s) for s in self.strings], np.int64)
        # each id as written, with a comma behind it, in the bytes of one number: first character lowest, zeros after the last
        self.written = np.array([int.from_bytes(f"{i},".encode(), "little") for i in range(len(self.lengths))], np.uint64)
        self.mark_at = np.array([8 * len(str(i)) for i in range(len(self.lengths))], np.uint64)

    def tokens(self, ids: list[int], whole: bytes) -> np.ndarray | None:
        """The ids, if the bytes of their tokens are ``whole``."""
        if b"".join(map(self.strings.__getitem__, ids)) != whole:
            return None
        return np.frombuffer(array("q", ids), np.int64)


def byte_level_side(path: str) -> Side:
    """Space and text by a byte-level BPE file; strings of special tokens are plain text.

    The file's entries are given to tiktoken as ranks, which encodes several times faster than the library the
    file is written for. The ids of a file's merges have to rise with their order, as ranks do.
    """
    import tiktoken
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, shape = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or spec["normalizer"] or shape["type"] != "ByteLevel" or shape["add_prefix_space"] or not shape["use_regex"]:
        raise ValueError("not a plain byte-level BPE file")
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"][left + right] for left, right in merges]
    merged, values = set(ids), {c: b for b, c in enumerate(byte_characters())}
    bytes_of = {i: bytes(values[c] for c in t) for t, i in model["vocab"].items() if len(t) == 1 or i in merged}
    if any(x >= y for x, y in zip(ids, ids[1:])) or ids and max(i for i, s in bytes_of.items() if len(s) == 1) >= ids[0]:
        raise ValueError("the ids do not rise with the order of the merges")
    encoding = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN,
                                 mergeable_ranks={s: i for i, s in bytes_of.items()}, special_tokens={})
    return Side(lambda texts: [encoding.encode_ordinary(" " + t) for t in texts], bytes_of)


def piece_side(path: str) -> Side:
    """Text by a sentencepiece model that puts a space before it."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    strings = {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            strings[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            strings[i] = model.id_to_piece(i).replace("▁", " ").encode()
    return Side(lambda texts: model.encode(texts, num_threads=1), strings)


def possible_links(a: Side, b: Side) -> int:
    """How many pairs of tokens can end together in a text: the bytes of one are the end of the other's."""
    def ends(of: Side, among: Side, least: int) -> int:
        holders = Counter(s for s in among.strings if s)
        return sum(holders[s[k:]] for s in of.strings for k in range(least, len(s)))
    return ends(a, b, 0) + ends(b, a, 1)


_sides: dict[tuple[str, str], tuple[Side, Side]] = {}


def sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    """Both tokenizers, loaded once per Python worker."""
    if (path_a, path_b) not in _sides:
        _sides[path_a, path_b] = byte_level_side(path_a), piece_side(path_b)
    return _sides[path_a, path_b]


def _written(a: Side, b: Side, ids_a: np.ndarray, ids_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: ids by comma, sides by bar, groups by semicolon."""
    # where each token stands: behind those of its own side and of the other side's groups before it
    place_a = np.arange(len(ids_a)) + np.repeat(cuts_b - np.diff(cuts_b, prepend=0), np.diff(cuts_a, prepend=0))
    place_b = np.arange(len(ids_b)) + np.repeat(cuts_a, np.diff(cuts_b, prepend=0))
    size = len(ids_a) + len(ids_b)
    out = np.empty(len(ids_a) + len(ids_b), "<u8")
    out[place_a], out[place_b] = a.written[ids_a], b.written[ids_b]
    for side, ids, place, cuts, mark in ((a, ids_a, place_a, cuts_a, "|"), (b, ids_b, place_b, cuts_b, ";")):
        out[place[cuts - 1]] ^= np.uint64(ord(",") ^ ord(mark)) << side.mark_at[ids[cuts - 1]]
    return out.tobytes().translate(None, b"\0")[:-1]


def align(text: str, a: Side, b: Side, ids_a: list[int], ids_b: list[int]):
    """``n_a, n_b, n_groups, n_links``, the groups' digest, and the linked pairs with how often each is."""
    whole = b" " + text.encode()
    own_a, own_b = (a.tokens(ids_a, whole), b.tokens(ids_b, whole)) if text else (None, None)
    if own_a is None or own_b is None:
        return 0, 0, 0, 0, "", [], []
    cuts_a, cuts_b = groups(np.cumsum(a.lengths[own_a]).tolist(), np.cumsum(b.lengths[own_b]).tolist())
    # no token is empty, so the last ones of a group are the only ones that end where it does
    pairs, times = np.unique((own_a[cuts_a - 1] << _SHIFT) | own_b[cuts_b - 1], return_counts=True)
    digest = hashlib.sha256(_written(a, b, own_a, own_b, cuts_a, cuts_b)).hexdigest()
    return len(own_a), len(own_b), len(cuts_a), len(cuts_a), digest, pairs, times.astype(np.int32)


def _align(path_a: str, path_b: str):
    def run(batches):
        a, b = sides(path_a, path_b)
        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            low = 0
            while low < len(ids):
                texts, size, high = [], 0, low
                while high < len(ids) and (not texts or size < BATCH_CHARS):
                    texts.append(column[high].as_py() or "")
                    size += len(texts[-1])
                    high += 1
                rows = [(i, *align(t, a, b, x, y)) for i, t, x, y in zip(ids[low:high], texts, a.encode(texts), b.encode(texts))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ALIGNED_ARROW.types)], schema=_ALIGNED_ARROW)
                low = high
    return run


def aligned_tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: counts of tokens, groups and links, the groups' digest, and ``pairs``
    (two ids in one number) with how many links of the text hold each (``times``)."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_align(path_a, path_b), _ALIGNED)


def link_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, n, best)``: links in the corpus, and whether no pair with the same B id has more.

    A row per pair of tokens that is linked anywhere; ``possible_links`` bounds them.
    """
    cells = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counted = cells.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    counted = counted.withColumn("b", F.col("pair").bitwiseAND((1 << _SHIFT) - 1))
    most = counted.groupBy(F.col("b").alias("_b")).agg(F.max("n").alias("_most"))
    return counted.join(most, F.col("b") == F.col("_b")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def _rate(batches, shared):
    pairs, counts, best = shared.value
    for batch in batches:
        lists = batch.column("pairs")
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), sizes)
        at = np.searchsorted(pairs, lists.flatten().to_numpy(zero_copy_only=False))
        times = batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        n_best, count_sum = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        np.add.at(n_best, row, times * best[at])
        np.add.at(count_sum, row, times * counts[at])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(n_best), pa.array(count_sum),
             batch.column("groups_sha256").cast(pa.string())], schema=_RATED_ARROW)


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Tokens of two tokenizers over each text, in groups that end together, rated by links of the whole corpus.

    ``path_a`` is a byte-level BPE file, given a space and the text, and ``path_b`` a sentencepiece model, which
    puts a space before the text. A row per row of ``docs (doc_id, text)``: ``doc_id``; ``n_a``, ``n_b`` tokens;
    ``n_groups``; ``n_links``, pairs of tokens that end at one byte; ``n_best``, links whose pair is linked as
    often in all of ``docs`` as any with its B id, ties included; ``count_sum``, these counts added up over the
    links; ``groups_sha256``, of ids as ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and those whose tokens do not have the bytes of space and text, have no tokens: zeros
    and an empty ``groups_sha256``. A null ``doc_id`` stays null; repeated rows each count and each give a row;
    no rows give none; other columns are not read.

    Texts are aligned once and stored with their pairs. The counts that go to all tasks are a row per pair of
    tokens, bounded by the vocabularies (324,297 for the two files of the query), never by the documents.
    """
    spark = docs.sparkSession
    aligned = materialize(aligned_tokens(docs, path_a, path_b))
    counts = link_counts(aligned).toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast(tuple(counts.column(n).to_numpy() for n in ("pair", "n", "best")))
    return aligned.mapInArrow(lambda batches: _rate(batches, shared), _RATED)


@query("op12_token_alignment")
def op12_token_alignment(spark, sf_dir):
    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                            public_tokenizers.path("piece_bpe_32k.model"))
