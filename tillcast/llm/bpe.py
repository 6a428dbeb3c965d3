"""Byte-level BPE from a tokenizer file: merges by a priority queue over a linked list of symbols."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memory, lean, query, ship_package, table

HALF_KEPT = 400_000  # encoded chunks and pieces in each half of what a worker remembers, some 350 bytes each
PLACE = 2**40 - 1  # bits of a place in a queued number, below the rank
PIECE_CHARS = 1_000  # chunks longer than this are encoded anew each time

# White space, and the pattern that cuts a text into the pieces that merges stay within.
_SPACE = r"\t-\r \x85\xa0  -     　"
PIECE = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
# Every piece lies within one of these, so they can be cut out first and remembered.
CHUNK = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is visible Latin-1, else one from 256 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in visible]
    named = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [named[b] for b in range(256)]


# Of a chunk: how many ids it has, their bytes, how they are written (each with a comma), and what they decode to.
Entry = tuple[int, bytes, str, str]


class Bpe:
    """Encoder and decoder of one tokenizer file (byte-level, no normalizer, no added prefix space)."""

    def __init__(self, path: str, half_kept: int = HALF_KEPT):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, shape = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or shape["type"] != "ByteLevel" or shape["add_prefix_space"] or not shape["use_regex"]:
            raise ValueError("not a plain byte-level BPE file")
        characters = byte_characters()
        self.vocab: dict[str, int] = model["vocab"]
        self.first = [self.vocab[c] for c in characters]
        # by left id, then right id: rank, above the bits of a place, and merged id
        self.merges: list[dict[int, tuple[int, int]]] = [{} for _ in range(max(self.vocab.values()) + 1)]
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[self.vocab[left]][self.vocab[right]] = rank * (PLACE + 1), self.vocab[left + right]
        values = {c: b for b, c in enumerate(characters)}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: bytes(values[c] for c in token) for token, i in self.vocab.items()}
        self.strings |= {i: content.encode() for content, i in added.items()}
        # strings of special tokens in a text are these tokens, the longest first
        self.special = {content: (1, array("I", [i]).tobytes(), f"{i},", content) for content, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.digits = {i: f"{i}," for i in self.strings}
        self.known = Memory(half_kept)

    def merge(self, data: bytes) -> list[int]:
        """Token ids of one piece."""
        merges = self.merges
        symbols = list(map(self.first.__getitem__, data))
        # a queued number holds rank and place; what a place waits for tells whether it is still meant
        waits = [merges[left].get(right) for left, right in pairwise(symbols)]
        queue = [found[0] + i for i, found in enumerate(waits) if found is not None]
        if not queue:
            return symbols
        heapify(queue)
        end = len(symbols)
        waits.append(None)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        while queue:
            entry = heappop(queue)
            i = entry & PLACE
            found = waits[i]
            if found is None or found[0] + i != entry:
                continue  # stale: one of the two symbols has been merged since
            merged, j = found[1], after[i]
            symbols[i], symbols[j], waits[j] = merged, -1, None
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                waits[i] = found = merges[merged].get(symbols[k])
                if found is not None:
                    heappush(queue, found[0] + i)
            else:
                waits[i] = None
            if i:
                h = before[i]
                waits[h] = found = merges[symbols[h]].get(merged)
                if found is not None:
                    heappush(queue, found[0] + h)
        return [s for s in symbols if s >= 0]

    def _piece(self, piece: str) -> Entry:
        ids = self.merge(piece.encode())
        decoded = self.decode(ids)
        return len(ids), array("I", ids).tobytes(), self.written(ids), piece if decoded == piece else decoded

    def _chunk(self, chunk: str) -> Entry:
        pieces = PIECE.findall(chunk)
        if len(pieces) == 1:
            entry = self._piece(chunk)
        else:
            parts = []
            for piece in pieces:
                if (part := self.known.get(piece)) is None:
                    part = self._piece(piece)
                    if len(piece) <= PIECE_CHARS:
                        self.known.put(piece, part)
                parts.append(part)
            counts, ids, written, decoded = zip(*parts)
            decoded = "".join(decoded)
            entry = sum(counts), b"".join(ids), "".join(written), chunk if decoded == chunk else decoded
        if len(chunk) <= PIECE_CHARS:
            self.known.put(chunk, entry)
        return entry

    def entries(self, text: str) -> list[Entry]:
        """What is remembered of each chunk of a text, in order."""
        new, get, make, out = self.known.new.get, self.known.get, self._chunk, []
        for part in self.cut.split(text) if self.cut else (text,):
            if part in self.special:
                out.append(self.special[part])
                continue
            for chunk in CHUNK.findall(part):
                entry = new(chunk)
                if entry is None:
                    entry = get(chunk) or make(chunk)
                    new = self.known.new.get  # the half may be another one now
                out.append(entry)
        return out

    def encode(self, text: str) -> array:
        """Token ids of a text."""
        return array("I", b"".join([e[1] for e in self.entries(text)]))

    def written(self, ids) -> str:
        """The ids as decimal numbers, each with a comma behind it."""
        return "".join(map(self.digits.__getitem__, ids))

    def decode(self, ids) -> str:
        """The strings of the tokens, one after the other; broken UTF-8 gives replacement characters."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[tuple[str, int], Bpe] = {}


def bpe(path: str, half_kept: int = HALF_KEPT) -> Bpe:
    """The tokenizer in ``path``, loaded once per Python worker."""
    if (path, half_kept) not in _loaded:
        _loaded.clear()
        _loaded[path, half_kept] = Bpe(path, half_kept)
    return _loaded[path, half_kept]


_TOKENS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
])
_TOKENS_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                           ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32()))])


ROWS_BYTES = 1_000_000  # of token ids that are held before rows are given on


def _tokens(path: str, with_ids: bool, half_kept: int):
    def run(batches):
        tokenizer = bpe(path, half_kept)
        for batch in batches:
            rows, held, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                entries = tokenizer.entries(text.as_py() or "")
                written = "".join([e[2] for e in entries])[:-1]
                decoded = "".join([e[3] for e in entries])
                rows.append((doc_id, sum([e[0] for e in entries]), hashlib.sha256(written.encode()).hexdigest(),
                             hashlib.sha256(decoded.encode()).hexdigest()))
                if with_ids:
                    held.append(b"".join([e[1] for e in entries]))
                    size += len(held[-1])
                    if size > ROWS_BYTES:
                        yield _batch(rows, held)
                        rows, held, size = [], [], 0
            yield _batch(rows, held if with_ids else None)
    return run


def _batch(rows, ids: list[bytes] | None):
    columns = list(zip(*rows)) if rows else [[]] * (len(_TOKENS_ARROW) - 1)
    arrays = [pa.array(c, t) for c, t in zip(columns, _TOKENS_ARROW.types)]
    if ids is None:
        lists = pa.nulls(len(rows), _TOKENS_ARROW.types[-1])
    else:
        first = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(first), pa.array(np.frombuffer(b"".join(ids), np.int32)))
    return pa.RecordBatch.from_arrays([*arrays, lists], schema=_TOKENS_ARROW)


def bpe_tokens(docs: DataFrame, path: str, with_ids: bool = False, half_kept: int = HALF_KEPT) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: ``n_tokens``, digests of the ids and of the decoded text, and ``ids`` if asked for.

    Whole texts are encoded, without tokens for begin and end; the string of a special token inside a text
    is that token. Null and empty texts have no tokens; a null ``doc_id`` stays null; repeated rows each
    give a row. Other columns are not read. ``half_kept`` bounds what a worker remembers, and changes no result.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lean(_tokens(path, with_ids, half_kept)), _TOKENS)


@query("op10_bpe")
def op10_bpe(spark, sf_dir):
    return bpe_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")
