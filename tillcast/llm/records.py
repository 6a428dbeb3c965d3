"""Token ids in length-delimited binary records, with an offset index beside each file.

A record is: the payload's length (8 bytes), a masked checksum of these 8 bytes
(4), the payload, and a masked checksum of the payload (4), all little-endian.
The payload is: 1 if the document has an id (1 byte), the id (8), the bytes per
token id (1), the token ids. The index holds, per record, its offset in the file
(8) and its number of token ids (8), so that readers can fetch records in any
order. Files are named by what the tasks that wrote them report; a file left by a
task that was lost is never read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, new_path
from .common import buckets, query, ship_package, table
from .textnum import slices, text_bytes

MASK = 0xA282EAD8  # added to a checksum after its bits are rotated by 15
CHUNKS_KEPT = 1_500_000  # encoded chunks that a worker remembers, some 200 bytes each
CHUNKS_TOGETHER = 1_000  # encoded in one call
CHUNKS_AT_ONCE = 500_000  # of one text

_HEAD, _CHECK, _FRONT, _ENTRY = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<?qB"), struct.Struct("<QQ")
_FILES = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("path", T.StringType()),
    T.StructField("records", T.LongType()), T.StructField("tokens", T.LongType()),
])
_FILES_ARROW = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("tokens", pa.int64())])
_ROWS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])
_ROWS_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def masked(data: bytes) -> int:
    value = zlib.crc32(data)
    return ((value >> 15 | value << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = _HEAD.pack(len(payload))
    return b"".join((head, _CHECK.pack(masked(head)), payload, _CHECK.pack(masked(payload))))


def unframe(file) -> bytes | None:
    """The next payload, or None at the end of the file; a damaged record is an error."""
    head = file.read(12)
    if not head:
        return None
    if len(head) < 12 or _CHECK.unpack(head[8:])[0] != masked(head[:8]):
        raise ValueError("damaged record length")
    size = _HEAD.unpack(head[:8])[0]
    body = file.read(size + 4)
    if len(body) < size + 4 or _CHECK.unpack(body[size:])[0] != masked(body[:size]):
        raise ValueError("damaged record")
    return body[:size]


def pack(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return _FRONT.pack(doc_id is not None, doc_id or 0, width) + ids


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    known, doc_id, width = _FRONT.unpack_from(payload)
    ids = np.frombuffer(payload, {2: "<u2", 4: "<u4"}[width], offset=_FRONT.size)
    return (doc_id if known else None), ids.astype("<u4")


def _open(uri: str):
    """File system and path of a URI; Hadoop writes local ones with a single slash."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


class ChunkEncoder:
    """Token ids by the tokenizers library, remembered by chunk.

    A chunk is a run without ASCII white space. The tokenizer has to treat white
    space as a break that leaves no token: then the ids of a text are those of its
    chunks, and each distinct chunk is encoded once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65536 else 4
        if [t for s in (" ", "\t", "\n", "\v", "\f", "\r") for t in self.tokenizer.encode(s, add_special_tokens=False).ids]:
            raise ValueError("this tokenizer keeps white space: its chunks do not stand alone")
        self.known: dict[bytes, bytes] = {}

    def _learn(self, chunks: set[bytes]) -> None:
        new = [c for c in chunks if c not in self.known]
        if len(self.known) + len(new) > CHUNKS_KEPT:
            self.known.clear()
            new = list(chunks)
        for i in range(0, len(new), CHUNKS_TOGETHER):
            self._encode_together(new[i:i + CHUNKS_TOGETHER])

    def _encode_together(self, chunks: list[bytes]) -> None:
        """Encode chunks as one text, and cut its ids where the chunks begin."""
        text = b" ".join(chunks).decode("utf-8", "replace")
        begins = np.cumsum([0] + [len(c) + 1 for c in text.split(" ")])
        found = self.tokenizer.encode(text, add_special_tokens=False)
        places = np.array([low for low, _ in found.offsets], np.int64)
        cuts = (np.searchsorted(places, begins) * self.width).tolist()
        ids = np.array(found.ids, f"<u{self.width}").tobytes()
        self.known.update((c, ids[low:high]) for c, low, high in zip(chunks, cuts, cuts[1:]))

    def encode(self, text: bytes) -> bytes:
        """Ids of a text, ``width`` little-endian bytes each."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of some texts; together they should not be much larger than one may be."""
        split = [text.split() for text in texts]
        out = []
        if sum(map(len, split)) <= CHUNKS_AT_ONCE:
            self._learn(set(chain.from_iterable(split)))
            return [b"".join(map(self.known.__getitem__, chunks)) for chunks in split]
        for chunks in split:
            parts = []
            for i in range(0, len(chunks), CHUNKS_AT_ONCE):
                some = chunks[i:i + CHUNKS_AT_ONCE]
                self._learn(set(some))
                parts.append(b"".join(map(self.known.__getitem__, some)))
            out.append(b"".join(parts))
        return out


_encoders: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def _encoded(batches, encoder: ChunkEncoder):
    """Ids of each document, a slice of text encoded at a time."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        docs = batch.column(0).to_pylist()
        for low, high in slices(offsets, 2_000_000):
            whole = data[offsets[low]:offsets[high]].tobytes()
            at = (offsets[low:high + 1] - offsets[low]).tolist()
            yield from zip(docs[low:high], encoder.encode_all([whole[a:b] for a, b in zip(at, at[1:])]))


def _write(batches, model_path: str, folder: str, end_id: int):
    """Write the rows of one task to one file and its index, and say what they are."""
    encoder = _encoder(model_path)
    end = np.array([end_id], f"<u{encoder.width}").tobytes()
    context = TaskContext.get()
    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    name = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}"
    place = tokens = records = 0
    with store.open_output_stream(f"{root}/{name}.rec", buffer_size=1 << 20) as out, \
            store.open_output_stream(f"{root}/{name}.idx", buffer_size=1 << 16) as index:
        for doc_id, ids in _encoded(batches, encoder):
            ids += end
            record = frame(pack(doc_id, ids, encoder.width))
            out.write(record)
            index.write(_ENTRY.pack(place, len(ids) // encoder.width))
            place, tokens, records = place + len(record), tokens + len(ids) // encoder.width, records + 1
    yield pa.RecordBatch.from_arrays(
        [pa.array([v], t) for v, t in zip((context.partitionId(), f"{folder}/{name}", records, tokens), _FILES_ARROW.types)],
        schema=_FILES_ARROW)


def write_records(docs: DataFrame, model_path: str, folder: str, end_id: int) -> DataFrame:
    """Encode ``docs (doc_id, text)`` and write record files to ``folder``, a URI that all executors reach.

    Files follow one another in ascending ``doc_id`` (nulls first, rows of one id in the order of their
    text's hash, so that an id with very many rows can span files). Returns a row per file: ``shard``,
    ``path`` (add .rec or .idx), ``records``, ``tokens``. Null texts are empty and give the end id alone.
    Other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(buckets(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    files = dealt.select("doc_id", "text").mapInArrow(lambda batches: _write(batches, model_path, folder, end_id), _FILES)
    return materialize(files)


def read_file(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """Documents of one record file, checked, a record in memory at a time."""
    store, place = _open(path)
    with store.open_input_stream(f"{place}.rec", buffer_size=1 << 20) as file:
        while (payload := unframe(file)) is not None:
            yield unpack(payload)


def read_record(path: str, number: int) -> tuple[int | None, np.ndarray]:
    """One document of a record file, found through the index."""
    store, place = _open(path)
    with store.open_input_file(f"{place}.idx") as index:
        offset, count = _ENTRY.unpack(index.read_at(_ENTRY.size, _ENTRY.size * number))
    with store.open_input_file(f"{place}.rec") as file:
        file.seek(offset)
        doc_id, ids = unpack(unframe(file))
    if len(ids) != count:
        raise ValueError("index and record disagree")
    return doc_id, ids


def _read(batches):
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = []
            for doc_id, ids in read_file(path):
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                start += len(ids)
                if len(rows) == 10_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)


def _batch(rows):
    columns = list(zip(*rows)) if rows else [[]] * len(_ROWS_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ROWS_ARROW.types)], schema=_ROWS_ARROW)


def read_records(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files that ``write_records`` lists.

    ``start`` counts the ids of all earlier documents; only file totals, one row per file, are summed up
    in one place.
    """
    ship_package(files.sparkSession)
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    placed = files.select("shard", "path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))
    spread = placed.repartition(buckets(files.sparkSession), "shard")
    return spread.select("path", "start").mapInArrow(_read, _ROWS)


@query("op8_records")
def op8_records(spark, sf_dir):
    folder = new_path(spark, "records")
    return read_records(write_records(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder, 1))
