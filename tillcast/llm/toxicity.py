"""Toxicity by averaged subword vectors under a linear softmax, trained together.

A text is the average of the vectors of its character n-grams (3 to 6 characters
of a word with its borders), so that a misspelt word still shares most of its
vectors. The vectors and the softmax are trained together in numpy on a bounded
sample of labelled texts; scoring needs one number per n-gram bucket and reads
every text whole.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import lean, query, ship_package, table
from .textnum import U, mix

THRESHOLD = 0.7
PIECE = 100_000  # characters looked at together
SIZES = (3, 4, 5, 6)


@dataclass(frozen=True)
class Training:
    """Bounds and settings of the fit. The sample holds at most ``most_toxic`` and ``most_clean`` texts of at
    most ``most_chars`` characters; which ones, a hash of the id decides."""

    most_toxic: int = 4_000
    most_clean: int = 10_000
    most_chars: int = 20_000
    buckets: int = 2**17
    width: int = 8
    scale: float = 100.0  # of the average, so that a few words in a thousand can count
    padding: int = 200  # neutral n-grams averaged in, so that a few words alone decide little
    epochs: int = 6
    batch: int = 64
    step: float = 0.1
    seed: int = 7


# Code points below 0x250 in lower case; letters, digits and everything above stand in words.
_FOLD = np.arange(0x250, dtype=np.uint32)
for _i in range(0x250):
    if len(chr(_i).lower()) == 1 and ord(chr(_i).lower()) < 0x250:
        _FOLD[_i] = ord(chr(_i).lower())
_IN_WORD = np.array([chr(i).isalnum() for i in range(0x250)])
_BREAK = re.compile(r"\s")


def _characters(text: str) -> np.ndarray:
    """Code points, folded, with a space for whatever stands in no word."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).copy()
    low = points < 0x250
    folded = _FOLD[np.where(low, points, 0)]
    points = np.where(low, np.where(_IN_WORD[np.where(low, points, 0)], folded, 32), points)
    return points.astype(np.uint64)


def ngram_buckets(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and the text that each belongs to."""
    points = _characters(" " + "  ".join(texts) + " ")
    # n-grams of two texts never mix: two spaces stand between them
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths + 2)])[:-1]
    space = points == 32
    clear = np.concatenate([[0], np.cumsum(space)])
    coded = mix(points)
    out, where = [], []
    value = np.zeros(len(points), np.uint64)
    longest = max(SIZES)
    for size in range(1, longest + 1):
        n = len(points) - size + 1
        if n <= 0:
            break
        value = value[:n] * U(0x9E3779B97F4A7C15) + coded[size - 1:]
        if size in SIZES:
            inside = clear[size - 1:size - 1 + n] == clear[1:1 + n]  # no space but at the ends
            at = np.flatnonzero(inside & ~(space[1:1 + n] | space[size - 2:size - 2 + n]))
            out.append((mix(value[at] + U(size)) & U(buckets - 1)).astype(np.int64))
            where.append(np.searchsorted(starts, at, side="right") - 1)
    return (np.concatenate(out), np.concatenate(where)) if out else (np.empty(0, np.int64),) * 2


def _pieces(texts: list[str]):
    """Texts in lists of a bounded size, with their places; a longer text is cut between words."""
    held, owners, size = [], [], 0
    for i, text in enumerate(texts):
        low = 0
        while True:
            high = len(text)
            if high - low > PIECE:
                spot = _BREAK.search(text, low + PIECE)
                high = spot.start() if spot else high
            held.append(text[low:high])
            owners.append(i)
            size += high - low
            if size >= PIECE:
                yield held, np.array(owners)
                held, owners, size = [], [], 0
            low = high
            if low >= len(text):
                break
    if held:
        yield held, np.array(owners)


@dataclass
class Model:
    """What scoring needs: the vectors times the softmax's weights, label 1 against label 0."""

    weights: np.ndarray
    bias: float
    padding: int

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 for each text."""
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for pieces, owners in _pieces(texts):
            buckets, where = ngram_buckets(pieces, len(self.weights))
            total += np.bincount(owners[where], weights=self.weights[buckets], minlength=len(texts))
            count += np.bincount(owners[where], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total / (count + self.padding) + self.bias, -60, 60)))


_BLOCK = 2**16


class _Features:
    """Buckets of each text with their counts, in arrays that grow by an eighth, where they lie if they can.

    Buckets of a text rise, so the lower 16 bits and where each block of 2**16 begins say all of them: four
    bytes an entry with its count. The driver holds the whole sample at once.
    """

    def __init__(self, texts: list[str], how: Training):
        self.padding, blocks = how.padding, -(-how.buckets // _BLOCK)
        self.first = np.zeros(len(texts) + 1, np.int64)
        self.begins = np.zeros((len(texts), blocks), np.int64)
        self.low, self.counts = np.empty(1 << 20, np.uint16), np.empty(1 << 20, np.uint16)
        for i, text in enumerate(texts):
            own, counts = np.unique(ngram_buckets([text], how.buckets)[0], return_counts=True)
            start, end = self.first[i], self.first[i] + len(own)
            while end > len(self.low):
                for values in (self.low, self.counts):
                    values.resize(len(values) + len(values) // 8, refcheck=False)
            self.low[start:end] = own & (_BLOCK - 1)
            self.counts[start:end] = np.minimum(counts, _BLOCK - 1)
            self.begins[i] = np.searchsorted(own, np.arange(blocks) * _BLOCK)
            self.first[i + 1] = end

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of a text, and their shares of its n-grams."""
        start, end = self.first[i], self.first[i + 1]
        ids = self.low[start:end].astype(np.int32)
        for begin in self.begins[i, 1:]:
            ids[begin:] += _BLOCK
        counts = self.counts[start:end]
        return ids, (counts / (counts.sum(dtype=np.int64) + self.padding)).astype(np.float32)


def fit(texts: list[str], labels: np.ndarray, how: Training) -> Model:
    """Train vectors and softmax together by Adagrad on shuffled batches; without both labels, the more common one is sure."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(how.buckets), 60.0 if len(labels) and labels[0] == 1 else -60.0, how.padding)
    rng = np.random.default_rng(how.seed)
    vectors = np.zeros((how.buckets, how.width), np.float32)  # an n-gram that was never seen says nothing
    softmax, bias = rng.normal(0, 0.5, (how.width, 2)).astype(np.float32), np.zeros(2, np.float32)
    square_v, square_s, square_b = np.full((how.buckets, how.width), 1e-6, np.float32), np.full((how.width, 2), 1e-6), np.full(2, 1e-6)
    features = _Features(texts, how)
    for _ in range(how.epochs):
        order = rng.permutation(len(texts))
        for low in range(0, len(order), how.batch):
            part = order[low:low + how.batch]
            sizes = features.first[part + 1] - features.first[part]
            if not sizes.sum():
                continue
            ids, share = map(np.concatenate, zip(*map(features.of, part)))
            share = share * how.scale
            text = np.repeat(np.arange(len(part)), sizes)
            used, place = np.unique(ids, return_inverse=True)
            taken = vectors[used]
            mean = np.stack([np.bincount(text, weights=taken[place, d] * share, minlength=len(part)) for d in range(how.width)], 1)
            logits = mean @ softmax + bias
            odds = np.exp(logits - logits.max(1, keepdims=True))
            error = odds / odds.sum(1, keepdims=True)
            error[np.arange(len(part)), labels[part]] -= 1
            error /= len(part)
            back = error @ softmax.T
            change = np.stack([np.bincount(place, weights=back[text, d] * share, minlength=len(used)) for d in range(how.width)], 1)
            square_v[used] += change**2
            vectors[used] = taken - how.step * change / np.sqrt(square_v[used])
            for value, slope, square in ((softmax, mean.T @ error, square_s), (bias, error.sum(0), square_b)):
                square += slope**2
                value -= (how.step * slope / np.sqrt(square)).astype(np.float32)
    weights = (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float64) * how.scale
    return Model(weights, float(bias[1] - bias[0]), how.padding)


_SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])
_SCORES_ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def held_out(doc_id=None):
    """Whether a row's label is kept from training: by the checksum of its id."""
    return F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string").cast("binary")) % 3 == 1


def _smallest_hashes(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows with the smallest hashes of their ``doc_id``, or all if there are fewer.

    Rows are counted, and cut at a hash below which about that many lie, so that what is put in order in one
    place is little more than what is asked for, however many tasks the rows come from.
    """
    order = F.xxhash64("doc_id"), F.col("doc_id")
    share = (most + 10 * most**0.5 + 100) / max(rows.count(), 1)
    if share < 1:
        least = rows.where(order[0] <= int(-2**63 + share * (2**64 - 1)))
        if least.count() >= most:
            rows = least
    return rows.orderBy(*order).limit(most)


def train_toxicity(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Model:
    """Fit on a bounded sample of ``docs (doc_id, text)`` with ``labels (doc_id, toxic)``, never on held-out ids.

    Rows without an id, text or label do not count, nor texts above the bound; an id with several labels is
    toxic if one of them is, and of several texts the smallest is taken. The sample is filled from what counts.
    If that has one label only although the documents' labels have both, there is nothing to learn from: an
    error; a warning, if both are only among the labels of other documents.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    texts_of = (docs.select("doc_id", F.col("text").cast("string").alias("text"))
                .where(F.col("doc_id").isNotNull() & (F.length("text") <= how.most_chars)))
    usable = materialize(known.join(texts_of.select("doc_id").distinct(), "doc_id", "left_semi"))  # two numbers a row
    chosen = _smallest_hashes(usable.where("toxic = 1"), how.most_toxic).union(_smallest_hashes(usable.where("toxic = 0"), how.most_clean))
    # at most most_toxic + most_clean rows of two numbers
    sample = (texts_of.join(F.broadcast(chosen), "doc_id")
              .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))
    rows = sample.toArrow().sort_by("doc_id")
    texts, toxic = rows.column("text").to_pylist(), rows.column("toxic").to_numpy().astype(np.int64)
    if len(set(toxic.tolist())) == 1 and known.select("toxic").distinct().count() == 2:
        said = f"all usable texts have label {toxic[0]}, though the labels have both"
        if known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("toxic").distinct().count() == 2:
            raise ValueError(said)
        warnings.warn(f"{said}: no document has the other one", stacklevel=2)
    del rows
    pa.default_memory_pool().release_unused()
    return fit(texts, toxic, how)


ROWS = 500  # texts of a batch that are held as strings at a time


def _scores(texts, model: Model) -> np.ndarray:
    parts = [model.scores([t or "" for t in texts.slice(low, ROWS).to_pylist()]) for low in range(0, len(texts), ROWS)]
    return np.concatenate(parts) if parts else np.empty(0)


def _score(batches, model):
    for batch in batches:
        scores = _scores(batch.column(1), model.value)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], schema=_SCORES_ARROW)


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for each row of ``docs (doc_id, text)``; null and empty texts get the score of no words at all.

    A null ``doc_id`` stays null; repeated rows each give a row; other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # one number per bucket
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lean(lambda batches: _score(batches, shared)), _SCORES)


def _clean(batches, model, column):
    for batch in batches:
        scores = _scores(batch.column(column), model.value)
        yield batch.filter(pa.array(scores < THRESHOLD))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    spark = docs.sparkSession
    ship_package(spark)
    shared, column = spark.sparkContext.broadcast(model), docs.columns.index("text")
    return docs.mapInArrow(lean(lambda batches: _clean(batches, shared, column)), docs.schema)


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scores = toxicity_scores(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
