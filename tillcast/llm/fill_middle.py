"""Fill-in-middle form of texts, cut at line boundaries found through a learned rank index.

The offsets of all boundaries of a text, by their number, are fitted by straight
segments whose error is bounded; what each boundary misses its segment by is
stored beside them in a byte. A cut at boundary k is predicted from its segment
and corrected by what is stored, which gives its exact offset.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import query, ship_package, table

MOST_MISSED = 120  # code points that a segment may miss a boundary by: what is left fits a signed byte


class RankIndex:
    """Offsets by rank: segments ``(first rank, offset there, slope)`` and what each rank misses its segment by."""

    __slots__ = ("firsts", "offsets", "slopes", "missed")

    def __init__(self, offsets: Iterable[int]):
        """Fit ``offsets``, which do not fall, from one segment to the next in a single pass.

        A segment starts at an exact offset. Every further offset narrows the slopes that keep all of the
        segment's offsets within the bound; one that leaves none starts the next segment.
        """
        self.firsts, self.offsets, self.slopes, self.missed = array("q"), array("q"), array("d"), array("b")
        start, base, low, high = 0, 0, 0.0, 0.0
        held: list[int] = []
        for rank, offset in enumerate(offsets):
            if held:
                run = rank - start
                least, most = (offset - MOST_MISSED - base) / run, (offset + MOST_MISSED - base) / run
                if least <= high and most >= low:
                    low, high = max(low, least), min(high, most)
                    held.append(offset)
                    continue
                self._close(start, held, (low + high) / 2)
            start, base, low, high = rank, offset, 0.0, float("inf")
            held = [offset]
        if held:
            self._close(start, held, (low + high) / 2 if len(held) > 1 else 0.0)

    def _close(self, start: int, held: list[int], slope: float) -> None:
        base = held[0]
        self.firsts.append(start)
        self.offsets.append(base)
        self.slopes.append(slope)
        self.missed.extend([offset - base - int(slope * i) for i, offset in enumerate(held)])

    def __len__(self) -> int:
        return len(self.missed)

    def predict(self, rank: int) -> int:
        """The offset that the rank's segment says, at most one more than the bound away."""
        k = bisect_right(self.firsts, rank) - 1
        return self.offsets[k] + int(self.slopes[k] * (rank - self.firsts[k]))

    def offset(self, rank: int) -> int:
        """The exact offset."""
        return self.predict(rank) + self.missed[rank]


def line_boundaries(text: str) -> RankIndex:
    """Index of the n + 1 boundaries of the n lines of a text; a line ends behind its line feed."""
    lines = text.split("\n")
    last = lines.pop()
    ends = accumulate((len(line) + 1 for line in lines), initial=0)
    return RankIndex([*ends, len(text)] if last else ends)


def _borders(one: str, other: str) -> bool:
    """Whether an end of ``one`` is a beginning of ``other``."""
    return any(one[-k:] == other[:k] for k in range(1, min(len(one), len(other))))


@dataclass(frozen=True)
class Fim:
    """Settings: a seed for the cuts, shares of texts (percent) that are rearranged and of those in suffix-first
    order, and the marks before prefix, suffix and middle. Marks may not overlap each other, so that a text that
    holds none of them is found again between them."""

    seed: int = 7
    rate: int = 100
    spm_rate: int = 50
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")
    finder: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        if not all(self.marks) or len(set(self.marks)) < 3 or any(
                _borders(a, b) or a != b and a in b for a in self.marks for b in self.marks):
            raise ValueError("the marks have to be three texts, none of which overlaps another")
        object.__setattr__(self, "finder", re.compile("|".join(map(re.escape, self.marks))))

    def draws(self, doc_id: int | None) -> list[int]:
        """Four numbers of 32 bits from the seed and the id; no id draws as an empty one."""
        drawn = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        return [int.from_bytes(drawn[i:i + 4], "big") for i in range(0, 16, 4)]


def transform(doc_id: int | None, text: str, how: Fim) -> tuple[int, str, int | None, int | None, str]:
    """Number of lines, form, code points of prefix and middle (None if plain), and the output."""
    index = line_boundaries(text)
    n = len(index) - 1
    one, other, changed, first = how.draws(doc_id)
    if not text or changed % 100 >= how.rate or how.finder.search(text):
        return n, "plain", None, None, text
    cuts = sorted((one % (n + 1), other % (n + 1)))
    low, high = index.offset(cuts[0]), index.offset(cuts[1])
    before, after, middle = how.marks
    if first % 100 < how.spm_rate:
        form, output = "spm", "".join((after, text[high:], before, text[:low], middle, text[low:high]))
    else:
        form, output = "psm", "".join((before, text[:low], after, text[high:], middle, text[low:high]))
    return n, form, low, high - low, output


def restore(output: str, form: str, how: Fim) -> str:
    """The text that was rearranged to ``output``."""
    if form == "plain":
        return output
    before, after, middle = how.marks
    if form not in ("psm", "spm"):
        raise ValueError(f"no such form: {form}")
    start, turn = (before, after) if form == "psm" else (after, before)
    one, two = output.find(turn), output.rfind(middle)
    if not output.startswith(start) or not len(start) <= one < two:
        raise ValueError("the marks are not where this form has them")
    first, second, rest = output[len(start):one], output[one + len(turn):two], output[two + len(middle):]
    return first + rest + second if form == "psm" else second + rest + first


_FORMS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()), T.StructField("restored", T.StringType()),
])
_FORMS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                          ("middle_chars", pa.int64()), ("output", pa.string()), ("restored", pa.string())])


def _forms(how: Fim):
    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                made = transform(doc_id, text, how)
                rows.append((doc_id, *made, restore(made[-1], made[1], how)))
                size += len(text)
                if size > 4_000_000:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)
    return run


def _batch(rows):
    columns = list(zip(*rows)) if rows else [[]] * len(_FORMS_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FORMS_ARROW.types)], schema=_FORMS_ARROW)


def fill_in_middle(docs: DataFrame, how: Fim = Fim()) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output, restored`` for each row of ``docs (doc_id, text)``.

    A text is cut twice at boundaries of its ``n`` lines, drawn from the seed and the id, and written with
    marks as prefix, suffix, middle (psm) or suffix, prefix, middle (spm). ``restored`` is the text made again
    from the output and the form alone. A text is plain, its output the text itself, if it is empty, holds a
    mark, or was not drawn; its counts of code points are null.

    Null texts are empty. A null ``doc_id`` stays null and draws as the empty id. Rows that repeat an id and a
    text give equal rows, no rows give none, and other columns are not read. Nothing is shuffled.
    """
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_forms(how), _FORMS)


@query("op11_fill_middle")
def op11_fill_middle(spark, sf_dir):
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))
