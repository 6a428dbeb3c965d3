"""Fill-in-middle, alignment of tokenizers and line dedup against plain versions, and on awkward rows."""

import hashlib
import os
import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.compare import difference
from tests.llm.test_documents import BYTE, PIECE, awkward, docs, empty, mixed, odd_texts  # noqa: F401  (two are fixtures)
from tillcast.llm import CHECKS, QUERIES, fill_middle, line_dedup, token_alignment
from tillcast.llm.fill_middle import Fim, RankIndex, restore, transform

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PLAIN = Fim()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_fim(doc_id, text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    drawn = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(drawn[i:i + 8], 16) for i in (0, 8, 16, 24)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    parts = ["".join(units[:low]), "".join(units[low:high]), "".join(units[high:])]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(units), "spm", len(parts[0]), len(parts[1]), f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"
    return len(units), "psm", len(parts[0]), len(parts[1]), f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"


def test_rank_index_gives_exact_offsets_from_few_segments():
    rng = random.Random(4)
    for gaps in ([1] * 5000, [], [0] * 300, [rng.randint(1, 9) for _ in range(3000)], [rng.randint(1, 10**rng.randint(0, 5)) for _ in range(800)],
                 [1] * 400 + [10**6] + [2] * 400, [300, 1] * 200):
        offsets = np.cumsum([0, *gaps]).tolist()
        index = RankIndex(offsets)
        assert len(index) == len(offsets) and [index.offset(k) for k in range(len(index))] == offsets
        assert max(abs(index.predict(k) - o) for k, o in enumerate(offsets)) <= fill_middle.MOST_MISSED + 1
    assert len(RankIndex(range(10**5)).firsts) == 1 and len(RankIndex(np.cumsum([rng.randint(30, 60) for _ in range(2000)]).tolist()).firsts) < 200
    assert len(RankIndex([])) == 0


def test_middle_is_cut_as_in_a_plain_version():
    rng = random.Random(6)
    texts = [t or "" for t in awkward()] + odd_texts(300) + ["\n" * 50, "a\nb", "a\nb\n", "<\nP>\nS>\n", "x<P>y\n", "<\n<\n<\n", "P>\n<S\n<"]
    texts += ["".join(rng.choice(["é\n", "\n", "zwei drei\n", "<", "M>", "x"]) for _ in range(rng.randint(0, 90))) for _ in range(200)]
    for i, text in enumerate(texts):
        for doc_id in (i, i + 10**9, -i, None):
            made = transform(doc_id, text, PLAIN)
            assert made == plain_fim(doc_id, text) and restore(made[-1], made[1], PLAIN) == text
    forms = Counter(transform(i, "a\nb\nc\n", Fim(rate=40, spm_rate=25))[1] for i in range(4000))
    assert abs(forms["plain"] - 2400) < 150 and abs(forms["spm"] - 400) < 80
    assert {transform(i, "a\nb\n", Fim(spm_rate=0))[1] for i in range(50)} == {"psm"}
    other = Fim(marks=("[pre]", "[suf]", "[mid]"))
    assert restore(transform(5, "a\n<P>\nb", other)[-1], transform(5, "a\n<P>\nb", other)[1], other) == "a\n<P>\nb"
    for marks in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "bc", "x"), ("aa", "b", "c"), ("<P>", "P", "<M>")):
        with pytest.raises(ValueError, match="marks"):
            Fim(marks=marks)
    with pytest.raises(ValueError, match="marks"):
        restore("<P>a<M>b", "psm", PLAIN)


def test_middle_on_awkward_rows_and_against_sql(spark, mixed, empty, small, con):  # noqa: F811
    rows = {r.doc_id: tuple(r)[1:] for r in fill_middle.fill_in_middle(mixed).collect()}
    assert rows == {i: (*plain_fim(i, t or ""), t or "") for i, t in enumerate(awkward())}
    assert fill_middle.fill_in_middle(empty).count() == 0
    twice = spark.createDataFrame([(None, "a\nb"), (3, "a\nb"), (3, "a\nb"), (None, None)], "doc_id long, text string").withColumn("form", F.lit(1))
    got = sorted(((r.doc_id, r.output) for r in fill_middle.fill_in_middle(twice).collect()), key=str)
    assert got == sorted([(None, plain_fim(None, "a\nb")[-1]), *[(3, plain_fim(3, "a\nb")[-1])] * 2, (None, "")], key=str)
    assert difference(QUERIES["op11_fill_middle"](spark, small), con, CHECKS["op11_fill_middle"]) is None


def plain_alignment(rows):
    """By the libraries, sets of ends and a table of all links."""
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    sides = token_alignment.sides(BYTE, PIECE)
    out, links, corpus = [], {}, Counter()
    for k, (doc_id, text) in enumerate(rows):
        whole = b" " + (text or "").encode()
        ids = [a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")] if text else [[], []]
        if not text or any(b"".join(s.strings[i] for i in x) != whole for s, x in zip(sides, ids)):
            out.append((doc_id, 0, 0, 0, 0, ""))
            links[k] = []
            continue
        ends = [np.cumsum([len(s.strings[i]) for i in x]).tolist() for s, x in zip(sides, ids)]
        common = sorted(set(ends[0]) & set(ends[1]))
        parts = [[[], []] for _ in common]
        for side, (x, es) in enumerate(zip(ids, ends)):
            for i, e in zip(x, es):
                parts[bisect_left(common, e)][side].append(str(i))
        parts = ["|".join(map(",".join, part)) for part in parts]
        at = [dict(zip(es, x)) for x, es in zip(ids, ends)]
        links[k] = [(at[0][e], at[1][e]) for e in common]
        corpus.update(links[k])
        out.append((doc_id, len(ids[0]), len(ids[1]), len(common), len(common), sha(";".join(parts))))
    most = defaultdict(int)
    for (_, y), n in corpus.items():
        most[y] = max(most[y], n)
    return sorted(((*row[:5], sum(corpus[x] == most[x[1]] for x in links[k]), sum(corpus[x] for x in links[k]), row[5])
                   for k, row in enumerate(out)), key=str)


def aligned(df):
    return sorted(map(tuple, token_alignment.align_tokenizers(df, BYTE, PIECE).collect()), key=str)


def test_alignment_equals_the_libraries(spark, mixed, empty):  # noqa: F811
    texts = [t if t is None or len(t) < 9000 else t[:9000] for t in awkward()] + odd_texts(250) + ["a▁b", "▁", " ", "  x", "\n", "中文字", "don't stop", "x\x00y"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "one two three"), (5, "one two three"), (5, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pairs", F.lit(1)).withColumn("n_best", F.lit("x"))
    want = plain_alignment(rows)
    assert aligned(df.repartition(6)) == want
    zero = {r[0]: r for r in want}
    assert all(zero[i][1:] == (0, 0, 0, 0, 0, 0, "") for i, t in rows if i is not None and (not t or "▁" in t))
    assert aligned(mixed) == plain_alignment(enumerate(awkward()))
    assert aligned(empty) == [] and aligned(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")) == [
        (1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_alignment_query_equals_the_libraries(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op12_token_alignment"](spark, small).collect()), key=str) == plain_alignment(rows)


def test_groups_close_where_both_ends_meet():
    rng = random.Random(8)
    for _ in range(400):
        size = rng.randint(1, 120)
        a = sorted({size, *(rng.randrange(1, size + 1) for _ in range(rng.randint(0, size)))})
        b = sorted({size, *(a if rng.random() < 0.5 else ()), *(rng.randrange(1, size + 1) for _ in range(rng.randint(0, 6)))})
        cuts_a, cuts_b = token_alignment.groups(a, b)
        assert [a[i - 1] for i in cuts_a] == [b[j - 1] for j in cuts_b] == sorted(set(a) & set(b))
    many = list(range(1, 10**6))
    assert token_alignment.groups(many, many)[0].tolist() == many


def test_links_are_bounded_by_the_vocabularies(spark, mixed):  # noqa: F811
    a, b = token_alignment.sides(BYTE, PIECE)
    assert token_alignment.possible_links(a, b) == 324_297
    counts = token_alignment.link_counts(token_alignment.aligned_tokens(mixed, BYTE, PIECE))
    for r in counts.collect():
        x, y = a.strings[r.pair >> 32], b.strings[r.pair & (2**32 - 1)]
        assert x.endswith(y) or y.endswith(x)
    with pytest.raises(ValueError, match="byte-level"):
        token_alignment.byte_level_side(public_tokenizers.path("word_bpe_49k.json"))


def plain_line_dedup(rows):
    space = "\x20\t\n\x0b\x0c\r"

    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(space))
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= 20:
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or len(holders[key(x)]) < 3 or doc_id == max(holders[key(x)])]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(9)
    shared = [f"A shared Line, number {i}, of some length" for i in range(12)] + ["Ünïcödé lines cöunt ", "ÄÖÜ zeile, zwanzig!", "x" * 20, "y" * 19]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = rng.choice(shared) if rng.random() < 0.6 else f"own line {i} {rng.random()} that is long"
            line = line.upper() if rng.random() < 0.2 else line
            lines.append(rng.choice(["", " ", "\t", "\r", "\x0b"]) + line + rng.choice(["", "  ", "\r", "\x0c", "\xa0"]))
        rows.append((rng.choice([i, i, i % 7, None]), "\n".join(lines) + rng.choice(["", "\n", "\n\n"])))
    hot = [(1000 + i, f"the one very common line of all\nown {i} and nothing else here\nthe one very common line of all") for i in range(90)]
    return rows + hot + [(5000 + i, t) for i, t in enumerate(awkward())]


@pytest.mark.parametrize("hot", [1, 30, 10_000])
def test_lines_are_dropped_as_in_a_plain_version(spark, empty, pieces, monkeypatch, hot):  # noqa: F811
    monkeypatch.setattr(line_dedup, "HOT_KEYS", hot)
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("key", "keys", "_of", "last", "n_docs", "n_lines"):
        df = df.withColumn(name, F.lit(1))
    got = sorted(map(tuple, line_dedup.dedup_lines(df.repartition(7)).collect()), key=str)
    assert got == plain_line_dedup(rows) and any(r[3] for r in got)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_lines_against_sql_and_with_other_bounds(spark, small, con):
    assert difference(QUERIES["op13_line_dedup"](spark, small), con, CHECKS["op13_line_dedup"]) is None
    df = spark.createDataFrame([(1, "ab\ncd"), (2, "AB\nx"), (3, " ab")], "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.dedup_lines(df, 2, 2).collect())) == [(1, "cd", 2, 1), (2, "x", 2, 1), (3, " ab", 1, 0)]
    assert sorted(map(tuple, line_dedup.dedup_lines(df, 4, 1).collect())) == [(1, "ab\ncd", 2, 0), (2, "AB\nx", 2, 0), (3, " ab", 1, 0)]
