"""The operators over documents against plain versions, and on awkward rows."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tillcast.llm import QUERIES, bpe, components, decontaminate, jaccard, pii, quality, records, secret_scan, textnum, token_counts, toxicity
from tillcast.llm.html_text import extract_text, main_text
from tillcast.session import new_path

os.environ["TOKENIZERS_PARALLELISM"] = "false"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PIECE = public_tokenizers.path("piece_bpe_32k.model")


def docs(spark, texts, **more):
    """Documents 0, 1, ... with columns whose names the operators use inside."""
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    out = spark.createDataFrame(rows, DOCS)
    for name in ("id", "label", "digest", "n", "row", "key", "tokens", "score", "words", "hits", "_gone", "_GONE_", "_id", "_at", "_digest",
                 "_low", "_high", "_row", "tie", "count", "component_id"):
        out = out.withColumn(name, F.lit(1))
    return out


def awkward():
    """Null, empty, blank, long, repeated and odd texts."""
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    base = " ".join(rng.choice(vocabulary) for _ in range(60))
    near = [" ".join(w if rng.random() > 0.02 else "x%d" % rng.randrange(10**6) for w in base.split()) for _ in range(40)]
    return [None, "", " \t\n", "a", "One two three", "one two THREE", "ünï cödé 中文 😀 text", long, long + " tail", base, base, base.upper(),
            *near, "x" * 5000, "<|endoftext|> a<|endoftext|>b", "a\x00b\x1cc\xa0d  e\r\nf", "token = 'abcdefgh12' password: x"]


@pytest.fixture(scope="module")
def mixed(spark):
    return docs(spark, awkward()).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, ["a"]).where("doc_id < 0")


@pytest.fixture(scope="module")
def tables(spark, small):
    return lambda name: spark.read.parquet(f"{small}/{name}.parquet").collect()


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def plain_components(rows):
    sets = {}
    for doc_id, text in rows:
        w = re.findall("[^\x20\x09-\x0D]+", lowered(text))
        sets[doc_id] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    parent = {d: d for d in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    overlap = defaultdict(int)
    for held in holders.values():
        for i, a in enumerate(held):
            for b in held[i + 1:]:
                overlap[a, b] += 1
    for (a, b), n in overlap.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {(d, len(s), find(d)) for d, s in sets.items()}


def components_of(df):
    return {tuple(r) for r in jaccard.jaccard_components(df).collect()}


def test_jaccard_components_equal_all_pairs(spark, mixed, tables):
    texts = [(i, t) for i, t in enumerate(awkward())]
    assert components_of(mixed) == plain_components(texts)
    assert {tuple(r) for r in QUERIES["op2_jaccard"](spark, "/root/testdata/sf0.001").collect()} == plain_components(
        [(r.doc_id, r.text) for r in tables("documents")])


def test_jaccard_splits_groups_into_tiles(spark, monkeypatch):
    """Chains and large groups give the same classes whatever the size of a tile."""
    rng = random.Random(5)
    words = [f"v{i}" for i in range(90)]
    texts = []
    for step in range(60):
        for _ in range(2):
            changed = list(words)
            for _ in range(rng.randrange(3)):
                changed[rng.randrange(90)] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(changed))
        if step % 6 == 0:
            words[rng.randrange(90)] = f"m{step}"
    df, want = docs(spark, texts), plain_components(list(enumerate(texts)))
    assert 1 < len({c for _, _, c in want}) < len(texts)
    assert components_of(df) == want
    monkeypatch.setattr(jaccard, "TILE", 400)
    assert components_of(df.repartition(7)) == want


def test_jaccard_rows_without_or_with_repeated_ids(spark, empty):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(None, text), (7, text), (7, text), (9, text), (9, "other words here"), (3, "other words here")],
                               "doc_id long, text string")
    got = sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=str)
    assert got == sorted([(None, 16, None), (7, 16, 3), (7, 16, 3), (9, 16, 3), (9, 1, 3), (3, 1, 3)], key=str)
    assert components_of(empty) == set() and jaccard.one_of_each(empty).count() == 0
    kept = [r.doc_id for r in jaccard.one_of_each(df).collect()]
    assert sorted(kept, key=str) == [3, None]


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(500, 400), (400, 400), (None, 3)], "a long, b long"))
    got = {r.id: r.label for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 400: 400, 500: 400}


def test_words_do_not_depend_on_the_batch():
    import pyarrow as pa
    texts = pa.array(["ab  c\td", "", None, "x" * 3_000_000 + " ab", "é c"])
    data, offsets = textnum.text_bytes(texts)
    found = textnum.words(data, offsets, textnum.SPACED, lower=True)
    assert found.count().tolist() == [3, 0, 0, 2, 2]
    again = textnum.words(*textnum.text_bytes(texts[3:]), textnum.SPACED, lower=True)
    assert (again.hashes == found.hashes[3:]).all() and found.hashes[0] == found.hashes[4]


WORD_RUN = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(documents, items):
    windows = defaultdict(set)
    for item, text in items:
        w = WORD_RUN.findall(lowered(text))
        for i in range(max(len(w) - 10, 0) + 1 if w else 0):
            windows[tuple(w[i:i + 10])].update([] if item is None else [str(item)])  # searched, but not listed
    out = []
    for doc_id, text in documents:
        w, hit, found = WORD_RUN.findall(lowered(text)), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in windows:
                    found |= windows[tuple(w[i:i + size])]
                    hit.update(range(i, i + size))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination_equals_a_search(spark, mixed, empty, tables):
    got = sorted(map(tuple, QUERIES["op6_decontaminate"](spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == plain_hits([(r.doc_id, r.text) for r in tables("documents")], [(r.item_id, r.text) for r in tables("benchmark")])
    assert any(r[-1] for r in got)
    items = [(1, "w1"), (10, "One; TWO, three!"), (2, None), (3, ""), (None, "w2"), (None, "w2 w3"), (1, "ünï cödé"), (5, awkward()[9]), (6, awkward()[9])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.benchmark_hits(mixed, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), F.col("n_hit") > 0)
    want = plain_hits(enumerate(awkward()), items)
    assert sorted(map(tuple, found.collect()), key=str) == want
    clean = decontaminate.without_benchmark(mixed, benchmark)
    assert clean.columns == mixed.columns and {r.doc_id for r in clean.collect()} == {w[0] for w in want if not w[-1]}
    assert decontaminate.benchmark_hits(empty, benchmark).count() == 0
    assert decontaminate.without_benchmark(mixed, benchmark.limit(0)).count() == mixed.count()


def test_decontamination_counts_items_without_id(spark):
    df = docs(spark, ["a one two three b", "one two", "four five"])
    benchmark = spark.createDataFrame([(None, "one two three"), (7, "four five")], "item_id long, text string")
    got = decontaminate.benchmark_hits(df, benchmark).select("n_hit", "items").collect()
    assert sorted(map(tuple, got)) == [(0, []), (2, ["7"]), (3, [])]
    assert [r.text for r in decontaminate.without_benchmark(df, benchmark).collect()] == ["one two"]


def test_token_counts_encode_each_text_once(spark, mixed, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    cache = new_path(spark, "counts")
    want = sorted((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in enumerate(awkward()))
    for _ in range(2):
        assert sorted(map(tuple, token_counts.count_tokens(mixed, PIECE, cache).collect())) == want
        assert spark.read.parquet(cache).count() == len({t or "" for t in awkward()})
    token_counts.count_tokens(mixed, WORD, cache).collect()
    assert spark.read.parquet(cache).select("version").distinct().count() == 2
    assert token_counts.count_tokens(empty, PIECE, cache).count() == 0
    grown = mixed.select("doc_id", "text").union(spark.createDataFrame([(None, "brand new")], "doc_id long, text string"))
    assert token_counts.count_tokens(grown, PIECE, cache).where("doc_id is null").first().n_tokens == len(model.encode("brand new"))


def test_secrets_equal_plain_patterns_and_confirm_structure(spark, mixed, empty):
    import base64
    octets = lambda tag, body: bytes([tag, 0x82]) + len(body).to_bytes(2, "big") + body
    key = octets(0x30, b"\x02\x01\x00" + octets(0x30, b"\x06\x03abc") + octets(0x04, b"k" * 60))
    text = base64.b64encode(key).decode()
    token = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.c2ln"
    spans = secret_scan.secret_spans
    assert [s[2] for s in spans(f"x {text} y {key.hex()} z {token}")] == ["der", "hex", "der", "token"]
    assert [s[2] for s in spans(f"-----BEGIN PRIVATE KEY-----\n{text}\n-----END PRIVATE KEY-----")] == ["pem"]
    broken = base64.b64encode(key[:-1]).decode()
    assert spans(f"{broken} eyJub3QiOiJhIn0.eyJzdWIiOiIxIn0.c2ln -----BEGIN PRIVATE KEY-----\n{broken}\n-----END PRIVATE KEY-----") == []
    assert spans("PassWord='12345678' token=short AKIA0123456789AB AKIA1 ſecret=abcdefgh") == [
        (0, 18, "assign"), (32, 48, "access")]
    assert secret_scan.masked_text("a token=abcdefgh b", spans("a token=abcdefgh b")) == "a [SECRET] b"
    rows = {r.doc_id: r for r in secret_scan.scan_secrets(mixed, with_text=True).collect()}
    assert len(rows) == len(awkward()) and rows[len(awkward()) - 1].n_assign == 1 and rows[0].spans == ""
    masked = secret_scan.mask_secrets(mixed)
    assert masked.columns == mixed.columns and masked.where("text is null").count() == 1
    assert secret_scan.scan_secrets(empty).count() == secret_scan.mask_secrets(empty).count() == 0


def test_secrets_are_found_in_escaped_wrapped_and_nested_forms():
    import base64
    import json
    octets = lambda tag, body: bytes([tag, 0x82]) + len(body).to_bytes(2, "big") + body
    key = octets(0x30, b"\x02\x01\x00" + octets(0x30, b"\x06\x03abc") + octets(0x04, bytes(range(256)) * 4))
    string = lambda body: len(body).to_bytes(4, "big") + body
    ssh = b"openssh-key-v1\0" + string(b"none") * 2 + string(b"") + (1).to_bytes(4, "big") + string(b"p" * 51) + string(b"k" * 145)
    wrap = lambda data, n=64: "\n".join(re.findall(f".{{1,{n}}}", base64.b64encode(data).decode()))
    block = lambda body, label="PRIVATE KEY": f"-----BEGIN {label}-----\n{body}\n-----END {label}-----"
    pem = block(wrap(key))
    encrypted = block("Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n" + wrap(bytes(range(256)) * 2), "RSA PRIVATE KEY")
    for secret, kind in [
            (pem, "pem"), (json.dumps(pem)[1:-1], "pem"), (json.dumps(pem + "\n")[1:-3].replace("/", "\\/").replace("=", "\\u003d"), "pem"),
            (pem.replace("\n", "\\\\n"), "pem"), (pem.replace("\n", "\\r\\n"), "pem"), (encrypted, "pem"), (encrypted.replace("\n", "\\n"), "pem"),
            (block(wrap(ssh), "OPENSSH PRIVATE KEY").replace("\n", "\\n"), "pem"), (wrap(key), "der"), (wrap(key, 76).replace("\n", "\r\n"), "der"),
            (wrap(key).replace("\n", "\\n"), "der"), (wrap(key).replace("\n", "\n    "), "der"), (wrap(ssh, 70), "der"),
            (base64.b64encode(pem.encode()).decode(), "pem"), (wrap(pem.encode() + b"\n", 76), "pem"), (wrap(encrypted.encode()), "pem")]:
        for before, after in (("", ""), ("é see ", " end"), ("words\n", "\nnext words"), ('{"k": "', '"}')):
            text = before + secret + after
            found = [s for s in secret_scan.confirmed_spans(text)]
            assert found == [(len(before), len(before) + len(secret), kind)], (secret[:60], before, found)
            assert secret_scan.masked_text(text, secret_scan.secret_spans(text)) == before + secret_scan.MASK + after
    for wrong in (block(wrap(key[:-1])), wrap(key[:-1]), block(wrap(key)[:-9]).replace("\n", "\\n"), wrap(block(wrap(key[:-1])).encode()),
                  "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n" + wrap(bytes(257)) + "\n-----END RSA PRIVATE KEY-----", wrap(b"0" * 900)):
        assert secret_scan.confirmed_spans(wrong) == [], wrong[:80]


def test_records_come_back_as_the_library_encodes(spark, mixed, empty):
    library = Tokenizer.from_file(WORD)
    want, start = [], 0
    for i, t in enumerate(awkward()):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    files = records.write_records(mixed, WORD, new_path(spark, "records"), 1)
    assert sorted(map(tuple, records.read_records(files).collect())) == want
    file = files.where("records > 1").first()
    whole = list(records.read_file(file.path))
    for n in (0, len(whole) - 1):
        doc_id, ids = records.read_record(file.path, n)
        assert doc_id == whole[n][0] and (ids == whole[n][1]).all()
    assert records.read_records(records.write_records(empty, WORD, new_path(spark, "records"), 1)).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (2, "b"), (2, "b")], "doc_id long, text string")
    got = [(r.doc_id, r.start) for r in records.read_records(records.write_records(nulls, WORD, new_path(spark, "records"), 1)).collect()]
    assert sorted(got, key=str) == [(2, 2), (2, 4), (None, 0)]


def test_damaged_records_are_refused():
    import io
    framed = bytearray(records.frame(records.pack(5, b"\x01\x00", 2)))
    assert records.unframe(io.BytesIO(framed)) is not None and records.unframe(io.BytesIO(b"")) is None
    for place in (3, len(framed) - 1, 15):
        broken = bytearray(framed)
        broken[place] ^= 1
        with pytest.raises(ValueError):
            records.unframe(io.BytesIO(broken))
    with pytest.raises(ValueError):
        records.unframe(io.BytesIO(framed[:-3]))


def odd_texts(n=1500):
    rng = random.Random(3)
    parts = list("ab cZ'sdt  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0　  é́ñß…😀Σσς中文١²Ⅷ_-<|>.,") + ["<|endoftext|>", "'s", "'ll", "<|startoftext|>", "İ", "\x00"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["a" * 3000, " " * 999, "<|endoftext|>" * 3]


def test_bpe_equals_the_library(spark, mixed, empty):
    library, own = Tokenizer.from_file(BYTE), bpe.Bpe(BYTE)
    for text in odd_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text
    assert own.decode([own.first[0xE4]]) == library.decode([own.first[0xE4]], skip_special_tokens=False) == "�"
    want = []
    for i, t in enumerate(awkward()):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert sorted(map(tuple, bpe.bpe_tokens(mixed, BYTE, with_ids=True).collect())) == want
    assert bpe.bpe_tokens(empty, BYTE).count() == 0


def test_chunks_encode_as_whole_texts(monkeypatch):
    library, own = Tokenizer.from_file(WORD), records.ChunkEncoder(WORD)
    monkeypatch.setattr(records, "CHUNKS_AT_ONCE", 7)
    monkeypatch.setattr(records, "CHUNKS_KEPT", 50)
    for text in odd_texts(400):
        assert np.frombuffer(own.encode(text.encode()), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_quality_counts_equal_plain_ones(spark, mixed, empty, tables):
    rows = [(r.doc_id, r.text) for r in tables("documents")] + [(10**6 + i, t) for i, t in enumerate(awkward())]
    rows += [(2 * 10**6, " ".join("abcdefgh") + " " + " ".join("abcdefghabcdefgh")), (2 * 10**6 + 1, "a b\n\na b\n \na b c\n")]
    df = spark.createDataFrame([(d, t, None if d % 5 == 0 else "en") for d, t in rows], "doc_id long, text string, lang string")
    want = set()
    for d, t in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
        spots = defaultdict(list)
        for i in range(len(w) - 7):
            spots[tuple(w[i:i + 8])].append(i)
        again = {j for s in spots.values() if len(s) > 1 for i in s for j in range(i, i + 8)}
        want.add((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again),
                  len(w) < 20 or 100 * len(again) > 30 * len(w)))
    out = quality.quality_rules(df)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert {tuple(r) for r in out.select(*names).collect()} == want
    assert out.where("kept is null or (kept and base_failed)").isEmpty()
    assert quality.quality_rules(empty).count() == 0 and quality.quality_rules(mixed).count() == len(awkward())
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_js_distance_is_zero_to_one(spark):
    df = spark.createDataFrame([([1, 1], [5, 5]), ([1, 0], [0, 3]), ([0, 0], [1, 2]), ([1, 3], [3, 1])], "p array<long>, q array<long>")
    got = [r[0] for r in df.select(quality.js_distance(F.col("p"), F.col("q"))).collect()]
    half = lambda p, m: p * np.log2(p / m)
    assert got == pytest.approx([0, 1, 0, np.sqrt(half(0.25, 0.5) + half(0.75, 0.5))])


def test_toxicity_learns_stems_from_labels_it_may_see(spark, empty):
    rng = random.Random(2)
    plain = [f"{a}{b}" for a in ("ta", "lo", "mi", "ren", "so") for b in ("ka", "lim", "tor", "ne", "vu", "sa", "pe")]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = "grobl" + rng.choice(plain)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame(rows + [(5000, None), (5001, ""), (None, "grobltaka " * 9)], "doc_id long, text string").withColumn("score", F.lit(0))
    marks = spark.createDataFrame(labels + [(None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(df, marks)
    held = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1}
    flipped = marks.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert (toxicity.train_toxicity(df, flipped).weights == model.weights).all()
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(df, model).collect()}
    truth = dict(labels)
    right = sum((scores[i] >= 0.7) == bool(truth[i]) for i in held)
    assert right >= 0.97 * len(held) and scores[None] > 0.7 and scores[5000] == scores[5001] and 0 <= scores[5000] < 0.7
    assert {r.doc_id for r in toxicity.without_toxic(df, model).collect()} == {i for i, s in scores.items() if s < 0.7}
    assert toxicity.toxicity_scores(empty, model).count() == 0
    assert toxicity.train_toxicity(df, marks.where("toxic = 0")).scores(["grobl"])[0] < 0.01


def test_toxicity_fills_its_sample_from_usable_texts(spark, monkeypatch):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    marks = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "x" * 200 if i % 5 == 1 else f"word{i}") for i in ids if i % 5 < 4], "doc_id long, text string")
    taken = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, how: taken.append((sorted(texts), int(labels.sum()))))
    usable = [i for i in ids if i % 5 in (2, 3)]
    toxicity.train_toxicity(df, marks, toxicity.Training(most_toxic=30, most_clean=35, most_chars=100))
    toxicity.train_toxicity(df, marks, toxicity.Training(most_chars=100))
    assert len(taken[0][0]) == 65 and taken[0][1] == 30 and taken[1][0] == sorted(f"word{i}" for i in usable)
    with pytest.raises(ValueError, match="label 0"):
        toxicity.train_toxicity(df.withColumn("text", F.expr("if(doc_id % 2 = 0, text, null)")), marks)
    with pytest.warns(UserWarning, match="label 0"):
        toxicity.train_toxicity(df.where("doc_id % 2 = 0"), marks)


def test_toxicity_scores_long_texts_in_pieces(monkeypatch):
    model = toxicity.Model(np.random.default_rng(1).normal(size=2**12), 0.1, 5)
    texts = ["ab cde  fg " * 50, "", "x", "nospace" * 40]
    want = model.scores(texts)
    monkeypatch.setattr(toxicity, "PIECE", 30)
    assert model.scores(texts) == pytest.approx(want)


def test_pages_keep_the_article_only(spark):
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
      <header><h1>Site, no, no</h1></header><nav><ul><li><a href=1>no</a></li></ul></nav><div class="ad">No, no, no.</div>
      <div id="cookie-notice"><p>No, no cookies, please.</p></div><article><h1>Title &amp; more</h1><p>First <b>bold</b>,<br>line
      &eacute;&#233;<p>Second, with <a href=x>a link</a>.</p><ul><li>one<li>two</ul><aside>no, no</aside></article>
      <form><p>no, no</p></form><section class="comments"><p>no, said a reader, no, not at all, no</p></section><footer>no</footer>"""
    assert main_text(page) == "Title & more\nFirst bold, line éé\nSecond, with a link.\none\ntwo"
    assert main_text("<div><div class=sidebar>x, y</div><p>Hello, world&nbsp;!<p>Next</div>") == "Hello, world !\nNext"
    assert [main_text(p) for p in (None, "", "<p></p>", "<nav>x</nav>", "bare text", "a < b <b")] == ["", "", "", "", "bare text", "a < b"]
    assert main_text("<div>" * 5000 + "deep, text" + "</div>" * 5000) == "deep, text"
    df = spark.createDataFrame([(1, "u", page), (None, None, None), (1, "u", page)], "page_id long, url string, html string").withColumn("text", F.lit(0))
    got = sorted(map(tuple, extract_text(df).collect()), key=str)
    assert [g[3] for g in got] == [len(main_text(page))] * 2 + [0] and extract_text(df.limit(0)).count() == 0


def test_names_and_forms_do_not_cut_articles():
    prose = "<p>Some words, of the article, that say something.</p>" * 4
    text = "\n".join(["Some words, of the article, that say something."] * 4)
    for outer in ('div class="layout has-sidebar"', 'div class="post no-sidebar"', 'div class="layout--with-sidebar"', "div class=widget",
                  'div class="elementor-widget"', 'form action="/"', "div id=sidebar"):
        tag = outer.split()[0]
        assert main_text(f"<body><{outer}><article>{prose}</article></{tag}></body>") == text, outer
        assert main_text(f"<body><{outer}>{prose}</{tag}></body>") == text, outer
        assert main_text(f"<body><{outer}><article>{prose}</article><div class=sidebar>no, no</div></{tag}><div id=comments>no</div></body>") == text
    assert main_text(f"<div class=comments><p>no, no</p></div><article class=widget>{prose}</article>") == text
    slugs = '<h2 id="header-2">A</h2><section id="related-work"><h2 class="header">B</h2><p>b.</p></section><section id="header-3">c.</section>'
    slugs += '<section id="social-policy"><h2>D</h2><p>d.</p></section><div class="related-posts"><p>no</p></div>'
    assert main_text(f"<body><article>{prose}{slugs}</article></body>") == text + "\nA\nB\nb.\nc.\nD\nd."
    parts = "".join(f"<div class=widget><p>Part {i}, of three.</p></div>" for i in range(3))  # none holds most of the text
    assert main_text(f"<body>{parts}</body>").startswith("Part 0, of three.")
    comments = "<div class=comment><p>no, no, no, said a reader, no, not at all, no, and went on</p></div>" * 20
    assert main_text(f"<body><div>{prose}</div><div id=comments>{comments}</div></body>") == text


def test_pages_without_article_keep_all_sections():
    prose = "<p>Some words, of the article, that say something, at some length, and more.</p>" * 5
    text = "\n".join(["Some words, of the article, that say something, at some length, and more."] * 5)
    menu = "<div><a href=1>no</a> <a href=2>no, not</a></div>"
    last = "<h2>Last</h2><p>short, last section.</p>"
    want = text + "\nLast\nshort, last section."
    assert main_text(f"<div id=c><div>{prose}</div><div>{last}</div></div>") == want
    assert main_text(f"<body>{menu}<div id=c><div><div>{prose}</div></div><div><div>{last}</div></div></div>{menu}</body>") == want
    assert main_text(f"<body>{menu}<div><div>{prose}</div></div><div><div>{last}</div></div></body>") == want
    assert main_text(f"<body>Lead <b>text</b>, bare.<div>{prose}</div>{menu}and bare <a href=x>end</a> as well</body>") == \
        f"Lead text, bare.\n{text}\nand bare end as well"
    assert main_text(f"<body><a href=1>no</a> <a href=2>no</a> | <div><h1><a href=3>Title</a></h1><div>{prose}</div></div></body>") == "|\nTitle\n" + text
    linked = "<div><ul>" + "<li><a href=1>no, no, no, no and no again</a>" * 60 + f"</ul><div>{prose}</div><div>{last}</div></div>"
    assert main_text(f"<body>{linked}</body>") == want


def test_pseudonyms_permute_within_formats(spark, mixed, empty):
    key = b"k" * 32
    for size in (1, 2, 7, 97, 1000):
        assert sorted(pii.permute(i, size, key, "t") for i in range(size)) == list(range(size))
        assert all(pii.permute(pii.permute(i, size, key, "t"), size, key, "t", back=True) == i for i in range(size))
    text = ("+1 (017) 555-7713, 4111 1111 1111 1111 GB82 WEST 1234 5698 7654 32 97.51.17.173 1987-02-28 31/12/1999 12/31/1999 "
            "123-45-6789 und.34@mail7.example.com")
    new, counts = pii.pseudonymise(text, key)
    assert counts == {"email": 1, "iban": 1, "ip": 1, "date": 3, "ssn": 1, "phone": 1, "card": 1}
    shape = lambda s: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "0", s)))
    without_ip = lambda s: re.sub(r"0+\.0+\.0+\.0+", "", shape(s))
    assert without_ip(new) == without_ip(text) and new != text
    assert pii.pseudonymise(new, key, back=True)[0] == text and pii.pseudonymise(text, b"other" * 4)[0] != new
    wrong = "4111 1111 1111 1112 GB83 WEST 1234 5698 7654 32 1987-02-30 1987-13-01 000-12-3456 300.1.1.1"
    assert pii.pseudonymise(wrong, key)[0] == wrong
    rows = {r.doc_id: r for r in pii.pseudonymise_documents(mixed, key).collect()}
    assert len(rows) == len(awkward()) and rows[0].text is None and rows[1].text == ""
    assert pii.pseudonymise_documents(empty, key).count() == 0


def test_pseudonyms_are_found_before_other_numbers_and_words():
    key = b"k" * 32
    for kind, value, after in [
            ("card", "4111 1111 1111 1111", ["", " 12/27", " 123", " 12/27 123", "-123", " 1234 5678", " EUR"]), ("card", "4111111111111111", [" 123", " 12/27", ", 1"]),
            ("card", "378282246310005", [" 1234", " 12/27"]), ("card", "3782 822463 10005", [" 1234", " 12/27"]),
            ("iban", "AT61 1904 3002 3457 3201", ["", " EUR", " EUR 500", " PAID", " PAID IN FULL", " 500", " Paid"]),
            ("iban", "AT611904300234573201", [" PAID", " EUR", " 12"]), ("iban", "GB82 WEST 1234 5698 7654 32", [" EUR", " PAID"]),
            ("phone", "555-123-4567", ["", " 12", ", x", "."])]:
        alone = pii.pseudonymise(value, key)[0]
        assert alone != value
        for rest in after:
            new, counts = pii.pseudonymise(f"pay {value}{rest}", key)
            assert new == f"pay {alone}{rest}" and counts == dict.fromkeys(pii.KINDS, 0) | {kind: 1}, (value, rest, new)
            assert pii.pseudonymise(new, key, back=True)[0] == f"pay {value}{rest}"
    new, counts = pii.pseudonymise("99 4111 1111 1111 1111, 2020-13-01 1987-02-28, 555-123-4567@example.com", key)
    assert counts["card"] == counts["date"] == counts["email"] == 1 and counts["phone"] == 0 and new.startswith("99 ")


def test_pipeline_stages_keep_columns_and_clean_documents(spark, small):
    docs_ = spark.read.parquet(f"{small}/documents.parquet")
    names = docs_.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs_
        docs_ = corpus_pipeline.materialize(stage(spark, before, small))
        ids = {r.doc_id for r in docs_.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()} and docs_.columns == (names if name != "BPE encoding" else docs_.columns)
        if name == "n-gram Jaccard join":
            assert ids == {c for _, _, c in plain_components([(r.doc_id, r.text) for r in before.collect()])}
        if name in ("secret scans", "BPE encoding"):
            assert ids == {r.doc_id for r in before.collect()}
        if name == "BPE encoding":
            library, texts = Tokenizer.from_file(BYTE), {r.doc_id: r.text for r in before.collect()}
            assert all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in docs_.collect())


@pytest.mark.parametrize("index", range(5))
def test_stages_take_awkward_and_no_rows(spark, small, index):
    stage = corpus_pipeline.STAGES[index][1]
    plain = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(awkward())] + [(None, None, None, None, None)], DOCS)
    out = stage(spark, plain.withColumn("ids", F.lit(1)), small)
    assert out.count() > 0 and (index == 4 or out.columns == [*plain.columns, "ids"])
    assert stage(spark, plain.limit(0), small).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_whole(spark, small, name):
    table = "pages" if name.startswith("op3") else "documents"
    rows = QUERIES[name](spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/{table}.parquet").count()
