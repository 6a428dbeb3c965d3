"""Secrets in texts: patterns, and encoded keys and tokens confirmed by their structure."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, query, ship_package, table

MASK = "[SECRET]"

# The kinds in their order and the patterns of the base kinds.
KINDS = ("assign", "access", "hex", "pem", "der", "token")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so this is [0-9a-f]+ of 32 or more

PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
# The end of a line, also written as an escape of JSON, an env file or source code.
LINE_END = r"[\x20\t]*(?:\\?\r?\n|\r|(?:\\+r)?\\+n)[\x20\t]*"
WRAPPED = re.compile(rf"[A-Za-z0-9+/]{{16,}}(?:{LINE_END}[A-Za-z0-9+/]+)*={{0,2}}")
HEX_KEY = re.compile(r"30[0-9A-Fa-f]{62,}")
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")

_INTEGER, _OCTETS, _OBJECT, _SEQUENCE = 0x02, 0x04, 0x06, 0x30
_OPENSSH = b"openssh-key-v1\x00"
_LINE_END = re.compile(LINE_END)
_ESCAPES = ((re.compile(r"\\+(?:r\\+n|[rnt]|u000[aAdD9])|\\\r?\n"), "\n"), (re.compile(r"\\+u003[dD]"), "="),
            (re.compile(r"\\+u002[bB]"), "+"), (re.compile(r"\\+/"), "/"))
_PEM_HEADER = re.compile(r"\s*([A-Za-z][A-Za-z0-9-]*)[\x20\t]*:([^\r\n]*)")
_ENCRYPTED = re.compile(r"4\s*,\s*ENCRYPTED")

Span = tuple[int, int, str]


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of the elements that fill ``data`` exactly, else None."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            size = int.from_bytes(data[at:at + width], "big")
            at += width
        if at + size > len(data):
            return None
        items.append((tag, data[at:at + size]))
        at += size
    return items


def is_private_key(data: bytes) -> bool:
    """Whether ``data`` is one whole private key: its tags and nested lengths all agree."""
    if data.startswith(_OPENSSH):
        return _key_size(data) == len(data)
    outer = der_items(data)
    if outer is None or len(outer) != 1 or outer[0][0] != _SEQUENCE:
        return False
    parts = der_items(outer[0][1])
    if not parts:
        return False
    tags = [tag for tag, _ in parts]
    if len(parts) >= 9 and all(t == _INTEGER for t in tags[:9]):
        return True  # RSA: version, modulus, exponents, primes and their inverses
    if tags[:3] == [_INTEGER, _SEQUENCE, _OCTETS] or tags[:2] == [_SEQUENCE, _OCTETS] and len(parts) == 2:
        algorithm = der_items(parts[tags.index(_SEQUENCE)][1])
        return bool(algorithm) and algorithm[0][0] == _OBJECT  # PKCS 8, plain or encrypted
    if tags[:2] == [_INTEGER, _OCTETS] and parts[0][1] == b"\x01":
        return True  # elliptic curve
    return len(parts) == 6 and all(t == _INTEGER for t in tags) and parts[0][1] == b"\x00"  # DSA


def _decoded(text: str) -> bytes | None:
    body = text.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def is_signed_token(header: str, claims: str) -> bool:
    """Whether the two parts are a token's: a JSON object that names its algorithm, and JSON or cipher text."""
    raw = _decoded(header.replace("-", "+").replace("_", "/"))
    try:
        head = json.loads(raw) if raw else None
    except ValueError:
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and _decoded(
        claims.replace("-", "+").replace("_", "/")) is not None


def base_spans(text: str) -> list[Span]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _is_pem_key(body: str) -> bool:
    """Whether the text between the marks of a PEM block is a private key, plain or encrypted by its header lines."""
    if "\\" in body:
        for pattern, character in _ESCAPES:
            body = pattern.sub(character, body)
    headers, at = {}, 0
    while m := _PEM_HEADER.match(body, at):
        headers[m[1].lower()] = m[2].strip()
        at = m.end()
    data = _decoded("".join(body[at:].split()))
    if not data:
        return False
    if _ENCRYPTED.fullmatch(headers.get("proc-type", "")) and headers.get("dek-info"):
        return len(data) % 8 == 0  # whole cipher blocks
    return is_private_key(data)


def pem_keys(text: str) -> list[tuple[int, int]]:
    """Start and end of the PEM blocks of private keys; line ends may be written as escapes."""
    found = []
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            end, close = text.find("-----", m.end()), f"-----END {m[1]}-----"
            if end >= 0 and text.startswith(close, end) and _is_pem_key(text[m.end():end]):
                found.append((m.start(), end + len(close)))
    return found


def _key_size(data) -> int | None:
    """Bytes of the key that ``data`` begins with, by its own lengths."""
    if bytes(data[:len(_OPENSSH)]) == _OPENSSH:
        at = len(_OPENSSH)
        for _ in range(3):  # cipher, key derivation and its options
            at += 4 + int.from_bytes(data[at:at + 4], "big")
        keys = int.from_bytes(data[at:at + 4], "big")
        at += 4
        for _ in range(keys + 1):  # public keys and the private part
            size = int.from_bytes(data[at:at + 4], "big")
            if not size or at + 4 + size > len(data):
                return None
            at += 4 + size
        return at
    if len(data) < 6 or data[0] != _SEQUENCE:
        return None
    width = data[1] & 0x7F if data[1] & 0x80 else 0
    return 2 + width + int.from_bytes(data[2:2 + width], "big") if 1 <= width <= 4 else 2 + data[1] if not width else None


def _may_be_key(data) -> bool:
    """Whether the bytes behind the outer length of ``data`` begin as those of a private key do."""
    if data[0] != _SEQUENCE:
        return True  # an OpenSSH key, known by its first bytes
    at = 2 + (data[1] & 0x7F if data[1] & 0x80 else 0)
    return at < len(data) and data[at] in (_INTEGER, _SEQUENCE)


class _Run:
    """A run of base64 in one or more lines: its characters without line ends, decoded as a stream.

    Each of the four places a group of characters can begin at is decoded at most once, for the whole run, so
    that every line is looked at in bytes that are there already, however long the run and wherever it is wrapped.
    """

    def __init__(self, text: str, low: int, high: int):
        self.starts, self.ends, parts, at = [], [], [], low
        last = low + len(text[low:high].rstrip("="))
        for end in _LINE_END.finditer(text, low, high):
            self.starts.append(at)
            self.ends.append(end.start())
            at = end.end()
        self.starts.append(at)
        self.ends.append(last)
        parts = [text[x:y] for x, y in zip(self.starts, self.ends)]
        self.body = "".join(parts)
        self.begins = list(accumulate(map(len, parts), initial=0))  # of each line in the body, and its end
        self.high = high
        self.decoded: dict[int, bytes] = {}

    def stream(self, place: int) -> bytes:
        """The bytes from a place of the body on that begin a group there: place modulo 4 of the whole run."""
        shift = place % 4
        if shift not in self.decoded:
            self.decoded[shift] = _decoded(self.body[shift:]) or _decoded(self.body[shift:-1]) or b""
        return self.decoded[shift]

    def bytes_at(self, place: int) -> memoryview:
        return memoryview(self.stream(place))[place // 4 * 3:]

    def end_of(self, line: int) -> int:
        """Where a line ends in the text; the last one with its padding."""
        return self.high if line == len(self.ends) - 1 else self.ends[line]


def wrapped_keys(text: str) -> list[Span]:
    """Base64 in one or more lines that is a key (der), or whose bytes hold a PEM block of one (pem)."""
    found = []
    for m in WRAPPED.finditer(text):
        run = _Run(text, m.start(), m.end())
        done = 0  # characters of the body up to the end of the last key
        for line, low in enumerate(run.begins[:-1]):
            start = run.body[low:low + 16]
            if low < done or run.begins[line + 1] - low < 16 or not (
                    start.startswith("b3BlbnNzaC1rZXkt") or start[0] == "M" and start[1] in "ABCDEFGHI"):
                continue
            data = run.bytes_at(low)
            size = _key_size(data)
            need = size and low + size // 3 * 4 + (0, 2, 3)[size % 3]
            if not need or need > len(run.body) or not _may_be_key(data):
                continue
            last = bisect_left(run.begins, need)
            if run.begins[last] == need and is_private_key(_decoded(run.body[low:need]) or b""):
                done = need
                found.append((run.starts[line], run.end_of(last - 1), "der"))
        if m.end() - m.start() < 40 or done:
            continue
        keys: dict[int, list[tuple[int, int]]] = {}
        for line, low in enumerate(run.begins[:-1]):
            if line and not run.body.startswith("LS0tLS1CRUdJTi", low):  # a block that starts a line, below other lines
                continue
            shift = low % 4
            if shift not in keys:
                data = run.stream(low)
                keys[shift] = pem_keys(data.decode("latin-1")) if b"PRIVATE KEY-----" in data else []
            if keys[shift] and keys[shift][-1][0] >= low // 4 * 3:
                need = shift + -(-keys[shift][-1][1] * 4 // 3)
                found.append((run.starts[line], run.end_of(min(bisect_left(run.begins, need), len(run.ends)) - 1), "pem"))
                break
    return found


class _Cover:
    """Whether a stretch lies inside one of some spans."""

    def __init__(self, spans):
        spans = sorted((low, high) for low, high, _ in spans)
        self.lows = [low for low, _ in spans]
        self.highs = list(accumulate((high for _, high in spans), max))

    def holds(self, low: int, high: int) -> bool:
        before = bisect_right(self.lows, low)
        return before > 0 and self.highs[before - 1] >= high


def confirmed_spans(text: str) -> list[Span]:
    """Keys and tokens that decode to what they look like; a bare candidate has to be one whole key."""
    found = [(low, high, "pem") for low, high in pem_keys(text)]
    blocks = _Cover(found)
    found += [(low, high, kind) for low, high, kind in wrapped_keys(text) if not blocks.holds(low, high)]
    whole = _Cover(found)
    for pattern, decode in ((BASE64, _decoded), (HEX_KEY, lambda s: bytes.fromhex(s) if len(s) % 2 == 0 else None)):
        for m in pattern.finditer(text):
            if whole.holds(m.start(), m.end()):
                continue
            data = decode(m[0])
            if data and is_private_key(data):
                found.append((m.start(), m.end(), "der"))
    if "eyJ" in text:
        found += [(m.start(), m.end(), "token") for m in SIGNED.finditer(text) if is_signed_token(m[1], m[2])]
    return found


def secret_spans(text: str) -> list[Span]:
    """All spans (start, end, kind), in code points, by start and then by the order of the kinds."""
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{low}:{high}" for low, high, kind in spans)


def masked_text(text: str, spans: list[Span]) -> str:
    """``text`` with every stretch of overlapping spans replaced by one mask."""
    out, at = [], 0
    for low, high, _ in sorted(spans):
        if low >= at:
            out += [text[at:low], MASK]
        at = max(at, high)
    return "".join(out) + text[at:]


_SCAN = T.StructType([T.StructField("doc_id", T.LongType())] + [
    T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [
    T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("masked", T.StringType())])
_SCAN_ARROW = pa.schema([("doc_id", pa.int64())] + [(f"n_{k}", pa.int64()) for k in KINDS] + [
    ("base_sha256", pa.string()), ("spans", pa.string()), ("masked", pa.string())])


def _scan(with_text: bool):
    def row(doc_id, text):
        spans = secret_spans(text)
        base = [s for s in spans if s[2] in KINDS[:3]]
        kinds = [s[2] for s in spans]
        return (doc_id, *map(kinds.count, KINDS), hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans),
                masked_text(text, spans) if with_text else None)

    def run(batches):
        for batch in batches:
            rows = [row(i, t or "") for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            columns = list(zip(*rows)) if rows else [[]] * len(_SCAN_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCAN_ARROW.types)], schema=_SCAN_ARROW)
    return run


def scan_secrets(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: a count per kind, ``base_sha256``, ``spans``, and ``masked``.

    Spans are ``kind:start:end`` in code points, end exclusive. The base kinds (assign, access, hex) are
    patterns over the whole text; the others are confirmed by structure: private keys in PEM blocks (pem),
    also with escaped line ends, encrypted or in base64 once more, and in base64, in a line or wrapped, or hex
    (der), whose decoded lengths nest exactly, and signed tokens whose header is a JSON
    object with an algorithm (token). ``masked`` is the text with the spans replaced, if asked for. Null
    and empty texts have no spans; a null ``doc_id`` stays null; repeated rows each give a row.
    """
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(_scan(with_text)), _SCAN)


def _mask(batches):
    for batch in batches:
        column = batch.schema.get_field_index("text")
        texts = (t.as_py() for t in batch.column(column))
        texts = [t if t is None else masked_text(t, secret_spans(t)) for t in texts]
        yield batch.set_column(column, batch.schema.field(column), pa.array(texts, batch.schema.field(column).type))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in ``text`` masked; other columns and all rows stay, null texts too."""
    ship_package(docs.sparkSession)
    return docs.mapInArrow(lean(_mask), docs.schema)


@query("op7_secret_scan")
def op7_secret_scan(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_pem", "n_der", "n_token")
