"""Format-preserving pseudonyms: personal values are permuted within their own format.

Each kind of value is numbered from 0 to a size; a keyed Feistel network permutes
these numbers, and the pseudonym is the value of the permuted number. So equal
values have equal pseudonyms in all documents, different values different ones,
and whoever holds the key can go back.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import query, ship_package, table

ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")

# The shapes looked for. What has a check digit, a calendar or reserved numbers is tested as well.
_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])", re.A)
_SHAPES = {
    "iban": r"[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
    "ip": r"\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "date": r"(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})(?![\w]|[-/.]\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\w]|-\d)",
    "phone": r"""(?:\+\d{1,3}[\x20.-]?(?:\(\d{1,4}\)[\x20.-]?)?\d{2,4}(?:[\x20.-]?\d{2,4}){1,4}|\(\d{3}\)\x20?\d{3}-\d{4}
        |\d{3}-\d{3}-\d{4}(?!-\d))(?!\w)""",
    "card": r"\d(?:[\x20-]?\d){12,18}",
}
_SHAPE = {kind: re.compile(f"(?x){shape}", re.A) for kind, shape in _SHAPES.items()}
_NUMBERS = re.compile(rf"(?x)(?<![\w.])(?:{'|'.join(_SHAPES.values())})", re.A)
_WORD = re.compile(r"\w", re.A)
# Lengths of account numbers by country, and those of cards by their first digit, the usual one first.
IBAN_LENGTHS = {country: int(size) for size, countries in {
    "15": "NO", "16": "BE", "18": "DK FI FK FO GL NL SD", "19": "MK SI", "20": "AT BA EE KZ LT LU MN XK", "21": "CH CR HR LI LV",
    "22": "BG BH DE GB GE IE ME RS VA", "23": "AE GI IL IQ OM SO TL", "24": "AD CZ DZ ES MD PK RO SA SE SK TN VG",
    "25": "LY PT ST", "26": "IS TR", "27": "BI DJ FR GR IT MC MR SM", "28": "AL AZ BY CY DO GT HN HU LB NI PL SV",
    "29": "BR EG PS QA UA", "30": "JO KW MU YE", "31": "MT SC", "32": "LC", "33": "RU"}.items() for country in countries.split()}
# Calling codes of one digit and of two; all others have three. No code begins with another one.
CODES_OF_1 = frozenset("1 7".split())
CODES_OF_2 = frozenset("""20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66
    81 82 84 86 90 91 92 93 94 95 98""".split())
MOST_LOCAL, MOST_DOMAIN = 64, 255  # characters of the two parts of an address
CARD_LENGTHS = {"2": (16,), "3": (15, 16, 14), "4": (16, 19, 13), "5": (16,), "6": (16, 19)}
_DATE = re.compile(r"(\d+)([-/.])(\d+)([-/.])(\d+)")


def permute(number: int, size: int, key: bytes, kind: str, back: bool = False) -> int:
    """The image of ``number`` under a keyed permutation of ``range(size)``.

    A Feistel network over two residues whose product is just above ``size``; images that fall outside are
    permuted again until they are inside.
    """
    if size < 2:
        return number
    left_size = isqrt(size - 1) + 1
    right_size = -(-size // left_size)
    state = hashlib.blake2b(kind.encode() + b"\0" + size.to_bytes((size.bit_length() + 7) // 8, "big"), key=key, digest_size=32)

    def mixed(turn: int, half: int) -> int:
        own = state.copy()
        own.update(bytes([turn]) + half.to_bytes((half.bit_length() + 8) // 8, "big"))
        value = own.digest()
        while len(value) * 8 < left_size.bit_length() + 64:
            value += hashlib.blake2b(value, key=key).digest()
        return int.from_bytes(value, "big")

    while True:
        left, right = divmod(number, right_size)
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            change = mixed(turn, left if turn % 2 else right) * (-1 if back else 1)
            if turn % 2:
                right = (right + change) % right_size
            else:
                left = (left + change) % left_size
        number = left * right_size + right
        if number < size:
            return number


def _walk(number: int, size: int, key: bytes, kind: str, allowed: Callable[[int], bool], back: bool) -> int:
    """Permute within the allowed numbers: step on until one is allowed."""
    while True:
        number = permute(number, size, key, kind, back)
        if allowed(number):
            return number


def _radix(character: str) -> int:
    return 10 if character.isdigit() else 26 if character.isascii() and character.isalpha() else 1


def permute_characters(text: str, key: bytes, kind: str, back: bool = False) -> str:
    """Digits become digits and letters letters of the same case; other characters stay where they are."""
    size, number = 1, 0
    for c in text:
        radix = _radix(c)
        size *= radix
        number = number * radix + (int(c) if radix == 10 else ord(c.lower()) - 97 if radix == 26 else 0)
    number = permute(number, size, key, f"{kind}:{[_radix(c) for c in text]}", back)
    out = []
    for c in reversed(text):
        number, value = divmod(number, _radix(c))
        radix = _radix(c)
        out.append(str(value) if radix == 10 else chr(value + (65 if c.isupper() else 97)) if radix == 26 else c)
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    """The check digit that completes ``digits``."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (2 - i % 2)
        total += value - 9 if value > 9 else value
    return -total % 10


def _fill(shape: str, characters: str) -> str:
    """Put characters in the place of the letters and digits of ``shape``."""
    source = iter(characters)
    return "".join(next(source) if c.isalnum() else c for c in shape)


def _plain(text: str) -> str:
    return "".join(c for c in text if c.isalnum())


def _card(text: str, key: bytes, back: bool) -> str | None:
    digits = _plain(text)
    if int(digits[-1]) != _luhn(digits[:-1]) or len(set(digits)) == 1:
        return None
    size = 10 ** (len(digits) - 2)

    def whole(number: int) -> str:
        body = digits[0] + str(number).zfill(len(digits) - 2)
        return body + str(_luhn(body))
    return _fill(text, whole(_walk(int(digits[1:-1]), size, key, f"card:{digits[0]}{size}", lambda n: len(set(whole(n))) > 1, back)))


def _iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def _iban(text: str, key: bytes, back: bool) -> str | None:
    plain = _plain(text)
    if not 15 <= len(plain) <= 34 or int(plain[2:4]) != _iban_check(plain[:2], plain[4:]):
        return None
    account = permute_characters(plain[4:], key, f"iban:{plain[:2]}", back)
    return _fill(text, f"{plain[:2]}{_iban_check(plain[:2], account):02d}{account}")


def _ip(text: str, key: bytes, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    number = permute(int.from_bytes(bytes(map(int, parts)), "big"), 2**32, key, "ip", back)
    return ".".join(map(str, number.to_bytes(4, "big")))


def _ssn(text: str, key: bytes, back: bool) -> str | None:
    def valid(number: int) -> bool:
        area, group, serial = number // 10**6, number // 10**4 % 100, number % 10**4
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0
    number = int(_plain(text))
    if not valid(number):
        return None
    return _fill(text, str(_walk(number, 10**9, key, "ssn", valid, back)).zfill(9))


def _phone(text: str, key: bytes, back: bool) -> str | None:
    """The country code stays; it is told by its digits, so that a number is the same however it is written."""
    digits = _plain(text)
    if not 7 <= len(digits) <= 15:
        return None
    code = 0 if not text.startswith("+") else 1 if digits[0] in CODES_OF_1 else 2 if digits[:2] in CODES_OF_2 else 3
    return _fill(text, digits[:code] + permute_characters(digits[code:], key, f"phone:{digits[:code]}", back))


def _day(year: str, month: str, day: str) -> datetime.date | None:
    try:
        found = datetime.date(int(year), int(month), int(day))
    except ValueError:
        return None
    return found if FIRST_DAY <= found <= LAST_DAY else None


def _date(text: str, key: bytes, back: bool) -> str | None:
    """A date stays a date that is read in the same order: year first, else day first if that can be, else month first."""
    a, first, b, second, c = _DATE.fullmatch(text).groups()
    if first != second:
        return None
    if len(a) == 4:
        order, found, allowed = "ymd", _day(a, b, c), lambda d: True
    elif found := _day(c, b, a):
        order, allowed = "dmy", lambda d: True
    else:
        order, found, allowed = "mdy", _day(c, a, b), lambda d: d.day > 12
    if found is None:
        return None
    narrow = [len(p) for p in (a, b, c)]
    day = datetime.timedelta(1)
    fits = lambda n: allowed(d := FIRST_DAY + n * day) and all(
        w > 1 or getattr(d, p) < 10 for w, p in zip(narrow, ({"y": "year", "m": "month", "d": "day"}[o] for o in order)))
    size = (LAST_DAY - FIRST_DAY).days + 1
    new = FIRST_DAY + _walk((found - FIRST_DAY).days, size, key, f"date:{order}:{narrow}", fits, back) * day
    values = {"y": new.year, "m": new.month, "d": new.day}
    return first.join(str(values[o]).zfill(w) for o, w in zip(order, narrow))


def _email(text: str, key: bytes, back: bool) -> str | None:
    """The top-level domain stays."""
    name, _, domain = text.rpartition("@")
    if len(name) > MOST_LOCAL or len(domain) > MOST_DOMAIN:
        return None
    local, _, end = text.rpartition(".")
    return permute_characters(local, key, "email", back) + "." + end


_RULES = dict(zip(KINDS, (_email, _iban, _ip, _date, _ssn, _phone, _card)))


@lru_cache(maxsize=50_000)
def pseudonym(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value, or the value of a pseudonym; None if it is not a valid one of its kind."""
    return _RULES[kind](text, key, back)


def _ends(text: str, low: int, high: int) -> list[int]:
    """Ends of ``text[low:high]`` and of what it begins with where a group of characters ends, the longest first."""
    return [at for at in range(high, low, -1) if _WORD.match(text[at - 1]) and not _WORD.match(text[at:at + 1])]


def _usual_first(text: str, low: int, ends: list[int], lengths: tuple[int, ...], least: int, most: int) -> list[int]:
    """Ends that give so many characters: those of usual lengths in their order, then from the longest to the shortest."""
    sizes = {end: len(_plain(text[low:end])) for end in ends}
    order = {size: i for i, size in enumerate(lengths)}
    return sorted((e for e in ends if least <= sizes[e] <= most), key=lambda e: (order.get(sizes[e], len(order)), -e))


def _cards(text: str, low: int, inside: bool):
    if m := _SHAPE["card"].match(text, low):
        for high in _usual_first(text, low, _ends(text, low, m.end()), CARD_LENGTHS.get(text[low], ()), 13, 19):
            if not inside or len({c for c in text[low:high] if not c.isdigit()}) < 2:
                yield low, high, "card"


def _candidates(text: str, low: int, inside: bool):
    """What may be a value at a place, with its kind. The order is kept by the values' pseudonyms, as far as it can be.

    A card inside of something that failed, such as a row of dates, has one kind of separator.
    """
    if m := _SHAPE["iban"].match(text, low):
        usual = IBAN_LENGTHS.get(text[low:low + 2])
        for high in _usual_first(text, low, _ends(text, low, m.end()), (usual,) if usual else (), 15, 34):
            yield low, high, "iban"
    for kind in ("ip", "date", "ssn"):
        if m := _SHAPE[kind].match(text, low):
            yield low, m.end(), kind
            return
    if m := _SHAPE["phone"].match(text, low):
        yield low, m.end(), "phone"
        if text[low] == "+":
            yield from _cards(text, low + 1, inside)
        for high in _ends(text, low, m.end())[1:]:
            if _SHAPE["phone"].fullmatch(text, low, high):
                yield low, high, "phone"
    yield from _cards(text, low, inside)


def _found(text: str, key: bytes, back: bool):
    """Values from left to right that do not overlap, with their kind and pseudonym; what fails uses up its first character alone."""
    emails = list(_EMAIL.finditer(text))[::-1] if "@" in text else []
    at = failed = 0
    while True:
        while emails and emails[-1].start() < at:
            emails.pop()
        spot = _NUMBERS.search(text, at)
        if emails and (spot is None or emails[-1].start() <= spot.start()):
            m = emails.pop()
            if (new := pseudonym("email", m[0], key, back)) is not None:
                yield m.start(), m.end(), "email", new
                at = m.end()
            continue
        if spot is None:
            return
        at = spot.start() + 1
        for low, high, kind in _candidates(text, spot.start(), spot.start() < failed):
            new = pseudonym(kind, text[low:high], key, back)
            if new is not None:
                yield low, high, kind, new
                at = high
                break
        else:
            failed = max(failed, spot.end())


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with its values replaced, and how many there were of each kind."""
    out, at, counts = [], 0, dict.fromkeys(KINDS, 0)
    for low, high, kind, new in _found(text, key, back):
        out += [text[at:low], new]
        at = high
        counts[kind] += 1
    return "".join(out) + text[at:], counts


_PII = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())] + [
    T.StructField(f"n_{k}", T.LongType()) for k in KINDS])
_PII_ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string())] + [(f"n_{k}", pa.int64()) for k in KINDS])


def _replace(batches, key: bytes):
    for batch in batches:
        texts, counts = [], []
        for text in batch.column(1).to_pylist():
            new, found = pseudonymise(text or "", key)
            texts.append(None if text is None else new)
            counts.append([found[k] for k in KINDS])
        columns = list(zip(*counts)) if counts else [[]] * len(KINDS)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string())] + [pa.array(c, pa.int64()) for c in columns], schema=_PII_ARROW)


def pseudonymise_documents(docs: DataFrame, key: bytes) -> DataFrame:
    """``doc_id``, ``text`` with pseudonyms, and a count per kind, a row per row of ``docs (doc_id, text)``.

    Card numbers and account numbers need right check digits, dates must be in the calendar between 1900
    and 2099, social security numbers must not be reserved, addresses must be in range; what fails is tried
    again in the shorter forms that end at a group of its characters, and stays as it is if none is valid. A null text stays null with counts of 0, a null ``doc_id`` stays null, repeated rows each give a
    row. Values do not meet: the permutation alone links them, so nothing is shuffled.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda batches: _replace(batches, key), _PII)


@query("op1_pseudonyms")
def op1_pseudonyms(spark, sf_dir):
    """The key is a setting; a real job takes it from where its secrets are kept."""
    key = spark.conf.get("spark.tillcast.pseudonymKey", "key for checks only")
    return pseudonymise_documents(table(spark, sf_dir, "documents"), hashlib.sha256(key.encode()).digest())
