"""Pseudonyms that stay linked however a value is written, and values of any length."""

import re
import time

import pytest

from tillcast.llm import QUERIES, pii

KEY = b"k" * 32


@pytest.mark.parametrize("spellings", [
    ("+49 30 1234567", "+49301234567", "+4930 1234567", "+49-30-123-4567", "+49 (30) 1234567"),
    ("+1 (017) 555-7713", "+10175557713", "+1 017 555 7713"), ("+420 601 234 567", "+420601234567"), ("+7 495 123 45 67", "+74951234567"),
    ("555-123-4567", "(555) 123-4567")])
def test_spellings_of_a_telephone_number_stay_linked(spellings):
    found = []
    for text in spellings:
        new, counts = pii.pseudonymise(f"call {text}.", KEY)
        assert counts["phone"] == 1 and new != f"call {text}." and pii.pseudonymise(new, KEY, back=True)[0] == f"call {text}."
        found.append(re.sub(r"\D", "", new))
    assert len(set(found)) == 1
    code = re.match(r"\+(\d*)", spellings[1])
    assert code is None or found[0].startswith(re.match(r"\+(\d+)", spellings[0])[1])


def test_addresses_have_the_lengths_of_their_format():
    assert pii.pseudonymise("a" * 64 + "@b.example.com", KEY)[1]["email"] == 1
    start = time.process_time()
    for text in ("a" * 65 + "@b.com", "a" * 40_000 + "@" + "b" * 40_000 + ".com"):
        assert pii.pseudonymise(text, KEY)[0] == text
    assert time.process_time() - start < 2


def test_all_calling_codes_are_told_apart():
    for code in (*pii.CODES_OF_1, *pii.CODES_OF_2, "351", "420", "971", "212", "299"):
        text = f"+{code}5551234567"[:15]
        new = pii.pseudonymise(text, KEY)[0]
        assert new.startswith(f"+{code}") and len(new) == len(text)


def test_linked_values_in_the_given_documents(spark):
    """Every telephone number and address of the table has one pseudonym, and no two have the same."""
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    counts = {r.doc_id: r.asDict() for r in QUERIES["op1_pseudonyms"](spark, folder).collect()}
    assert counts.keys() == texts.keys()
    forward, backward = {}, {}
    for text in texts.values():
        for kind in (pii._EMAIL, pii._SHAPE["phone"]):
            for m in kind.finditer(text):
                new, found = pii.pseudonymise(m[0], KEY)
                if sum(found.values()) == 1 and new != m[0]:
                    plain, changed = (re.sub(r"[^\w@.]", "", x) for x in (m[0], new))
                    assert forward.setdefault(plain, changed) == changed and backward.setdefault(changed, plain) == plain
    assert forward
