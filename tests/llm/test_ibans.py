"""Account numbers before words that look like a part of them."""

from __future__ import annotations

import pytest

from millrace.llm import pii


@pytest.mark.parametrize("number", [
    "ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00",
    "NO93 8601 1117 947", "PL61 1090 1014 0000 0712 1981 2874", "SE45 5000 0000 0583 9825 7466", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"])
@pytest.mark.parametrize("after", ["", ".", " BIC CAIXESBB", " EUR 50", " 2024", " CONTACT US", ", EUR", " AB12 3456 7890", " A1"])
@pytest.mark.parametrize("spaced", [True, False])
def test_word_after_an_iban(number, after, spaced):
    number = number if spaced else number.replace(" ", "")
    text = f"IBAN {number}{after}"
    assert [(s.kind, text[s.start:s.end]) for s in pii.find(text)] == [("iban", number)]
    assert pii.redact(text, pii.find(text)) == f"IBAN [IBAN]{after}"


def test_ibans_in_a_row_and_of_unlisted_countries():
    first, second, unlisted = "BE68 5390 0754 7034", "ES91 2100 0418 4502 0005 1332", "ZZ68 5390 0754 7034"
    numbers = lambda t: [t[a:b] for a, b in pii.ibans(t)]
    assert numbers(f"{first} {second} BIC") == [first, second]
    assert numbers(f"AB13 3456 7890 {first} EUR") == [first]
    digits = next(f"ZZ{c:02} {unlisted[5:]}" for c in range(2, 99) if pii.mod_97(f"ZZ{c:02}{unlisted[5:].replace(' ', '')}"))
    assert numbers(f"{digits} BIC") == [digits]
    assert numbers("ES91 2100 0418 4502 0005 1333 BIC") == [] == numbers("BE68 5390 0754 7035 EUR")
